"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from
its characters' kinds, its words' lengths and repetition, and hashed words; gated
attention weighs the encodings, and a logistic layer scores their weighted sum.
Only documents carry labels: the weights of passages are learnt from them, in
numpy, on a bounded sample of labelled documents.

Null, empty and blank texts are one empty passage and get its score. A label that
is null is none; of several labels of a document the highest counts. Repeated
rows are scored each; an empty table gives no rows; without labels the score is
a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Shared, fold, mix, scan_words, together

PASSAGE = 48
HASHED = 64
ENCODED = 24
ATTENTION = 12
#: A score from which on a document counts as good.
THRESHOLD = 0.3
#: The sample to learn from: so many labelled documents at most, chosen by their ids' hashes, whole; none longer than this.
SAMPLE_DOCUMENTS = 3000
SAMPLE_CHARACTERS = 200_000
EPOCHS = 12


def _kinds() -> np.ndarray:
    """Each byte's kind: small, capital, digit, space, line, control, every ASCII sign by itself, and bytes beyond ASCII by their high bits."""
    kind = np.zeros(256, dtype=np.int64)
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    kind[:32], kind[127], kind[10], kind[32] = 5, 5, 4, 3
    kind[48:58], kind[65:91], kind[97:123] = 2, 1, 0
    for i, b in enumerate(signs):
        kind[b] = 6 + i
    kind[128:192], kind[192:224], kind[224:240], kind[240:] = (6 + len(signs) + i for i in range(4))
    return kind


KIND = _kinds()
KINDS = int(KIND.max()) + 1
FEATURES = KINDS + HASHED + 10


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for every passage of every text, and passages per text (one at least)."""
    w = scan_words(texts, lower=False)
    counts = np.maximum(1, -(-w.per_text // PASSAGE))
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    out = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(w.starts):
        return out, counts
    text_of = np.repeat(np.arange(len(texts)), w.per_text)
    begin = np.cumsum(w.per_text) - w.per_text
    passage = first[text_of] + (np.arange(len(text_of)) - begin[text_of]) // PASSAGE
    words = np.bincount(passage, minlength=total)
    some = np.maximum(1, words)
    # From one word's start to the next one's, spaces included, but no further than its text.
    following = np.append(w.starts[1:], len(w.raw))
    end = np.minimum(following, w.text_ends[text_of])
    span = end - w.starts
    covered = np.repeat(np.tile([True, False], len(span)), np.stack((span, following - end), axis=1).ravel())
    signs = np.bincount(np.repeat(passage, span) * KINDS + KIND[w.raw[w.starts[0] :][covered]], minlength=total * KINDS).reshape(total, KINDS)
    out[:, :KINDS] = np.sqrt(signs / np.maximum(1, signs.sum(axis=1, keepdims=True)))
    hashed = np.bincount(passage * HASHED + (w.hashes % U64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED)
    out[:, KINDS : KINDS + HASHED] = np.sqrt(hashed / some[:, None])
    lengths = (w.ends - w.starts).astype(np.float64)
    mean = np.bincount(passage, weights=lengths, minlength=total) / some
    square = np.bincount(passage, weights=lengths**2, minlength=total) / some
    again = np.zeros(len(text_of), dtype=bool)
    same = np.append(False, text_of[1:] == text_of[:-1])
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & same[1:]
    pair = np.zeros(len(text_of), dtype=bool)
    pair[same] = _seen_before((mix(w.hashes[:-1] * U64(0x9E3779B97F4A7C15) + w.hashes[1:]) ^ mix(text_of[1:].astype(U64)))[same[1:]])
    word = _seen_before(w.hashes ^ mix(passage.astype(U64) + U64(1 << 40)))
    share = lambda flag: np.bincount(passage, weights=flag, minlength=total) / some
    whole = np.bincount(text_of, weights=pair, minlength=len(texts)) / np.maximum(1, w.per_text)
    columns = [mean / 10, np.sqrt(np.maximum(0, square - mean**2)) / 10, share(lengths <= 2), share(lengths >= 14), share(again), share(pair), share(word), words / PASSAGE, np.repeat(np.log1p(w.per_text) / 8, counts), np.repeat(whole, counts)]
    out[:, KINDS + HASHED :] = np.stack(columns, axis=1)
    return out, counts


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Which keys occur earlier as well."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


@dataclass
class AttentionScorer:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Rounded where the order of sums, which depends on what else is scored, could show."""
        x, counts = features(texts)
        p = {k: v.astype(np.float64) for k, v in self.p.items()}
        return np.round(1 / (1 + np.exp(-_forward(p, (x.astype(np.float64) - self.mean) / self.scale, counts)["y"])), 9)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _forward(p: dict, x: np.ndarray, counts: np.ndarray) -> dict:
    """Encodings, attention and one logit for each bag."""
    starts = np.cumsum(counts) - counts
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    raw = (t * s) @ p["a"]
    weight = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), counts))
    weight /= np.repeat(_sums(weight, starts), counts)
    z = _sums(weight[:, None] * h, starts)
    return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "y": z @ p["c"] + p["d"], "starts": starts}


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> AttentionScorer:
    rng = np.random.default_rng(seed)
    parts = [features(texts[s]) for s in together(pa.array(texts, pa.string()))] or [features([""])]
    x, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
    del parts
    y = np.array(labels, dtype=np.float32)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    x -= mean
    x /= scale
    first = np.cumsum(counts) - counts
    p = {"w": rng.normal(0, FEATURES**-0.5, (FEATURES, ENCODED)), "b": np.zeros(ENCODED), "v": rng.normal(0, ENCODED**-0.5, (ENCODED, ATTENTION)), "u": rng.normal(0, ENCODED**-0.5, (ENCODED, ATTENTION)), "a": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, ENCODED), "d": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, size = 0, 32
    for epoch in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), size):
            bags = order[lo : lo + size]
            n = counts[bags]
            rows = np.repeat(first[bags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            bx = x[rows]
            f = _forward(p, bx, n)
            dy = (1 / (1 + np.exp(-f["y"])) - y[bags]) / len(bags)
            dz = np.repeat(dy[:, None] * p["c"], n, axis=0)
            dweight = (f["h"] * dz).sum(axis=1)
            draw = f["weight"] * (dweight - np.repeat(_sums(f["weight"] * dweight, f["starts"]), n))
            dgate = draw[:, None] * p["a"]
            dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
            dh = (f["weight"][:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
            g = {"w": bx.T @ dh + 1e-4 * p["w"], "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ draw, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}
            step += 1
            rate = 0.01 * (1 - epoch / (epochs + 1))
            for k, v in g.items():
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                p[k] -= (rate * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    if not len(y):
        p["c"][:] = 0
    return AttentionScorer(mean, scale, p)


def learning_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, kept_out: int = 0, documents: int = SAMPLE_DOCUMENTS) -> list:
    """(text, label) of ``documents`` labelled documents at most, those with the smallest hashes of their ids, from the folds to learn from.

    Of rows with one id the smallest text counts. What is broadcast and gathered
    is bounded by ``documents`` and ``SAMPLE_CHARACTERS``.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull()).where(fold("k", folds) != kept_out)
    chosen = marked.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(documents)
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("t")).where(F.length("t") <= SAMPLE_CHARACTERS)
    found = rows.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).collect()
    return sorted((r["t"], r["y"]) for r in found)


def learn(docs: DataFrame, labels: DataFrame, **options) -> AttentionScorer:
    sample = learning_sample(docs, labels, **options)
    return train([t for t, _ in sample], [int(y > 0) for _, y in sample])


def _scoring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in together(batch["text"]):
                part = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.value.scores(part["text"].to_pylist()), pa.float64())], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, scorer: AttentionScorer) -> DataFrame:
    """doc_id and score of every row."""
    model = Shared(docs.sparkSession, scorer)  # some ten kB
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scoring(model), "doc_id long, score double")


def qualities(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = scored(docs, learn(docs, labels))
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeping(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for s in together(batch.column(at)):
                part = batch.slice(s.start, s.stop - s.start)
                yield part.filter(pa.array(model.value.scores(part.column(at).to_pylist()) >= threshold))

    return run


def good_documents(docs: DataFrame, scorer: AttentionScorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    model = Shared(docs.sparkSession, scorer)
    return docs.mapInArrow(_keeping(model, threshold), docs.schema)
