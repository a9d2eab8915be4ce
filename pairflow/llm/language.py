"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each
filter's strongest answer in a window goes to a softmax over languages. The
network is trained in numpy on a bounded sample of labelled text, in which every
language has its part. A document's
prediction averages the windows of its whole text, by their bytes.

Null texts and those without a letter are ``und``, with score 0. Rows with a null
id or language are predicted like others, but never learnt from. Repeated rows
are predicted each; an empty table gives no rows, and a table without one
labelled row only ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fold, together, written

UNKNOWN = "und"
#: Bytes that a window's filters begin at.
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDED = 8
#: The sample to learn from: about so many documents, as many of each language (one at least), whole; none longer than this.
SAMPLE_DOCUMENTS = 2800
SAMPLE_CHARACTERS = 200_000
#: Windows of them that are learnt from, drawn from all over their texts.
SAMPLE_WINDOWS = 36_000
#: Languages are broadcast up to this many.
BROADCAST_LANGUAGES = 50_000
#: A document whose best language scores less is in none of them.
LEAST_SCORE = 0.4
EPOCHS = 4
RATE = 0.01
_CHUNK = 96
_PAD = max(WIDTHS) - 1
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes laid out in windows (zeros after a text's end), windows per text, and bytes per window."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(c) for c in coded], dtype=np.int64)
    counts = -(-(sizes + _PAD) // WINDOW)
    flat = b"".join(c.ljust(n * WINDOW, b"\0") for c, n in zip(coded, counts.tolist(), strict=True))
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.frombuffer(flat, dtype=np.uint8), counts, np.clip(np.repeat(sizes, counts) - place * WINDOW, 1, WINDOW)


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def folded(self) -> Folded:
        """For prediction: a filter's answer as a sum of looked-up rows, two bytes at a time."""
        single = [[self.embedding @ f[j] for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)  # noqa: E731  the first byte is the high one
        first = np.concatenate([pair(s[0] + b, s[1]) for s, b in zip(single, self.biases, strict=True)], axis=1)
        return Folded(self.languages, first.astype(np.float32), single[1][2].astype(np.float32), pair(single[2][2], single[2][3]).astype(np.float32), self.dense.astype(np.float32), self.offset.astype(np.float32))


@dataclass
class Folded:
    languages: list[str]
    first: np.ndarray
    third: np.ndarray
    last: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def windows(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of each language for each window; filters look on into the next window of the same text, and see zeros after its last."""
        n = len(flat) // WINDOW
        wide = np.zeros((n, WINDOW + _PAD), dtype=np.uint16)
        wide[:, :WINDOW] = flat.reshape(n, WINDOW)
        wide[:-1, WINDOW:] = wide[1:, :_PAD]
        wide[np.cumsum(counts) - 1, WINDOW:] = 0
        pairs = (wide[:, :-1] << 8) | wide[:, 1:]
        pooled = np.empty((n, self.dense.shape[0]), dtype=np.float32)
        f = FILTERS
        for lo in range(0, n, _CHUNK):
            part = slice(lo, lo + _CHUNK)
            answers = self.first.take(pairs[part, :WINDOW], axis=0)
            answers[:, :, f : 2 * f] += self.third.take(wide[part, 2 : WINDOW + 2], axis=0)
            answers[:, :, 2 * f :] += self.last.take(pairs[part, 2 : WINDOW + 2], axis=0)
            pooled[part] = answers.max(axis=1)
        np.maximum(pooled, 0, out=pooled)
        # In double precision, so that what else is in the batch doesn't show after rounding.
        logits = pooled.astype(np.float64) @ self.dense.astype(np.float64) + self.offset
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if known:
            flat, counts, sizes = windows_of([texts[i] for i in known])
            weighted = self.windows(flat, counts) * sizes[:, None]
            starts = np.cumsum(counts) - counts
            mean = np.add.reduceat(weighted, starts, axis=0) / np.add.reduceat(sizes, starts)[:, None]
            for i, best, p in zip(known, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
                labels[i], scores[i] = self.languages[best], min(1.0, round(p, 9))
        return labels, scores


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> ByteNetwork:
    """Learns from windows of the texts, each with its text's label; Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    flat, counts, sizes = windows_of(texts)
    target = np.repeat([languages.index(x) for x in labels], counts).astype(np.int64)
    window = flat.reshape(-1, WINDOW)
    full = sizes >= min(WINDOW, 16)
    drawn = np.flatnonzero(full)
    if len(drawn) > SAMPLE_WINDOWS:
        # As many of each document as it has, up to what leaves room for all.
        place = np.arange(len(full)) - np.repeat(np.cumsum(counts) - counts, counts)
        shuffled = np.argsort(rng.random(len(full)) + np.repeat(np.arange(len(counts)), counts), kind="stable")
        turn = np.empty(len(full), dtype=np.int64)
        turn[shuffled] = place
        drawn = drawn[np.argsort(turn[drawn] + rng.random(len(drawn)), kind="stable")[:SAMPLE_WINDOWS]]
    window, target = window[drawn], target[drawn]
    # Neighbours beyond the window are zeros while learning.
    window = np.concatenate((window, np.zeros((len(window), _PAD), np.uint8)), axis=1)
    classes = max(1, len(languages))
    p = {"e": rng.normal(0, 0.3, (256, EMBEDDED)), "d": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "o": np.zeros(classes)}
    for i, w in enumerate(WIDTHS):
        p[f"f{i}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDED), (w, EMBEDDED, FILTERS))
        p[f"b{i}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = (len(target) / (classes * np.maximum(1, np.bincount(target, minlength=classes)))).astype(np.float32)
    step, batch = 0, 64
    for epoch in range(epochs):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            x, y = window[at], target[at]
            embedded = p["e"][x]
            pooled, where, unrolled = [], [], []
            for i, w in enumerate(WIDTHS):
                u = np.concatenate([embedded[:, j : j + WINDOW] for j in range(w)], axis=2)
                answer = (u.reshape(-1, w * EMBEDDED) @ p[f"f{i}"].reshape(w * EMBEDDED, FILTERS)).reshape(len(at), WINDOW, FILTERS) + p[f"b{i}"]
                k = answer.argmax(axis=1)
                where.append(k)
                unrolled.append(u)
                pooled.append(np.take_along_axis(answer, k[:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            logits = hidden @ p["d"] + p["o"]
            logits = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob = logits / logits.sum(axis=1, keepdims=True)
            prob[np.arange(len(at)), y] -= 1
            prob *= weight[y][:, None] / len(at)
            g = {"d": hidden.T @ prob, "o": prob.sum(axis=0)}
            back = (prob @ p["d"].T) * (raw > 0)
            g["e"] = np.zeros_like(p["e"])
            for i, w in enumerate(WIDTHS):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                chosen = np.take_along_axis(unrolled[i], where[i][:, :, None], axis=1)
                g[f"f{i}"] = np.einsum("bfe,bf->ef", chosen, part).reshape(w, EMBEDDED, FILTERS)
                g[f"b{i}"] = part.sum(axis=0)
                to_bytes = np.einsum("bf,wef->bfwe", part, p[f"f{i}"])
                for j in range(w):
                    np.add.at(g["e"], x[np.arange(len(at))[:, None], where[i] + j], to_bytes[:, :, j])
            step += 1
            rate = RATE * (1 - epoch / (epochs + 1))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return ByteNetwork(languages, p["e"], [p[f"f{i}"] for i in range(len(WIDTHS))], [p[f"b{i}"] for i in range(len(WIDTHS))], p["d"], p["o"])


def learning_sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", folds: int = 4, kept_out: int = 2, documents: int = SAMPLE_DOCUMENTS) -> list:
    """(text, lang) of about ``documents`` documents, chosen by the hash of the id, from the folds to learn from.

    Every language has its part, one document at least. Of rows with one id and
    language the smallest text counts. The driver gets no more than the larger of
    ``2 * documents`` and two rows a language.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull()).where(fold("k", folds) != kept_out).where(F.length("t") <= SAMPLE_CHARACTERS)
    counts = written(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("k")).alias("least")))
    languages = counts.count()
    if not languages:
        return []
    hashed = F.xxhash64("k")
    chance = F.pmod(hashed, F.lit(1_000_000)) / 1_000_000
    chosen = rows.join(F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts, "l").where((chance < documents / languages / F.col("n")) | (hashed == F.col("least")))
    found = chosen.groupBy("k", "l").agg(F.min("t").alias("t")).orderBy(F.xxhash64("k", "l"), "k", "l").limit(2 * max(documents, languages)).collect()
    return sorted(((r["t"], r["l"]) for r in found if has_letter(r["t"])), key=lambda r: (r[1], r[0]))


def learn(docs: DataFrame, **options) -> ByteNetwork:
    sample = learning_sample(docs, **options)
    return train([t for t, _ in sample], [x for _, x in sample])


def _predicting(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = model.value.folded()
        for batch in batches:
            for s in together(batch["text"]):
                part = batch.slice(s.start, s.stop - s.start)
                labels, scores = network.predict(part["text"].to_pylist())
                others = [part[i] for i, name in enumerate(part.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*others, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*(x for x in part.schema.names if x != "text"), "lang_pred", "score"])

    return run


def identified(docs: DataFrame, network: ByteNetwork, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, lang_pred and score of every row."""
    model = Shared(docs.sparkSession, network)  # some hundred kB
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predicting(model), "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a network that learnt from the others' folds."""
    found = identified(docs, learn(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def _keeping(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = model.value.folded()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for s in together(batch.column(at)):
                part = batch.slice(s.start, s.stop - s.start)
                labels, scores = network.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([label != UNKNOWN and score >= least for label, score in zip(labels, scores, strict=True)], pa.bool_()))

    return run


def documents_with_language(docs: DataFrame, network: ByteNetwork, least: float = LEAST_SCORE) -> DataFrame:
    """The rows in a language that was learnt, with all their columns: neither ``und`` nor scored below ``least``."""
    model = Shared(docs.sparkSession, network)
    return docs.mapInArrow(_keeping(model, least), docs.schema)
