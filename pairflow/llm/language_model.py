"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of n-grams (here words, pairs and triples) and a
uniform one are mixed. The weights depend on how often the context was seen, in buckets, and
are learnt by expectation-maximisation on documents whose counts are deleted: of
the folds to learn from, fold ``DELETED`` is counted only after the weights are
known.

Documents become blocks of about ``BLOCK_TOKENS`` tokens, written to the shared
folder. Each block sends its distinct n-grams with their counts, sorted and
packed, to those buckets by hash that get any, so that messages are never more
than n-grams; a bucket adds them up and answers each block with the
corpus's counts in the same order; a block and its answers then score its
documents. A frequent n-gram comes once from each block, so no bucket is hot, and
nothing that grows with the corpus passes the driver: it gets two sums a bucket
and a bounded histogram.

A document is its words and one end. Null and empty texts are the end alone. Rows
with a null id are scored but not learnt from (held_out is null). Repeated rows
are learnt from and scored as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import os
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Shared, mix, together, word_hashes, written

ORDER = 3
FOLDS, KEPT_OUT, DELETED = 10, 0, 1
ADDED = 0.1
BLOCK_TOKENS = 1_000_000
#: Distinct n-grams of all blocks that a bucket adds up, about.
BUCKET_ENTRIES = 1_500_000
#: Bits of a pair's (or longer n-gram's) hash, words having 64: so many more than the number of n-grams has that one in 65,536 shares its hash with another.
SPARE_BITS, MOST_BITS = 16, 56
END = U64(0x5BD1E9955BD1E995)
#: Context counts fall into buckets by their bits, this many at most.
CONTEXT_BUCKETS = 16


def bins_of(order: int) -> tuple[int, int]:
    """How many bins probabilities fall into, and how many of them halve it: the histogram has at most 16 ** (order - 1) * bins ** order codes."""
    return (80, 2) if order < 3 else (32, 1)


def hash_bits(grams: int) -> int:
    return min(MOST_BITS, max(32, grams.bit_length() + SPARE_BITS))


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers, byte by byte of their places, compressed."""
    planes = [(x.dtype.str, len(x), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b"") for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, protocol=5))


def unpack(data: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind) for kind, n, raw in planes]


class Block:
    """Some documents as places in a sorted vocabulary: ids, whether an id is null, whether its counts are learnt, tokens each, the vocabulary's hashes, and every token's place."""

    def __init__(self, ids, null, learnt, sizes, vocabulary, tokens):
        self.ids, self.null, self.learnt, self.sizes, self.vocabulary, self.tokens = ids, null, learnt, sizes, vocabulary, tokens

    def packed(self) -> bytes:
        return pack([self.ids, self.null, self.learnt, self.sizes, self.vocabulary, self.tokens])

    def grams(self, order: int, bits: int = MOST_BITS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length 1 to ``order``: sorted distinct hashes, learnt counts, and each token's place among them (-1 where the n-gram would begin before the document).

        A pair may begin with the end before the document's first word.
        """
        learnt = np.repeat(self.learnt, self.sizes).astype(bool)
        rank = np.arange(len(self.tokens)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        hashed = self.vocabulary[self.tokens]
        out = [(self.vocabulary, np.bincount(self.tokens[learnt], minlength=len(self.vocabulary)).astype(np.uint32), self.tokens.astype(np.int64))]
        key = hashed
        for n in range(2, order + 1):
            # Of the tokens n - 1 before: the first word's is the end.
            before = np.empty_like(hashed)
            before[n - 1 :] = hashed[: len(hashed) - n + 1]
            before[rank < n - 1] = END
            key = mix(key * U64(0x9E3779B97F4A7C15) + before * U64(2) + U64(n))
            short = key >> U64(64 - bits)
            whole = rank >= n - 2
            values, place = np.unique(short[whole], return_inverse=True)
            every = np.full(len(hashed), -1, dtype=np.int64)
            every[whole] = place
            out.append((values, np.bincount(place[learnt[whole]], minlength=len(values)).astype(np.uint32), every))
        return out


def unpacked(data: bytes) -> Block:
    return Block(*unpack(data))


_BLOCK = "block long, deleted boolean, tokens long, payload binary"


def _class(doc_id: int | None) -> int:
    return KEPT_OUT if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the deleted fold's documents, and blocks of the others."""
    held: dict[bool, list] = {False: [], True: []}
    count = {False: 0, True: 0}

    def flush(deleted: bool) -> pa.RecordBatch:
        ids, sizes, hashes = zip(*held[deleted], strict=True)
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        block = Block(
            np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array([i is not None and _class(i) != KEPT_OUT for i in ids], np.uint8), np.array(sizes, np.int64), vocabulary, tokens.astype(np.uint32)
        )
        row = pa.RecordBatch.from_arrays([pa.array([int.from_bytes(os.urandom(8), "little", signed=True)], pa.int64()), pa.array([deleted]), pa.array([count[deleted]], pa.int64()), pa.array([block.packed()], pa.binary())], names=["block", "deleted", "tokens", "payload"])
        held[deleted], count[deleted] = [], 0
        return row

    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        for s in together(batch["text"]):
            hashes, per_text, _ = word_hashes(batch["text"].slice(s.start, s.stop - s.start).to_pylist())
            at = 0
            for doc_id, words in zip(ids[s], per_text.tolist(), strict=True):
                kind = _class(doc_id) == DELETED and doc_id is not None
                held[kind].append((doc_id, words + 1, np.append(hashes[at : at + words], END)))
                at += words
                count[kind] += words + 1
                if count[kind] >= BLOCK_TOKENS:
                    yield flush(kind)
    for kind in (False, True):
        if held[kind]:
            yield flush(kind)


def _cuts(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket's share of sorted hashes begins."""
    step = (1 << bits) // buckets
    return np.append(np.searchsorted(values, np.array([step * b for b in range(buckets)], dtype=U64)), len(values))


def _requests(buckets: int, order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, deleted, payload in zip(batch["block"].to_pylist(), batch["deleted"].to_pylist(), batch["payload"], strict=True):
                grams = unpacked(payload.as_py()).grams(order, bits)
                cuts = [_cuts(v, 64 if n == 0 else bits, buckets) for n, (v, _, _) in enumerate(grams)]
                rows, to = [], np.flatnonzero(sum(np.diff(c) for c in cuts))
                for b in to.tolist():
                    parts = []
                    for (values, counts, _), cut in zip(grams, cuts, strict=True):
                        own = values[cut[b] : cut[b + 1]]
                        parts += [np.diff(own, prepend=U64(0)), counts[cut[b] : cut[b + 1]]]
                    rows.append(pack(parts))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([block] * len(to), pa.int64()), pa.array([deleted] * len(to)), pa.array(rows, pa.binary())], names=["bucket", "block", "deleted", "payload"])

    return run


_ANSWER = "bucket int, block long, payload binary, total long, distinct long"


def _add_up(order: int):
    def run(rows):
        """Corpus counts of a bucket's n-grams, for each block in its own order: all that is learnt, and for deleted blocks also what is not deleted."""
        import pandas as pd

        asked = [unpack(x) for x in rows["payload"]]
        deleted = rows["deleted"].to_numpy()
        answers: list[list[np.ndarray]] = [[] for _ in asked]
        total = distinct = 0
        for n in range(order):
            values = [np.cumsum(x[2 * n], dtype=U64) for x in asked]
            counts = [x[2 * n + 1] for x in asked]
            sizes = np.array([len(v) for v in values])
            every = np.concatenate(values)
            found, place = np.unique(every, return_inverse=True)
            count = np.concatenate(counts).astype(np.float64)
            kept = np.repeat(~deleted, sizes)
            all_ = np.bincount(place, weights=count, minlength=len(found)).astype(np.uint64)
            rest = np.bincount(place[kept], weights=count[kept], minlength=len(found)).astype(np.uint64)
            if n == 0:
                total, distinct = int(all_.sum()), int((all_ > 0).sum())
            for out, part, is_deleted in zip(answers, np.split(place, np.cumsum(sizes)[:-1]), deleted, strict=True):
                out.append(all_[part])
                if is_deleted:
                    out.append(rest[part])
        first = np.arange(len(rows)) == 0
        return pd.DataFrame({"bucket": rows["bucket"], "block": rows["block"], "payload": [pack(x) for x in answers], "total": np.where(first, total, 0), "distinct": np.where(first, distinct, 0)})

    return run


def _counts_of(answers, order: int, deleted: bool, rest: bool) -> list[np.ndarray]:
    """Each n-gram length's corpus counts in the block's order: all, or the rest without the deleted fold."""
    parts = [unpack(x) for x in answers.sort_values("bucket")["payload"]]
    step = 2 if deleted else 1
    return [np.concatenate([p[step * n + rest] for p in parts]) for n in range(order)]


def _estimates(block: Block, counts: list[np.ndarray], order: int, total: int, bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each token the maximum-likelihood estimates of each length (0 where the context is unseen), and the code of its contexts' buckets."""
    grams = block.grams(order, bits)
    end = counts[0][np.searchsorted(block.vocabulary, END)].astype(np.float64)
    rank = np.arange(len(block.tokens)) - np.repeat(np.cumsum(block.sizes) - block.sizes, block.sizes)
    seen = counts[0][grams[0][2]].astype(np.float64)
    estimates = [seen / max(1, total)]
    code = np.zeros(len(seen), dtype=np.int64)
    for n in range(1, order):
        place = grams[n][2]
        own = np.append(counts[n], np.zeros(1, counts[n].dtype))[place].astype(np.float64)  # the last is of no n-gram
        # The context is the n-gram that ended at the token before; before the first word, the end.
        context = np.empty_like(seen)
        context[1:] = seen[:-1]
        context[rank == 0] = end if n == 1 else 0
        estimates.append(np.divide(own, context, out=np.zeros_like(own), where=context > 0))
        code = code * CONTEXT_BUCKETS + np.minimum(CONTEXT_BUCKETS - 1, np.ceil(np.log2(context + 1)).astype(np.int64))
        seen = own
    return np.stack(estimates, axis=1), code


def _bin(p: np.ndarray, order: int) -> np.ndarray:
    """0 for nothing, else 1 and up by (parts of) powers of two."""
    bins, each = bins_of(order)
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.round(-each * np.log2(p)), 0, bins - 2), 0).astype(np.int64)


def _histogram(order: int, kept_total: int, bits: int):
    def run(key, blocks, answers):
        import pandas as pd

        block = unpacked(blocks["payload"].iloc[0])
        estimates, code = _estimates(block, _counts_of(answers, order, True, True), order, kept_total, bits)
        for n in range(order):
            code = code * bins_of(order)[0] + _bin(estimates[:, n], order)
        values, n = np.unique(code, return_counts=True)
        return pd.DataFrame({"code": values, "n": n.astype(np.int64)})

    return run


def learn_weights(codes: np.ndarray, n: np.ndarray, order: int, distinct: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (uniform, then each length) by context code, by expectation-maximisation on the histogram.

    A little of every context's weights is that of all contexts together, and no
    weight falls on a length whose context is unseen.
    """
    places = CONTEXT_BUCKETS ** (order - 1)
    p = np.empty((len(codes), order + 1))
    p[:, 0] = 1 / (distinct + 1)
    rest = codes.copy()
    bins, each = bins_of(order)
    for k in range(order, 0, -1):
        b = rest % bins
        p[:, k] = np.where(b > 0, 2.0 ** (-(b - 1) / each), 0)
        rest //= bins
    able = np.ones((places, order + 1))
    for k in range(1, order):
        able[:, 1 + k] = (np.arange(places) // CONTEXT_BUCKETS ** (order - 1 - k)) % CONTEXT_BUCKETS > 0
    prior = np.array([0.1, 0.4, *[0.5 / max(1, order - 1)] * (order - 1)])
    weights = able * prior
    weights /= weights.sum(axis=1, keepdims=True)
    for _ in range(rounds if len(codes) else 0):
        share = weights[rest] * p
        share *= (n / share.sum(axis=1))[:, None]
        by_place = np.stack([np.bincount(rest, weights=share[:, k], minlength=places) for k in range(order + 1)], axis=1)
        together_ = by_place.sum(axis=0) + prior
        weights = (by_place + 2 * together_ / together_.sum()) * able
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, bits: int, model):
    def run(key, blocks, answers):
        import pandas as pd

        weights, total, distinct = model.value
        block, deleted = unpacked(blocks["payload"].iloc[0]), bool(blocks["deleted"].iloc[0])
        counts = _counts_of(answers, order, deleted, False)
        estimates, code = _estimates(block, counts, order, total, bits)
        mixed = weights[code]
        p = mixed[:, 0] / (distinct + 1)
        for k in range(order):
            p += mixed[:, k + 1] * estimates[:, k]
        seen = counts[0][block.tokens].astype(np.float64)
        base = np.log10((seen + ADDED) / (total + ADDED * (distinct + 1)))
        starts = np.cumsum(block.sizes) - block.sizes
        null = block.null.astype(bool)
        kept_out = [None if x else _class(int(i)) == KEPT_OUT for i, x in zip(block.ids, null, strict=True)]
        return pd.DataFrame(
            {
                "doc_id": pd.array(np.where(null, None, block.ids), dtype="Int64"),
                "held_out": pd.array(kept_out, dtype="boolean"),
                "n_tokens": block.sizes,
                "n_known": np.add.reduceat((seen > 0).astype(np.int64), starts),
                "train_tokens": total,
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(np.log10(p), starts),
            }
        )

    return run


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The rows of ``SCORED`` for every document."""
    spark = docs.sparkSession
    blocks = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks, _BLOCK))
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    bits = hash_bits(order * tokens)
    buckets = 1 << max(0, int(order * 0.8 * tokens / BUCKET_ENTRIES).bit_length())
    asked = blocks.select("block", "deleted", "payload").mapInArrow(_requests(buckets, order, bits), "bucket int, block long, deleted boolean, payload binary")
    answers = written(asked.groupBy("bucket").applyInPandas(_add_up(order), _ANSWER))
    total, distinct = answers.agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = total or 0, distinct or 0
    own = answers.select("block", "bucket", "payload")
    deleted = blocks.where("deleted")
    kept = total - (deleted.agg(F.sum("tokens")).first()[0] or 0)
    of_deleted = own.join(F.broadcast(deleted.select("block")) if deleted.limit(100_001).count() <= 100_000 else deleted.select("block"), "block", "left_semi")
    found = deleted.groupBy("block").cogroup(of_deleted.groupBy("block")).applyInPandas(_histogram(order, kept, bits), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(found["code"].to_numpy(np.int64), found["n"].to_numpy(np.float64), order, distinct)
    model = Shared(spark, (weights, total, distinct))  # a few kB
    return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(_score(order, bits, model), SCORED)
