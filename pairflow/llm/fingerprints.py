"""Document fingerprints: SimHash over weighted words and word pairs, and search within a Hamming radius.

Every term's hash votes with its weight on each bit of the fingerprint. Null and
empty texts have the fingerprint zero. Equal texts have equal fingerprints.

``fingerprints_with_edits`` also fingerprints each text with its second half
replaced by the beginning of the next document (by descending id; nulls last,
ties by the text's hash, after the last row the first). One shuffle deals the rows
by ranges of that order, whose number follows the texts' bytes; the rows that begin
a range are known beforehand, since ranges begin at sampled rows, and go to the
range before as well. Rows of one id are told apart by their texts' hashes; only
rows alike in both come to one range.

``within`` finds all fingerprints in a Hamming radius by permuted block tables, and
``with_neighbours`` counts them for the documents that are asked about.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, together, word_hashes, written

BITS = 128
#: A text with no more words than this also votes with its runs of four bytes.
SHORT = 16
_SEGMENT = 64
#: Texts are fingerprinted together up to so many characters.
_TOGETHER = 1 << 20


def _spread() -> np.ndarray:
    """For each byte a number whose eight bytes are the byte's bits, highest first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


_BITS_OF = _spread()


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, weight and text of every term, by text: words (1, or 2 if longer than three bytes), pairs of words (3), and short texts' runs of bytes (1)."""
    hashes, per_text, lengths = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), per_text)
    same = owner[1:] == owner[:-1]
    pairs = mix(hashes[:-1][same] * U64(0x9E3779B97F4A7C15) + hashes[1:][same])
    grams, gram_owner = [], []
    for i in np.flatnonzero(per_text <= SHORT).tolist():
        raw = np.frombuffer((texts[i] or "").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(U64)
        if len(raw) >= 4:
            grams.append(mix(raw[:-3] + (raw[1:-2] << U64(8)) + (raw[2:-1] << U64(16)) + (raw[3:] << U64(24)) + U64(1 << 40)))
            gram_owner.append(np.full(len(raw) - 3, i))
    every = np.concatenate([hashes, pairs, *grams])
    weight = np.concatenate([1 + (lengths > 3).astype(U64), np.full(len(pairs), 3, U64), np.ones(len(every) - len(hashes) - len(pairs), U64)]).astype(U64)
    owner = np.concatenate([owner, owner[1:][same], *gram_owner]).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return every[order], weight[order], owner[order]


def simhash(texts: list[str | None]) -> np.ndarray:
    """Each text's fingerprint as a row of bytes."""
    out = np.zeros((len(texts), BITS // 8), dtype=np.uint8)
    terms, weight, owner = _terms(texts)
    if not len(terms):
        return out
    hashed = np.stack([mix(terms ^ U64(0x2545F4914F6CDD1D * (i + 1) % 2**64)) for i in range(BITS // 64)], axis=1)
    per_text = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    # Sums of up to 64 terms fit into a byte for each bit.
    segment = (np.arange(len(terms)) - first[owner]) // _SEGMENT
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(segment) != 0))))
    votes = np.zeros((len(starts), BITS), dtype=np.uint8)
    for lo in range(0, len(starts), 256):
        a, b = starts[lo], starts[lo + 256] if lo + 256 < len(starts) else len(terms)
        spread = _BITS_OF[hashed[a:b].view(np.uint8)] * weight[a:b, None]
        votes[lo : lo + 256] = np.add.reduceat(spread, starts[lo : lo + 256] - a, axis=0).view(np.uint8)
    text_of = owner[starts]
    begin = np.flatnonzero(np.concatenate(([True], np.diff(text_of) != 0)))
    total = np.add.reduceat(votes, begin, axis=0, dtype=np.int64)
    full = np.bincount(owner, weights=weight, minlength=len(texts))[text_of[begin]]
    out[text_of[begin]] = np.packbits(2 * total > full[:, None], axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, 0 for opposite ones, about a half for unrelated ones."""
    return 1.0 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        found = [simhash(texts[s]) for s in together(batch["text"])]
        raw = [x.tobytes() for rows in found for x in rows]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (16 bytes) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint, "doc_id long, fingerprint binary")


# Search


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All (query_fingerprint, fingerprint, distance) of distinct fingerprints at most ``radius`` bits apart.

    Of ``blocks`` blocks of bits, ``radius`` wrong bits leave ``blocks - radius``
    alike. A table for each choice of so many blocks brings them to the front, as
    its key; the join over all tables meets each pair at least once, and counting
    bits confirms. A pair is kept only from its first table, so none repeats.
    Equal fingerprints meet once, however many documents have them.
    """
    blocks = blocks or radius + 2
    if not radius < blocks <= 64:
        raise ValueError("blocks must be more than the radius")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << (BITS - edges[i])) - (1 << (BITS - edges[i + 1])) for i in table) for table in combinations(range(blocks), blocks - radius)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def keyed(frame, name):
        halves = frame.select(F.col("fingerprint").alias(name)).distinct().select(name, *[F.conv(F.hex(F.substring(name, lo, 8)), 16, -10).cast("long").alias(f"{name}_{lo}") for lo in (1, 9)])
        keys = [F.xxhash64(F.lit(t), F.col(f"{name}_1").bitwiseAND(F.lit(signed(m >> 64))), F.col(f"{name}_9").bitwiseAND(F.lit(signed(m & (1 << 64) - 1)))) for t, m in enumerate(masks)]
        return halves.select(name, f"{name}_1", f"{name}_9", F.posexplode(F.array(*keys)).alias("table", "key"))

    a, b = keyed(queries, "query_fingerprint"), keyed(fingerprints, "fingerprint")
    apart = [F.col(f"query_fingerprint_{lo}").bitwiseXOR(F.col(f"fingerprint_{lo}")) for lo in (1, 9)]
    distance = F.bit_count(apart[0]) + F.bit_count(apart[1])
    # The first table in which a pair meets: all its blocks are alike there.
    alike = [(apart[0].bitwiseAND(F.lit(signed(m >> 64))) == 0) & (apart[1].bitwiseAND(F.lit(signed(m & (1 << 64) - 1))) == 0) for m in masks]
    first = F.coalesce(*[F.when(x, t) for t, x in enumerate(alike)])
    met = a.join(b, (a["table"] == b["table"]) & (a["key"] == b["key"]) & (distance <= radius) & (a["table"] == first))
    return met.select("query_fingerprint", "fingerprint", distance.cast("int").alias("distance"))


#: Of the registered query: the radius, and which documents ask for their neighbours.
RADIUS, EVERY = 3, 50


def with_neighbours(marked: DataFrame, radius: int = RADIUS, every: int = EVERY) -> DataFrame:
    """The rows (doc_id, fingerprint in hexadecimal, more) with ``near_fingerprints``: for ids divisible by ``every``, how many other distinct fingerprints of all rows are within the radius; null for the rest."""
    marked = written(marked)
    # A document without terms has no neighbours to look for.
    prints = marked.where(F.col("fingerprint") != "0" * (BITS // 4)).select("doc_id", F.unhex("fingerprint").alias("fingerprint"))
    found = within(prints.where(F.col("doc_id") % every == 0).select("fingerprint"), prints.select("fingerprint"), radius)
    counted = found.where("distance > 0").groupBy("query_fingerprint").agg(F.count(F.lit(1)).alias("n")).select(F.lower(F.hex("query_fingerprint")).alias("asked"), "n")
    asks = F.col("doc_id") % every == 0
    rows = marked.withColumn("asked", F.when(asks, F.col("fingerprint")))
    # The rest have a null to join on, and meet nothing.
    some = rows.where("asked is not null").join(counted, "asked", "left").withColumn("near_fingerprints", F.coalesce("n", F.lit(0).cast("long"))).drop("asked", "n")
    return some.unionAll(rows.where("asked is null").drop("asked").withColumn("near_fingerprints", F.lit(None).cast("long")))


# Edited texts

#: Bytes of text in a range, about; there are as many ranges as shuffle partitions at least.
RANGE_BYTES = 128 << 20
#: Rows sampled to place a range's beginning; fewer where all ranges' would be more than the driver should hold.
_PER_RANGE, _SAMPLED = 40, 2_000_000
_DEALT = "range int, tail boolean, doc_id long, tie long, text string, fingerprint binary"
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _place(ids: np.ndarray, ties: np.ndarray) -> list[tuple]:
    """Sorts ascending in the order of documents: descending id, nulls (and only they have a leading 1) last, then the tie."""
    return [(0, -i, t) if i is not None else (1, 0, t) for i, t in zip(ids, ties, strict=True)]


def _deal(begins: list[tuple]):
    from bisect import bisect_right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {b: i for i, b in enumerate(begins)}
        for batch in batches:
            texts = batch["text"].to_pylist()
            for s in together(batch["text"]):
                part = batch.slice(s.start, s.stop - s.start)
                places = _place(part["doc_id"].to_pylist(), part["tie"].to_pylist())
                raw = [x.tobytes() for x in simhash(texts[s])]
                to = [bisect_right(begins, p) - 1 for p in places]
                copied = [i for i, p in enumerate(places) if p in first]
                rows = part.take(pa.array([*range(len(places)), *copied]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*to, *((to[i] - 1) % len(begins) for i in copied)], pa.int32()),
                        pa.array([False] * len(places) + [True] * len(copied)),
                        rows["doc_id"],
                        rows["tie"],
                        rows["text"],
                        pa.array([*raw, *(raw[i] for i in copied)], pa.binary()),
                    ],
                    names=["range", "tail", "doc_id", "tie", "text", "fingerprint"],
                )

    return run


def edited(text: str, following: str) -> str:
    """The last half of the characters (the smaller half) replaced by as many of the next text's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range in order, a range's tail at its end: each row meets the one after it."""
    names = [x.split()[0] for x in EDITED.split(", ")]

    def flush(rows):
        changed = [edited(t, nt) for _, t, _, nt, _ in rows]
        new = simhash(changed)
        own = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(-1, BITS // 8)
        after = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8).reshape(-1, BITS // 8)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([r[2].hex() for r in rows]),
                pa.array([x.tobytes().hex() for x in new]),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, after)),
            ],
            names=names,
        )

    waiting, held, before = [], 0, None
    for batch in batches:
        for at, tail, doc_id, text, mark in zip(batch["range"].to_pylist(), batch["tail"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], batch["fingerprint"].to_pylist(), strict=True):
            text = text.as_py() or ""
            if before and before[0] == at:
                waiting.append((before[1], before[2], before[3], text, mark))
                held += len(before[2]) + 64
                if held > _TOGETHER:
                    yield flush(waiting)
                    waiting, held = [], 0
            # A tail only follows; copies of it have the same id and text.
            before = None if tail else (at, doc_id, text, mark)
    if waiting:
        yield flush(waiting)


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """The rows of ``EDITED``: for each document its fingerprint and its edited text's, and how alike they and the next document's are."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "tie")).alias("first")).first()
    if not size["n"]:
        return spark.createDataFrame([], EDITED)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // RANGE_BYTES))
    every = max(1, size["n"] // (ranges * max(2, min(_PER_RANGE, _SAMPLED // ranges))))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    sample = rows.select("doc_id", "tie").where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(every)) == 0).distinct().collect()
    null, minus, tie = size["first"]
    begin = [(None if null else -minus, tie)]
    places = sorted(set(_place([r[0] for r in sample], [r[1] for r in sample])))
    begins = sorted({*_place([r[0] for r in begin], [r[1] for r in begin]), *(places[len(places) * i // ranges] for i in range(1, ranges) if places)})
    dealt = rows.mapInArrow(_deal(begins), _DEALT).repartitionById(len(begins) or 1, F.col("range"))
    return dealt.sortWithinPartitions("range", "tail", *order).mapInArrow(_compare, EDITED)
