"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A document is the set of its distinct shingles of five words. Equal sets are one
node. A node's signature has ``symbols`` symbols of 16 bits, one per MinHash.
Signatures are split into ``chunks`` chunks. If two differ in at most
``distance`` symbols, then by the pigeonhole principle some chunk differs in at
most ``distance // chunks`` (one) symbol: each node enumerates every chunk with
each of its symbols left out, and such pairs are sure to meet in an equi-join.
Whatever meets and is near enough by signature is confirmed on the full sets.
From which similarity two documents link is a parameter (``Contract``): 0.85 for
the op2 query (``QUERY``), 0.8 for the pipeline's stage (``STAGE``).

No bucket's pairs are all written out. Each member meets its bucket's most central
node, the one whose buckets have the most members; links confirmed so make
components. A bucket that is left with several meets the hub ``h``, the most central
node of its largest component. Let ``D(a)`` be the shingles in which ``a`` and ``h``
differ. Two members differ in ``|D(a)| + |D(b)| - 2 |D(a) & D(b)|`` shingles, and they
link if that is at most ``(PER - least) / (PER + least)`` of ``|a| + |b|``. So with

    weight(a) = (PER + least) |D(a)| - (PER - least) |a|

a link needs ``|D(a) & D(b)| >= (weight(a) + weight(b)) / (2 (PER + least))``, exactly.
If ``a`` is outside the hub's component, that is more than nothing for every ``b``:
such pairs meet on the rarest elements of their differences (a prefix filter, for
each class of weights of ``b``), and only where more than one component has the
element. Copies of one text that are edited apart differ from the hub in elements
of their own, which come first, so they don't meet in pairs; links are lost only
if their signatures are further apart than ``distance`` (``QUERY``: of 64 symbols
0.15 * 64 = 9.6 differ on average at the threshold; more than 27 in about one pair
of 29 million. ``STAGE``: 0.2 * 64 = 12.8; more than 31 in one pair of 12 million).

Documents without words, and null texts, have no set and are their own
component. Fewer than five words are one shingle. Repeated rows are copies. A
null id is never a component's id unless no other is there; such rows are kept
if they have no other document in their component. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, mix, rows_upto, scratch, together, word_hashes, written

SHINGLE = 5
SYMBOLS, CHUNKS, DISTANCE = 64, 14, 27
#: Link if PER * intersection >= LEAST * union.
PER, LEAST = 100, 85


class Contract(NamedTuple):
    """Two documents link if PER * intersection >= least * union; the signatures that find them."""

    least: int = LEAST
    symbols: int = SYMBOLS
    chunks: int = CHUNKS
    distance: int = DISTANCE


QUERY = Contract()
#: The pipeline's stage.
STAGE = Contract(80, 64, 16, 31)
#: A class of weights is this part of the hub's size wide (in shared elements), one element at least.
CLASS_WIDTH = 1 / 64
#: As many links (some 30 bytes each) are joined up into components in one task.
ONE_TASK = 200_000
#: Keys that several nodes have are broadcast up to this many (16 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Ids of documents whose full sets are needed are broadcast up to this many; beyond, a shuffle brings the texts.
BROADCAST_IDS = 1_000_000

_TERM = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**64, STAGE.symbols, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, STAGE.symbols, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, per_text, _ = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - SHINGLE + 1), U64)
    for j, times in enumerate(_TERM):
        rolled += hashes[j : n - SHINGLE + 1 + j] * times if len(rolled) else rolled
    rolled = mix(rolled)
    out, at = [], 0
    for words in per_text.tolist():
        if words >= SHINGLE:
            out.append(np.unique(rolled[at : at + words - SHINGLE + 1]))
        elif words:
            whole = sum((int(h) * int(t) for h, t in zip(hashes[at : at + words], _TERM, strict=False)), words) % 2**64
            out.append(mix(np.array([whole], U64) ^ U64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, U64))
        at += words
    return out


def node_of(shingles: np.ndarray) -> bytes | None:
    """128 bits that name a set: sums of two hashes over its elements. None for the empty set."""
    if not len(shingles):
        return None
    return b"".join(mix(shingles ^ salt).sum(dtype=U64).tobytes() for salt in (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)))


def signatures_of(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """A row of 16-bit symbols for each (non-empty) set."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.stack([np.minimum.reduceat((every ^ x) * t, starts) for x, t in zip(_XOR[:symbols], _TIMES[:symbols], strict=True)], axis=1)
    return (mix(least) >> U64(48)).astype(np.uint16).view(np.int16)


_SIGNED = "doc_id long, tie long, n_shingles long, node binary, signature array<short>"


def _sign(symbols: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in together(batch["text"]):
                part = batch.slice(s.start, s.stop - s.start)
                sets = shingle_sets(part["text"].to_pylist())
                full = [x for x in sets if len(x)]
                rows = iter(signatures_of(full, symbols).tolist() if full else [])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["tie"], pa.array([len(x) for x in sets], pa.int64()), pa.array([node_of(x) for x in sets], pa.binary()), pa.array([next(rows) if len(x) else None for x in sets], pa.list_(pa.int16()))],
                    names=["doc_id", "tie", "n_shingles", "node", "signature"],
                )

    return sign


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in together(batch["text"]):
            sets = shingle_sets(batch["text"].slice(s.start, s.stop - s.start).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])


def _confirm(least: int) -> Callable:
    """Those pairs whose full sets are alike enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["a_set"], batch["b_set"], strict=True):
                x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                common = int(_in(x, y).sum())
                keep.append(PER * common >= least * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep, pa.bool_())), batch["b"].filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return confirm


def _in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y; both sorted."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


_DIFFERENCE = "a binary, hub binary, a_n long, h_n long, common long, apart array<long>"


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles a and its hub share, and those that only one of them has."""
    for batch in batches:
        rows = []
        for a, b in zip(batch["a_set"], batch["b_set"], strict=True):
            x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
            both = _in(x, y)
            rows.append((len(x), len(y), int(both.sum()), np.concatenate((x[~both], y[~_in(y, x)])).view(np.int64)))
        sizes = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *sizes, pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=[x.split()[0] for x in _DIFFERENCE.split(", ")])


def _keys(nodes: DataFrame, contract: Contract = QUERY) -> DataFrame:
    """(key, node): each chunk of the signature without each of its symbols in turn."""
    edges = [contract.symbols * i // contract.chunks for i in range(contract.chunks + 1)]
    symbol = F.col("signature")
    keys = [
        F.xxhash64(F.lit(chunk * contract.symbols + left_out), *[symbol[i] for i in range(lo, hi) if i != left_out])
        for chunk, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
        for left_out in range(lo, hi)
    ]
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def _may_link(a: str, b: str, contract: Contract):
    """Sizes and signatures that allow a link: in SQL over columns n_a, s_a, n_b, s_b."""
    sizes = (F.least(a + "_n", b + "_n") * PER >= F.greatest(a + "_n", b + "_n") * contract.least)
    unequal = F.aggregate(F.zip_with(a + "_s", b + "_s", lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return sizes & (unequal <= contract.distance)


def _as(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("signature").alias(f"{name}_s"))


def _with_sets(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) with their full sets, read again from the text of one document each."""
    need = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    ids = need.join(nodes, "node").select("rep").distinct()
    if rows_upto(ids, BROADCAST_IDS):
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = written(texts.mapInArrow(_full_sets, "node binary, shingles binary").where("node is not null").dropDuplicates(["node"]))
    with_a = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set")), "b")
    return with_b.select("a", "b", "a_set", "b_set")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every edge's nodes with the smallest node that they reach, from all edges."""
    above: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch["root"].to_pylist(), batch["node"].to_pylist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    rows = [(top(x), x) for x in above]
    rows = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(2)], names=["root", "node"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(root, node) of every node of the edges (a, b) but the roots: the smallest node reachable.

    Up to ``one_task`` edges are joined up in one task. More of them are
    contracted in two alternating ways until nothing changes: every node's larger
    neighbours move to its smallest one, then its smaller neighbours do. The
    number of rounds grows with the logarithm of the longest path; each round is
    a table in the shared folder.
    """
    edges = written(edges.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).where("root <> node").distinct())
    if edges.count() <= one_task:
        return written(edges.repartition(1).mapInArrow(_union_find, "root binary, node binary"))
    state = None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("root", "node") % 1_000_000_007)).first()
        if new == state or not new[0]:
            return edges
        state = new
        # Larger neighbours go to the smallest of the neighbourhood.
        both = edges.select(F.col("root").alias("u"), F.col("node").alias("v")).union(edges.select("node", "root"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("root"), F.col("v").alias("node")).distinct()
        # Smaller neighbours and the node itself go to the smallest of them.
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").where("root <> m").select(F.col("m").alias("a"), F.col("root").alias("b"))
        edges = written(small.union(least.select("m", "node")).select(F.col("a").alias("root"), F.col("b").alias("node")).distinct())


def _rooted(frame: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    found = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return frame.join(found, column, "left").withColumn(name, F.coalesce(name, column))


def _links(nodes: DataFrame, docs: DataFrame, contract: Contract) -> DataFrame:
    """(node, root) of all nodes with a link but the roots, as a table."""
    least = contract.least
    # Sets this small are only linked if they are equal.
    able = nodes.where((F.col("n") + 1) * least <= F.col("n") * PER)
    keys = _keys(able, contract)
    # A node has each of its keys once. Numbers are counted in a hash map; anything of the nodes would be sorted.
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    # Most keys are a single node's: where the others are few, their nodes are found without a shuffle of all keys.
    members = written(keys.join(F.broadcast(shared) if shared.count() <= BROADCAST_KEYS else shared, "key").select("key", "node", "size"))
    central = members.groupBy("node").agg(F.struct(F.sum("size").alias("weight"), F.col("node").alias("id")).alias("central"))
    members = written(members.join(central, "node"))
    leaders = members.groupBy("key").agg(F.max("central").alias("leader")).select("key", F.col("leader.id").alias("leader"))

    # Each node with the most central one of each of its buckets.
    star = members.join(leaders, "key").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    star = written(star.join(_as(able, "a"), "a").join(_as(able, "b"), "b").where(_may_link("a", "b", contract)).select("a", "b"))
    edges = written(_with_sets(star, able, docs).mapInArrow(_confirm(least), "a binary, b binary"))
    roots = components(edges)

    # Larger buckets with several components: all members with the hub, the most central node of the largest of them.
    placed = written(_rooted(members, roots, "node", "root"))
    hubs = placed.groupBy("root").agg(F.max("central").alias("hub")).select("root", F.col("hub.id").alias("hub"))
    parts = placed.where("size > 2").groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("root"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    live = written(placed.select("key", "node").join(parts.join(hubs, "root").select("key", "hub"), "key").where("node <> hub"))
    attached = live.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    differences = written(_with_sets(written(attached), able, docs).mapInArrow(_difference, _DIFFERENCE))
    edges = edges.union(differences.where((PER + least) * F.col("common") >= least * (F.col("a_n") + F.col("h_n"))).select("a", F.col("hub").alias("b")))
    roots = components(edges)

    # Nodes outside their hub's component with all that share a rare enough element of their differences from the hub.
    met = _across(differences, roots, least)
    if met is None:
        return roots
    likely = met.join(_as(able, "a"), "a").join(_as(able, "b"), "b").where(_may_link("a", "b", contract)).select("a", "b")
    pairs = written(likely.distinct())
    if pairs.isEmpty():
        return roots
    return components(edges.union(_with_sets(pairs, able, docs).mapInArrow(_confirm(least), "a binary, b binary")))


def _across(differences: DataFrame, roots: DataFrame, least: int) -> DataFrame | None:
    """Pairs (a, b) of nodes of one hub and different components, of which one is outside the hub's, that share as much of their differences as a link needs; some that share less are among them. None if no node is outside."""
    per, off = PER + least, PER - least
    rooted = _rooted(_rooted(differences, roots, "a", "a_root"), roots, "hub", "hub_root")
    # In shared elements: half of (w of a + w of b) are needed.
    weighed = rooted.withColumns({"outside": F.col("a_root") != F.col("hub_root"), "d": F.size("apart"), "w": per * F.size("apart") - off * F.col("a_n")})
    weighed = weighed.withColumn("class", F.floor(F.col("w") / (2 * per * F.greatest(F.lit(1.0), F.col("h_n") * CLASS_WIDTH))).cast("int"))
    # Only hubs that some node is outside of.
    reach = weighed.groupBy("hub").agg(F.min("w").alias("w_all"), F.min(F.when(F.col("outside"), F.col("w"))).alias("w_out")).where("w_out is not null")
    nodes = written(weighed.join(reach, "hub").select("hub", "a", "a_root", "a_n", "d", "w", "class", "outside", "w_all", "w_out", "apart"))
    if nodes.isEmpty():
        return None
    needed = lambda w: F.greatest(F.lit(1), F.ceil((F.col("w") + w) / (2 * per)))
    classes = nodes.groupBy("hub", "class").agg(F.min("w").alias("w_low"), F.max("d").alias("d_high"), F.min("a_n").alias("low"), F.max("a_n").alias("high")).withColumnRenamed("class", "b_class")
    probes = nodes.where("outside").select("hub", "a", "a_n", "d", "w").join(classes, "hub").withColumn("needed", needed(F.col("w_low")))
    sizes = (F.col("high") * PER >= F.col("a_n") * least) & (F.col("low") * least <= F.col("a_n") * PER)
    probes = probes.where(sizes & (F.col("needed") <= F.least("d", "d_high"))).select("hub", "a", "b_class", (F.col("d") - F.col("needed") + 1).alias("prefix"))

    # Each node's elements, the rarest of its hub's first, as far as any partner asks; those of one component only can't be shared across.
    asked = F.col("d") - F.when(F.col("outside"), needed(F.col("w_all"))).otherwise(needed(F.col("w_out"))) + 1
    elements = nodes.withColumn("prefix", asked).where("prefix > 0").select("hub", "a", "a_root", "prefix", F.explode("apart").alias("element"))
    often = elements.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("often"), F.min("a_root").alias("one"), F.max("a_root").alias("other")).where("often > 1").select("hub", "element", "often", (F.col("one") != F.col("other")).alias("across"))
    ranked = elements.join(often, ["hub", "element"], "left").withColumn("rank", F.row_number().over(W.partitionBy("hub", "a").orderBy(F.coalesce("often", F.lit(1)), "element")))
    chosen = written(ranked.where("rank <= prefix and across").select("hub", "a", "element", "rank").join(nodes.drop("apart"), ["hub", "a"]))
    few = chosen.where("outside").join(probes, ["hub", "a"]).where("rank <= prefix").select("hub", "b_class", "element", "a", "a_root", "a_n", F.col("d").alias("a_d"), F.col("w").alias("a_w"))
    indexed = chosen.where(F.col("rank") <= F.col("d") - needed(F.col("w_out")) + 1)
    every = indexed.select("hub", F.col("class").alias("b_class"), "element", F.col("a").alias("b"), F.col("a_root").alias("b_root"), F.col("a_n").alias("b_n"), F.col("d").alias("b_d"), F.col("w").alias("b_w"), F.col("outside").alias("b_outside"))
    may = (F.least("a_n", "b_n") * PER >= F.greatest("a_n", "b_n") * least) & (F.col("a_w") + F.col("b_w") <= 2 * per * F.least("a_d", "b_d"))
    met = few.join(every, ["hub", "b_class", "element"]).where((F.col("a_root") != F.col("b_root")) & may & (~F.col("b_outside") | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(docs: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, tie, n_shingles, node), a tie being the text's hash, and every node's (node, root, rep): its component's smallest node and smallest id."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    signed = written(docs.mapInArrow(_sign(contract.symbols), _SIGNED))
    nodes = written(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("signature").alias("signature")))
    with scratch() as kept:
        roots = _links(nodes, docs, contract)
        kept.append(roots)
    rooted = written(_rooted(nodes.select("node", "rep"), roots, "node", "root"))
    # A table of its own, so that Spark can split the nodes of a large component in the join.
    reps = written(rooted.groupBy("root").agg(F.min("rep").alias("rep")))
    rooted = rooted.select("node", "root").join(reps, "root")
    return signed.drop("signature"), rooted.select("node", "root", "rep")


def near_duplicates(docs: DataFrame, contract: Contract = QUERY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed, rooted = _grouped(docs, contract)
    found = signed.where("node is not null").join(rooted, "node").select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    alone = signed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, contract: Contract = QUERY) -> DataFrame:
    """The table with one document of each component: that with the smallest id (nulls last), then the smallest hash of its text.

    All columns stay as they are. Documents without words are all kept.
    """
    signed, rooted = _grouped(docs, contract)
    placed = written(signed.where("node is not null").join(rooted, "node").select("doc_id", "tie", "root"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "tie")
    first = written(placed.groupBy("root").agg(F.min(place).alias("first")))
    # Of rows that repeat, id and text alike, the one that stays is known by its id and tie only.
    gone_id, gone_tie, again = (_unused(docs.columns, x) for x in ("gone_id", "gone_tie", "again"))
    judged = placed.join(first, "root").groupBy("doc_id", "tie").agg(F.min(place != F.col("first")).alias("gone"), F.count(F.lit(1)).alias("n"))
    marked = written(judged.where("gone or n > 1").select(F.col("doc_id").alias(gone_id), F.col("tie").alias(gone_tie), (~F.col("gone")).alias(again)))
    if rows_upto(marked, BROADCAST_IDS):
        marked = F.broadcast(marked)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(gone_tie))
    left = docs.join(marked, same, "left")
    if marked.where(again).isEmpty():
        return left.where(F.col(gone_tie).isNull()).select(*docs.columns)
    once = left.where(F.col(gone_tie).isNull()).select(*docs.columns)
    return once.unionAll(left.where(again).select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def _unused(columns: list[str], name: str) -> str:
    """The name, with more lines before it if a column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name
