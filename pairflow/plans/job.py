"""Jobs: chains of steps over pairs. A job never changes; every step gives a new one.

Blocks are column functions by default; with a ``schema`` (DDL or StructType of k
and v) they are Python functions. Partitions and partitioner are inherited. They
show in ``map_partitions``, ``each_partition`` and ``dump``, and only there is
the data laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidStep
from ..functions.partitioning import hash_partitioner
from .nodes import Action, Node


class Job:
    """A logical pipeline and the layout of its pairs."""

    def __init__(self, enqueuer: str | None = None):
        self.enqueuer = enqueuer
        self.node: Node | None = None
        self.steps: tuple[Node, ...] = ()

    @property
    def partitions(self) -> int:
        return self.node.partitions if self.node else 0

    @property
    def partitioner(self):
        return self.node.partitioner if self.node else hash_partitioner

    def _step(self, action: Action, *, source: bool = False, partitions: int | None = None, partitioner: Any = None, jobs: int | None = None, enqueuer: str | None = None, **rest) -> Job:
        if not source and self.node is None:
            raise InvalidStep(f"{action.value} needs a source before it")
        if partitions is not None and (not isinstance(partitions, int) or partitions < 1):
            raise InvalidStep("partitions must be a positive number")
        if jobs is not None and jobs < 0:
            raise InvalidStep("jobs must not be negative")
        node = Node(
            action,
            self.partitions if partitions is None else partitions,
            partitioner or self.partitioner,
            parent=None if source else self.node,
            # No more than one job a partition of the input.
            jobs=None if source else self.partitions if jobs is None else min(jobs, self.partitions),
            enqueuer=enqueuer or self.enqueuer,
            **rest,
        )
        out = Job(self.enqueuer)
        out.node, out.steps = node, (*self.steps, node)
        return out

    # Sources

    def parallelize(self, block: Callable[[], Iterable], *, partitions: int, partitioner=None, key: str | T.DataType | None = None, enqueuer: str | None = None, before: Callable | None = None) -> Job:
        """A pair (item, null) for every item of the block, which runs on the driver. Duplicates are kept."""
        return self._step(Action.PARALLELIZE, source=True, partitions=partitions, partitioner=partitioner, enqueuer=enqueuer, before=before, block=block, schema=key)

    def scan(self, frame: Callable | DataFrame, key, value=None, *, partitions: int, partitioner=None, unique: bool = False) -> Job:
        """Pairs from a table's columns. ``unique`` promises that no key comes twice."""
        return self._step(Action.SCAN, source=True, partitions=partitions, partitioner=partitioner, block=frame if callable(frame) and not isinstance(frame, DataFrame) else (lambda spark: frame), options={"key": key, "value": value, "unique": unique})

    def load(self, *, prefix: str, partitions: int, partitioner, schema: str | T.StructType, concurrency: int | None = None, enqueuer: str | None = None) -> Job:
        """The pairs that ``dump`` wrote under the prefix. Spark's readers choose their own concurrency."""
        return self._step(Action.LOAD, source=True, partitions=partitions, partitioner=partitioner, enqueuer=enqueuer, schema=schema, options={"prefix": prefix, "concurrency": concurrency})

    # Steps

    def map(self, block: Callable, *, schema: str | T.StructType | None = None, partitions: int | None = None, partitioner=None, jobs: int | None = None, enqueuer: str | None = None, before: Callable | None = None) -> Job:
        return self._step(Action.MAP, block=block, schema=schema, partitions=partitions, partitioner=partitioner, jobs=jobs, enqueuer=enqueuer, before=before)

    def map_partitions(self, block: Callable, *, schema: str | T.StructType, partitions: int | None = None, partitioner=None, jobs: int | None = None, enqueuer: str | None = None, before: Callable | None = None) -> Job:
        return self._step(Action.MAP_PARTITIONS, block=block, schema=schema, partitions=partitions, partitioner=partitioner, jobs=jobs, enqueuer=enqueuer, before=before)

    def reduce(self, block: Callable | str, *, python: bool = False, jobs: int | None = None, enqueuer: str | None = None, before: Callable | None = None) -> Job:
        """A native aggregate by name, a column block, or a Python block."""
        return self._step(Action.REDUCE, block=block, jobs=jobs, enqueuer=enqueuer, before=before, options={"python": python})

    def combine(self, other: Job, block: Callable, *, schema: str | T.StructType | None = None, on_duplicate: str = "error", jobs: int | None = None, enqueuer: str | None = None, before: Callable | None = None) -> Job:
        return self._step(Action.COMBINE, other=_node(other), block=block, schema=schema, jobs=jobs, enqueuer=enqueuer, before=before, options={"on_duplicate": on_duplicate})

    def append(self, other: Job, *, jobs: int | None = None, enqueuer: str | None = None, before: Callable | None = None) -> Job:
        return self._step(Action.APPEND, other=_node(other), jobs=jobs, enqueuer=enqueuer, before=before)

    def repartition(self, *, partitions: int, partitioner=None, jobs: int | None = None, enqueuer: str | None = None, before: Callable | None = None) -> Job:
        """The same pairs in another layout."""
        return self._step(Action.MAP, block=lambda k, v: (k, v), partitions=partitions, partitioner=partitioner, jobs=jobs, enqueuer=enqueuer, before=before, options={"moved": True})

    # Sinks

    def each_partition(self, block: Callable, *, jobs: int | None = None, enqueuer: str | None = None, before: Callable | None = None) -> Job:
        return self._step(Action.EACH_PARTITION, block=block, jobs=jobs, enqueuer=enqueuer, before=before)

    def dump(self, *, prefix: str, enqueuer: str | None = None) -> Job:
        return self._step(Action.DUMP, enqueuer=enqueuer, options={"prefix": prefix})

    # Idioms, in native form

    def _derived(self, apply: Callable, other: Job | None = None, *, unique: bool = False) -> Job:
        return self._step(Action.DERIVED, other=_node(other) if other is not None else None, block=apply, options={"unique": unique})

    def filter(self, condition: Callable) -> Job:
        return self._derived(lambda f: f.where(condition(F.col("k"), F.col("v"))), unique=bool(self.node and self.node.unique))

    def map_values(self, block: Callable) -> Job:
        return self._derived(lambda f: f.select("k", block(F.col("v")).alias("v")), unique=bool(self.node and self.node.unique))

    def flat_map(self, items: Callable) -> Job:
        """A pair (key, value) for each element of an array column of structs."""
        return self.map(items)

    def _aggregated(self, column) -> Job:
        return self._derived(lambda f: f.groupBy("k").agg(column.alias("v")), unique=True)

    def count(self) -> Job:
        return self._aggregated(F.count(F.lit(1)))

    def sum(self) -> Job:
        return self._aggregated(F.sum("v"))

    def min(self) -> Job:
        return self._aggregated(F.min("v"))

    def max(self) -> Job:
        return self._aggregated(F.max("v"))

    def average(self) -> Job:
        return self._aggregated(F.avg("v"))

    def collect(self) -> Job:
        """All values of a key, sorted. A key's values must fit into a task."""
        return self._aggregated(F.array_sort(F.collect_list("v")))

    def distinct_keys(self) -> Job:
        return self._derived(lambda f: f.select("k").distinct().withColumn("v", F.lit(None).cast("string")), unique=True)

    def top(self, n: int, order: Callable | None = None) -> Job:
        """The first ``n`` pairs by an order on (k, v), keys by default."""
        return self._derived(lambda f: f.orderBy(*(order(F.col("k"), F.col("v")) if order else [F.col("k")])).limit(n))

    def inner(self, other: Job) -> Job:
        """(k, (left, right)) of keys on both sides; both may have a key several times."""
        return self._joined(other, "inner")

    def left_outer(self, other: Job) -> Job:
        return self._joined(other, "left")

    def full_outer(self, other: Job) -> Job:
        return self._joined(other, "full")

    def _joined(self, other: Job, how: str) -> Job:
        from ..operators.combine import joined

        return self._derived(lambda a, b: joined(a, b, how).select("k", F.struct(F.col("left").alias("_1"), F.col("right").alias("_2")).alias("v")), other)

    def semi(self, other: Job) -> Job:
        return self._halved(other, "left_semi")

    def anti(self, other: Job) -> Job:
        return self._halved(other, "left_anti")

    def _halved(self, other: Job, how: str) -> Job:
        return self._derived(lambda a, b: a.join(b.select(F.col("k").alias("_rk")), F.col("k").eqNullSafe(F.col("_rk")), how), other, unique=bool(self.node and self.node.unique))

    def union_distinct(self, other: Job) -> Job:
        return self._derived(lambda a, b: a.union(b).distinct(), other)

    def intersect(self, other: Job) -> Job:
        return self._derived(lambda a, b: a.intersect(b), other)

    def subtract(self, other: Job) -> Job:
        return self._derived(lambda a, b: a.subtract(b), other)

    def rollup(self, *parts: Callable) -> Job:
        """Sums over the prefixes of a key's parts: the key becomes the tuple of the parts, null where rolled up, and a last part that tells the depth."""
        names = [f"_{i}" for i in range(1, len(parts) + 1)]

        def apply(f):
            rows = f.select(*[p(F.col("k")).alias(n) for p, n in zip(parts, names, strict=True)], "v")
            out = rows.rollup(*names).agg(F.sum("v").alias("v"), F.grouping_id().cast("int").alias("_g"))
            return out.select(F.struct(*names, F.col("_g").alias(f"_{len(names) + 1}")).alias("k"), "v")

        return self._derived(apply, unique=True)

    def to_df(self, spark) -> DataFrame:
        """The job's pairs as a lazy frame; sinks on the way run at once. ``together`` gives several jobs' frames."""
        from .compiler import Compiler

        return Compiler(spark).frame(_node(self))


@contextmanager
def together(spark, *jobs: Job) -> Iterator[list[DataFrame]]:
    """The frames of several jobs. Steps that they share are computed once, and kept until the block ends."""
    from .compiler import Compiler

    nodes = [_node(job) for job in jobs]
    compiler = Compiler(spark, nodes)
    try:
        yield [compiler.frame(node) for node in nodes]
    finally:
        compiler.release()


def _node(job: Job) -> Node:
    if job.node is None:
        raise InvalidStep("the job has no step")
    return job.node
