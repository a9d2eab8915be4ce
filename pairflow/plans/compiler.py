"""Compiles plan nodes to frames: each node once, whoever uses it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidAction
from ..functions.keys import check_key
from ..operators import combine, map, partitions, reduce
from ..sources import pairs
from .nodes import SINKS, Action, Node, pair_schema


def reachable(nodes: Iterable[Node]) -> list[Node]:
    """All nodes below these, inputs first, each once."""
    out, seen = [], set()
    stack = [(n, False) for n in reversed(list(nodes))]
    while stack:
        node, ready = stack.pop()
        if ready:
            out.append(node)
        elif node not in seen:
            seen.add(node)
            stack.append((node, True))
            stack += [(x, False) for x in reversed(node.inputs) if x not in seen]
    return out


@contextmanager
def in_pool(spark: SparkSession, name: str | None) -> Iterator[None]:
    """Spark's jobs of this thread run in the scheduler pool, if one is named; afterwards in that of before."""
    context, key = spark.sparkContext, "spark.scheduler.pool"
    before = context.getLocalProperty(key)
    if name:
        context.setLocalProperty(key, name)
    try:
        yield
    finally:
        if name:
            context.setLocalProperty(key, before)


class Compiler:
    """Frames by node. Nodes that several steps use, or that a sink hands on, are kept until ``release``."""

    def __init__(self, spark: SparkSession, roots: Iterable[Node] = ()):
        self.spark = spark
        self.frames: dict[Node, DataFrame] = {}
        self.kept: list[DataFrame] = []
        self.uses: Counter[Node] = Counter()
        roots = list(roots)
        for node in reachable(roots):
            self.uses.update(node.inputs)
        self.uses.update(roots)

    def frame(self, node: Node) -> DataFrame:
        for n in reachable([node]):
            if n not in self.frames:
                self.frames[n] = self._kept(n, self._compiled(n))
        return self.frames[node]

    def _kept(self, node: Node, frame: DataFrame) -> DataFrame:
        if self.uses[node] < 2 or node.action in SINKS or node.action in (Action.SCAN, Action.LOAD):
            return frame
        out = frame.persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.append(out)
        if node.enqueuer:
            # A shared step with a pool of its own does its work now, in that pool, and not in its first user's.
            with in_pool(self.spark, node.enqueuer):
                _drained(out)
        return out

    def release(self) -> None:
        for frame in self.kept:
            frame.unpersist()
        self.kept.clear()

    def _compiled(self, node: Node) -> DataFrame:
        inputs = [self.frames[n] for n in node.inputs]
        # Sinks run here, and whatever else compiling needs to run.
        with in_pool(self.spark, node.enqueuer):
            out = getattr(self, f"_{node.action.value}", self._unknown)(node, *inputs)
        if node.action not in SINKS:
            check_key(out.schema["k"].dataType)
        return out

    def _unknown(self, node: Node, *inputs) -> DataFrame:
        raise InvalidAction(str(node.action))

    def _parallelize(self, node: Node) -> DataFrame:
        kind = T.StructType.fromDDL(f"k {node.schema}")["k"].dataType if isinstance(node.schema, str) else node.schema
        map.hooked(node.before)
        return pairs.from_items(self.spark, node.block(), kind)

    def _scan(self, node: Node) -> DataFrame:
        return pairs.scan(node.block(self.spark), node.options["key"], node.options["value"])

    def _load(self, node: Node) -> DataFrame:
        return pairs.load(self.spark, node.options["prefix"], node.partitions, pair_schema(node.schema))

    def _map(self, node: Node, frame: DataFrame) -> DataFrame:
        if node.schema is not None:
            return map.map_python(frame, node.block, pair_schema(node.schema), node.before)
        map.hooked(node.before)
        return map.map_columns(frame, node.block)

    def _map_partitions(self, node: Node, frame: DataFrame) -> DataFrame:
        # The block sees the layout of the step before; its own is that of its output.
        return partitions.map_partitions(frame, node.block, pair_schema(node.schema), node.parent.partitions, node.parent.partitioner, node.before)

    def _reduce(self, node: Node, frame: DataFrame) -> DataFrame:
        if node.options["python"]:
            return reduce.reduce_python(frame, node.block, node.before)
        map.hooked(node.before)
        return reduce.reduce_native(frame, node.block) if isinstance(node.block, str) else reduce.reduce_columns(frame, node.block)

    def _combine(self, node: Node, left: DataFrame, right: DataFrame) -> DataFrame:
        combine.check_partitions(node.parent.partitions, node.other.partitions)
        right = combine.unique_right(right, node.other.unique, node.options["on_duplicate"])
        joined = combine.joined(left, right)
        if node.schema is not None:
            return combine.combine_python(joined, node.block, pair_schema(node.schema), node.before)
        map.hooked(node.before)
        return combine.combine_columns(joined, node.block)

    def _append(self, node: Node, left: DataFrame, right: DataFrame) -> DataFrame:
        combine.check_partitions(node.parent.partitions, node.other.partitions)
        map.hooked(node.before)
        return combine.append(left, right)

    def _derived(self, node: Node, *inputs: DataFrame) -> DataFrame:
        if len(inputs) > 1:
            combine.check_partitions(node.parent.partitions, node.other.partitions)
        return node.block(*inputs)

    def _each_partition(self, node: Node, frame: DataFrame) -> DataFrame:
        partitions.each_partition(frame, node.block, node.partitions, node.partitioner, node.before)
        return frame

    def _dump(self, node: Node, frame: DataFrame) -> DataFrame:
        pairs.dump(frame, node.options["prefix"], node.partitions, node.partitioner)
        return frame

    def evaluate(self, node: Node) -> None:
        """Runs a node for its effects: all of it, without keeping a row."""
        with in_pool(self.spark, node.enqueuer):
            _drained(self.frame(node))


def _drained(frame: DataFrame) -> None:
    frame.select(F.struct("*")).write.format("noop").mode("overwrite").save()
