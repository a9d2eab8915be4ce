"""Map and side effects by partition: every partition, empty ones too, with its number and its pairs in order of keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.partitioning import layout
from .rows import batches_of, drained, pairs_of


def _number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def map_partitions(frame: DataFrame, block: Callable, schema: T.StructType, n: int, partitioner, before: Callable | None = None) -> DataFrame:
    """``block(partition, pairs)`` streams over a partition; its output is any iterable of pairs."""
    given = frame.schema

    def run(batches):
        if before:
            before()
        yield from batches_of(drained(block(_number(), pairs_of(batches, given))), schema)

    return layout(frame, n, partitioner).mapInArrow(run, schema)


def each_partition(frame: DataFrame, block: Callable, n: int, partitioner, before: Callable | None = None) -> None:
    """Runs ``block(partition, pairs)`` for its effects, at least once a partition: failed tasks run again."""
    given = frame.schema

    def run(batches):
        if before:
            before()
        number, pairs = _number(), pairs_of(batches, given)
        for _ in drained(block(number, pairs)) or ():
            pass
        for _ in pairs:  # what the block left unread
            pass
        return iter(())

    layout(frame, n, partitioner).mapInArrow(run, given).write.format("noop").mode("overwrite").save()
