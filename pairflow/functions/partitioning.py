"""Partitioners: functions of a key and a number of partitions, and the layout that they give.

A partitioner is ``(k, n) -> Column`` over the key's column. The layout is only
made where partitions can be seen; groupings and joins shuffle as they like.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import canonical, canonical_json

Partitioner = Callable[[Column, int], Column]
#: Hexadecimal digits of the SHA-1 that the hash partitioner reads.
DIGITS = 5


class HashPartitioner:
    """The default: the first digits of the SHA-1 of the key's canonical JSON, modulo the partitions."""

    def column(self, key: Column, n: int, kind) -> Column:
        if n <= 0:
            raise ValueError("the number of partitions must be positive")
        head = F.substring(F.sha1(F.encode(canonical_json(key, kind), "UTF-8")), 1, DIGITS)
        return (F.conv(head, 16, 10).cast("int") % n).cast("int")

    def __call__(self, key: Any, n: int) -> int:
        """The same for a Python key."""
        if n <= 0:
            raise ValueError("the number of partitions must be positive")
        return int(hashlib.sha1(canonical(key).encode()).hexdigest()[:DIGITS], 16) % n


hash_partitioner = HashPartitioner()


def identity_partitioner(key: Column, n: int) -> Column:
    """For keys that are partition numbers."""
    return key.cast("int")


def partition_of(frame: DataFrame, n: int, partitioner, key: str = "k") -> Column:
    """The partition of each row. A number outside 0 to n - 1 raises an error when the row is reached."""
    if isinstance(partitioner, HashPartitioner):
        return partitioner.column(F.col(key), n, frame.schema[key].dataType)
    p = partitioner(F.col(key), n).cast("int")
    wrong = F.raise_error(F.concat(F.lit("partition out of range: "), F.coalesce(p.cast("string"), F.lit("null"))))
    return F.when(p.between(0, n - 1), p).otherwise(wrong.cast("int"))


def layout(frame: DataFrame, n: int, partitioner) -> DataFrame:
    """Exactly ``n`` partitions, empty ones too, each sorted by key."""
    placed = frame.withColumn("_p", partition_of(frame, n, partitioner))
    return placed.repartitionById(n, F.col("_p")).sortWithinPartitions("k").drop("_p")
