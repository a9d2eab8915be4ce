"""Combine and append: a left outer join with a right side of unique keys, and a union that keeps duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IncompatibleFrame, InvalidStep
from .map import emitted_columns
from .rows import batches_of, drained, pairs_of

#: What to do about a key that the right side has more than once.
ON_DUPLICATE = ("error", "min", "max", "any")


def check_partitions(left: int, right: int) -> None:
    if left != right:
        raise IncompatibleFrame(f"{left} and {right} partitions")


def unique_right(right: DataFrame, unique: bool, on_duplicate: str) -> DataFrame:
    """One pair a key. A side known to be unique stays as it is; else duplicates fail the run, or the chosen one counts."""
    if unique:
        return right
    if on_duplicate not in ON_DUPLICATE:
        raise InvalidStep(f"on_duplicate must be one of {', '.join(ON_DUPLICATE)}")
    if on_duplicate == "error":
        counted = right.groupBy("k").agg(F.any_value("v").alias("v"), F.count(F.lit(1)).alias("_n"))
        wrong = F.raise_error(F.concat(F.lit("duplicate key in combine: "), F.coalesce(F.to_json(F.struct("k")), F.lit("null"))))
        # The check is part of the value, so that no optimisation can drop it.
        return counted.select("k", F.when(F.col("_n") == 1, F.col("v")).otherwise(wrong.cast(right.schema["v"].dataType)).alias("v"))
    return right.groupBy("k").agg({"min": F.min, "max": F.max, "any": F.any_value}[on_duplicate]("v").alias("v"))


def joined(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """(k, left, right); null keys are equal. Right values of ``how='full'`` keep their keys."""
    a = left.select(F.col("k").alias("_lk"), F.col("v").alias("left"), F.lit(True).alias("_l"))
    b = right.select(F.col("k").alias("_rk"), F.col("v").alias("right"), F.lit(True).alias("_r"))
    out = a.join(b, a["_lk"].eqNullSafe(b["_rk"]), how)
    key = F.when(F.col("_l"), F.col("_lk")).otherwise(F.col("_rk")) if how in ("right", "full", "outer") else F.col("_lk")
    return out.select(key.alias("k"), "left", "right")


def combine_columns(pairs: DataFrame, block: Callable) -> DataFrame:
    """``block(k, left, right)`` on columns, with emits as in map."""
    return emitted_columns(pairs, block(F.col("k"), F.col("left"), F.col("right")))


def combine_python(pairs: DataFrame, block: Callable, schema: T.StructType, before: Callable | None = None) -> DataFrame:
    given = pairs.schema

    def run(batches):
        if before:
            before()
        yield from batches_of((pair for k, left, right in pairs_of(batches, given) for pair in drained(block(k, left, right))), schema)

    return pairs.mapInArrow(run, schema)


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of both, duplicates too."""
    return left.unionAll(right)
