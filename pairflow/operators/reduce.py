"""Reduce: one pair a key, its values folded by an associative and commutative block.

A key with one value keeps it untouched. There are three ways. Names of
aggregates (``sum``, ``min`` ...) become native ones, with partial sums before the
shuffle, and so do column blocks that only add, take the larger or the smaller, or
do so field by field of a struct. Other column blocks fold in the JVM in two steps
with a shuffle each: first what one task had of a key, so that no list is longer
than a task's rows, then what is left of the key. Python blocks fold in each task before the shuffle, then as a stream over
sorted keys, so that no key's values are ever held together.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidStep
from .rows import batches_of, drained, pairs_of

#: Native folds whose result on values is that of folding them by twos; null if any pairwise step would see only nulls.
NATIVE = {"sum": F.sum, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor, "any": F.any_value}
#: Keys that a task folds in memory before it hands them on.
HELD_KEYS = 100_000


def reduce_native(frame: DataFrame, name: str) -> DataFrame:
    if name not in NATIVE:
        raise InvalidStep(f"no native reduce is called {name}; there are {', '.join(NATIVE)}")
    kind = frame.schema["v"].dataType
    out = frame.groupBy("k").agg(NATIVE[name]("v").alias("v"))
    return out.withColumn("v", F.col("v").cast(kind)) if out.schema["v"].dataType != kind else out


def _optimized(probe: DataFrame, column: Column) -> str:
    """What Catalyst makes of a column, without the numbers of attributes."""
    plan = probe.select(column.alias("out"))._jdf.queryExecution().optimizedPlan().toString()
    return re.sub(r"#\d+L?", "", plan.split("\n")[0])


def known_fold(schema: T.StructType, block: Callable) -> Column | None:
    """The native aggregate that a column block amounts to, if it only adds numbers or picks the larger or smaller; else None.

    Adding is null as soon as one of several values is, as folding would be.
    """
    kind = schema["v"].dataType
    spark = SparkSession.getActiveSession()
    probe = spark.createDataFrame(spark.sparkContext.emptyRDD(), T.StructType([T.StructField("k", schema["k"].dataType), T.StructField("l", kind), T.StructField("r", kind)]))
    made = block(F.col("k"), F.col("l"), F.col("r"))
    if not isinstance(made, Column):
        return None

    def one(made: Column, left: Column, right: Column, value: Column, kind: T.DataType) -> Column | None:
        own = _optimized(probe, made)
        numbers = isinstance(kind, T.IntegralType | T.FractionalType) and not isinstance(kind, T.DecimalType)
        for x, y in ((left, right), (right, left)):
            if numbers and own == _optimized(probe, x + y):
                return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value)).cast(kind)
            for pick, native in ((F.greatest, F.max), (F.least, F.min)):
                if isinstance(kind, T.AtomicType) and own == _optimized(probe, pick(x, y)):
                    return native(value)
        return None

    whole = one(made, F.col("l"), F.col("r"), F.col("v"), kind)
    if whole is not None or not isinstance(kind, T.StructType) or probe.select(made.alias("out")).schema["out"].dataType.simpleString() != kind.simpleString():
        return whole
    fields = [one(made[f.name], F.col("l")[f.name], F.col("r")[f.name], F.col("v")[f.name], f.dataType) for f in kind.fields]
    # A null struct has null fields, but as one value it must stay null.
    return None if any(f is None for f in fields) else F.when((F.count(F.lit(1)) > 1) | (F.count("v") == 1), F.struct(*[f.alias(x.name) for f, x in zip(fields, kind.fields, strict=True)]))


def reduce_columns(frame: DataFrame, block: Callable) -> DataFrame:
    """``block(k, left, right)`` on columns. Values are boxed, since lists of values would drop nulls."""
    native = known_fold(frame.schema, block)
    if native is not None:
        return frame.groupBy("k").agg(native.alias("v"))

    def fold(rows: DataFrame) -> DataFrame:
        first = F.element_at("_all", 1)["v"]
        rest = F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0)))
        return rows.select("k", F.aggregate(rest, first, lambda left, x: block(F.col("k"), left, x["v"])).alias("v"))

    by_task = frame.withColumn("_task", F.spark_partition_id()).groupBy("k", "_task").agg(F.collect_list(F.struct("v")).alias("_all"))
    return fold(fold(by_task).groupBy("k").agg(F.collect_list(F.struct("v")).alias("_all")))


def _hashable(key):
    return tuple(_hashable(x) for x in key) if isinstance(key, list | tuple) else key


def reduce_python(frame: DataFrame, block: Callable, before: Callable | None = None) -> DataFrame:
    """``block(k, left, right)`` on Python values."""
    schema = frame.schema

    def call(k, left, right):
        out = block(k, left, right)
        return next(iter([*drained(_one(out))])) if hasattr(out, "__await__") else out

    def partial(batches):
        if before:
            before()
        held: dict = {}
        for k, v in pairs_of(batches, schema):
            at = _hashable(k)
            held[at] = (k, call(k, held[at][1], v)) if at in held else (k, v)
            if len(held) >= HELD_KEYS:
                yield from batches_of(held.values(), schema)
                held = {}
        yield from batches_of(held.values(), schema)

    def stream(batches):
        if before:
            before()

        def pairs():
            now = None
            for k, v in pairs_of(batches, schema):
                if now is not None and _hashable(now[0]) == _hashable(k):
                    now = (now[0], call(k, now[1], v))
                    continue
                if now is not None:
                    yield now
                now = (k, v)
            if now is not None:
                yield now

        yield from batches_of(pairs(), schema)

    return frame.mapInArrow(partial, schema).repartition("k").sortWithinPartitions("k").mapInArrow(stream, schema)


async def _one(out):
    return [await out]
