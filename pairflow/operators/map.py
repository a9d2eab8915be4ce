"""Map: every pair gives none, one or many pairs.

A column block ``fn(k, v)`` returns emits: ``(k, v)`` or ``(k, v, condition)`` tuples
of columns, or one array column of structs (k, v). Catalyst sees all of it. A
Python block with a declared schema returns any iterable of pairs and runs over
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import batches_of, drained, pairs_of


def emitted_columns(frame: DataFrame, emits, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows that some emits give."""
    if isinstance(emits, Column):
        return frame.select(F.inline(emits).alias("k", "v"))
    emits = [emits] if isinstance(emits, tuple) else list(emits)
    emits = [(e[0], F.lit(None) if e[1] is None else e[1], *e[2:]) for e in emits]
    if not emits:
        return frame.select("k", "v").limit(0)
    if len(emits) == 1:
        k, v, *when = emits[0]
        out = frame.where(when[0]) if when else frame
        return out.select(k.alias("k"), v.alias("v"))
    made = [F.struct(e[0].alias("k"), e[1].alias("v")) if len(e) == 2 else F.when(e[2], F.struct(e[0].alias("k"), e[1].alias("v"))) for e in emits]
    pairs = F.array(*made)
    if any(len(e) > 2 for e in emits):
        pairs = F.filter(pairs, lambda x: x.isNotNull())
    return frame.select(F.inline(pairs).alias("k", "v"))


def map_columns(frame: DataFrame, block: Callable) -> DataFrame:
    return emitted_columns(frame, block(F.col("k"), F.col("v")))


def map_python(frame: DataFrame, block: Callable, schema: T.StructType, before: Callable | None = None) -> DataFrame:
    given = frame.schema

    def run(batches):
        if before:
            before()
        yield from batches_of((pair for k, v in pairs_of(batches, given) for pair in drained(block(k, v))), schema)

    return frame.mapInArrow(run, schema)


def hooked(before: Callable | None) -> None:
    """For steps without Python in their tasks: ``before`` runs where the block does, on the driver, once, when the step is compiled.

    Python blocks run it at the start of every task themselves.
    """
    if before:
        before()
