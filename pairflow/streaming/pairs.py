"""Pairs of a stream: map, and reduce by event-time windows, as Structured Streaming.

Column blocks are those of a batch job. A reduce needs a watermark: state of a
window is dropped once the watermark passes its end, so that it stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidStep
from ..operators.map import map_columns
from ..operators.reduce import NATIVE


def stream_map(stream: DataFrame, block: Callable, time: str | None = None) -> DataFrame:
    """``block(k, v)`` over a stream of pairs; a time column goes along."""
    if time is None:
        return map_columns(stream, block)
    emits = block(F.col("k"), F.col("v"))
    if isinstance(emits, tuple):
        emits = [emits]
    if isinstance(emits, list):
        made = [F.struct(e[0].alias("k"), e[1].alias("v")) if len(e) == 2 else F.when(e[2], F.struct(e[0].alias("k"), e[1].alias("v"))) for e in emits]
        emits = F.filter(F.array(*made), lambda x: x.isNotNull())
    return stream.select(F.col(time), F.explode(emits).alias("_p")).select("_p.k", "_p.v", time)


def stream_reduce(stream: DataFrame, name: str, time: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(window start, k, v): the native fold by that name over each key's values in each window of event time."""
    if name not in NATIVE:
        raise InvalidStep(f"no native reduce is called {name}")
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(window.alias("_w"), "k").agg(NATIVE[name]("v").alias("v"))
    return out.select(F.col("_w.start").alias("start"), "k", "v")
