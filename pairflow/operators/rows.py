"""Between Arrow batches and Python pairs: structs with the fields _1, _2 ... are tuples, other structs dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.keys import is_tuple

#: Pairs in an Arrow batch that a Python block fills.
BATCH = 4096


def reader(kind: T.DataType) -> Callable[[Any], Any] | None:
    """How a value from Arrow becomes the Python value; None if it is it already."""
    if isinstance(kind, T.StructType):
        inner = [(f.name, reader(f.dataType)) for f in kind.fields]
        if is_tuple(kind):
            return lambda x: None if x is None else tuple(x[n] if r is None else r(x[n]) for n, r in inner)
        return (lambda x: None if x is None else {n: x[n] if r is None else r(x[n]) for n, r in inner}) if any(r for _, r in inner) else None
    if isinstance(kind, T.ArrayType):
        r = reader(kind.elementType)
        return None if r is None else lambda x: None if x is None else [r(y) for y in x]
    if isinstance(kind, T.MapType):
        return lambda x: None if x is None else dict(x)
    return None


def pairs_of(batches: Iterable[pa.RecordBatch], schema: T.StructType) -> Iterator[tuple]:
    """The rows as tuples, in order, a batch in memory at a time."""
    readers = [reader(f.dataType) for f in schema.fields]
    for batch in batches:
        columns = [c.to_pylist() if r is None else [r(x) for x in c.to_pylist()] for c, r in zip(batch.columns, readers, strict=True)]
        yield from zip(*columns, strict=True)


def batches_of(pairs: Iterable, schema: T.StructType, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Pairs (or bare keys' pairs) as Arrow batches of the schema."""
    arrow = to_arrow_schema(schema)
    held: list = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array([list(x) if isinstance(x, set) else x for x in c], f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    for pair in pairs:
        k, v = pair
        held.append((k, v))
        if len(held) >= size:
            yield flush()
            held = []
    if held:
        yield flush()


def drained(emitted: Any) -> Iterable:
    """What a block returned, as an iterable: nothing, an iterable, an awaitable of one, or an asynchronous iterable."""
    if emitted is None:
        return ()
    if hasattr(emitted, "__aiter__") or hasattr(emitted, "__await__"):
        return _awaited(emitted)
    return emitted


def _awaited(emitted: Any) -> Iterator:
    import asyncio

    loop = asyncio.new_event_loop()
    try:
        if hasattr(emitted, "__await__"):

            async def whole():
                return await emitted

            yield from drained(loop.run_until_complete(whole()))
            return
        steps = emitted.__aiter__()
        while True:
            try:
                yield loop.run_until_complete(anext(steps))
            except StopAsyncIteration:
                return
    finally:
        loop.close()
