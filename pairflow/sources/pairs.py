"""Sources and sinks of pairs: Python items, columns of tables, and dumped partitions.

A dump is one plain file of JSON lines ``[key,value]`` a partition, sorted by key:
``<prefix>/<partition>/chunk.json``, empty for an empty partition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidKey
from ..functions.keys import check_key, is_tuple, key_type
from ..functions.partitioning import layout, partition_of
from .store import HadoopStore

CHUNK = "chunk.json"
#: Files of a dump that get their names at a time.
RENAMES = 16


def from_items(spark: SparkSession, items: Iterable[Any], key: T.DataType | None = None) -> DataFrame:
    """A pair (item, null) for every item, duplicates kept."""
    items = [tuple(x) if isinstance(x, list) and key is not None and is_tuple(key) else x for x in items]
    key = key or key_type(items)
    check_key(key)
    rows = [(tuple(x) if is_tuple(key) and x is not None else x,) for x in items]
    if isinstance(key, T.StringType) and any(not isinstance(x, str) for (x,) in rows if x is not None):
        raise InvalidKey("keys of several types")
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("k", key)]), verifySchema=True)
    return frame.withColumn("v", F.lit(None).cast("string"))


def scan(frame: DataFrame, key: str | Column, value: str | Column | None = None) -> DataFrame:
    """Pairs from a table's columns; only these are read."""
    k = F.col(key) if isinstance(key, str) else key
    v = F.lit(None).cast("string") if value is None else F.col(value) if isinstance(value, str) else value
    out = frame.select(k.alias("k"), v.alias("v"))
    check_key(out.schema["k"].dataType)
    return out


def _as_json(name: str, kind: T.DataType) -> Column:
    """A column as JSON: tuples as arrays, nulls kept."""
    c = F.col(name) if name else None
    return _json_of(c, kind)


def _json_of(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        text = F.to_json(c)
    elif is_tuple(kind):
        text = F.when(c.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", *[_json_of(c[f.name], f.dataType) for f in kind.fields]), F.lit("]")))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _json_of(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType | T.MapType):
        text = F.to_json(c, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        whole = F.to_json(F.array(c), {"ignoreNullFields": "false"})
        text = F.substring(whole, F.lit(2), F.length(whole) - 2)
    return F.coalesce(text, F.lit("null"))


def dump(frame: DataFrame, prefix: str, n: int, partitioner) -> None:
    """Writes every partition. Files appear under their names only when all are written."""
    spark = frame.sparkSession
    store = HadoopStore(spark, None)
    schema = frame.schema
    placed = frame.withColumn("_p", partition_of(frame, n, partitioner))
    lines = placed.repartitionById(n, F.col("_p")).sortWithinPartitions("k").select("_p", F.concat(F.lit("["), _as_json("k", schema["k"].dataType), F.lit(","), _as_json("v", schema["v"].dataType), F.lit("]")).alias("value"))
    part = f"{prefix.rstrip('/')}/.dump-{uuid.uuid4().hex}"
    try:
        # One file a partition, whatever the session's limit on records in a file.
        lines.write.partitionBy("_p").option("compression", "none").option("maxRecordsPerFile", 0).text(part)
        written = {int(f.rsplit("/_p=", 1)[1].split("/")[0]): f for f in store.list(part) if f.rsplit("/", 1)[-1].startswith("part-")}

        def place(p: int) -> None:
            target = f"{prefix.rstrip('/')}/{p}/{CHUNK}"
            if p in written:
                store.rename(written[p], target)
            else:
                store.store(target, "")

        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(place, range(n)))
    finally:
        store.delete(part)


def load(spark: SparkSession, prefix: str, partitions: int, schema: T.StructType) -> DataFrame:
    """All pairs under ``<prefix>/0`` to ``<prefix>/<partitions - 1>``; a missing prefix is empty."""
    store = HadoopStore(spark, None)
    wanted = [f"{prefix.rstrip('/')}/{p}" for p in range(partitions)]
    there = [folder for folder in wanted if store.exists(folder)]
    if not there:
        return spark.createDataFrame([], schema)
    parsed = F.parse_json("value")
    found = spark.read.text(there, recursiveFileLookup=True).where("value <> ''").select(parsed.alias("_x"))
    return found.select(*[_from_variant(F.col("_x"), f"$[{i}]", f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def _from_variant(x: Column, path: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return F.variant_get(x, path, "variant")
    if is_tuple(kind):
        whole = F.variant_get(x, path, "variant")
        made = F.struct(*[_from_variant(x, f"{path}[{i}]", f.dataType).alias(f.name) for i, f in enumerate(kind.fields)])
        return F.when(whole.isNotNull() & ~F.is_variant_null(whole), made)
    return F.variant_get(x, path, kind.simpleString())


def to_lines(pairs: Iterable[tuple]) -> str:
    """Pairs as the lines of a dumped file."""
    return "".join(json.dumps([k, v], ensure_ascii=False, separators=(",", ":")) + "\n" for k, v in pairs)
