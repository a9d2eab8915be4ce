"""Keys: which types may be one, their canonical JSON, and their order.

Keys are strings, numbers, booleans, null, and arrays or tuples (structs with the
fields ``_1``, ``_2`` ...) of keys. Objects, maps and variants have no order and are
only values. Null equals null and sorts first.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidKey

_SCALARS = (T.StringType, T.BooleanType, T.NumericType, T.NullType, T.DateType, T.TimestampType, T.TimestampNTZType, T.VarcharType, T.CharType)


def is_tuple(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and bool(kind.fields) and all(f.name == f"_{i}" for i, f in enumerate(kind.fields, 1))


def check_key(kind: T.DataType) -> None:
    """Raises ``InvalidKey`` for a type that can't be a key."""
    if isinstance(kind, T.ArrayType):
        check_key(kind.elementType)
    elif is_tuple(kind):
        for f in kind.fields:
            check_key(f.dataType)
    elif not isinstance(kind, _SCALARS):
        raise InvalidKey(f"{kind.simpleString()} can't be a key")


def key_type(items: list[Any]) -> T.DataType:
    """The Spark type of some Python keys. Several scalar types at one place raise ``InvalidKey``; null goes with any."""
    items = [x for x in items if x is not None]
    if not items:
        return T.StringType()
    kinds = {"bool" if isinstance(x, bool) else "number" if isinstance(x, int | float) else "string" if isinstance(x, str) else "array" if isinstance(x, list | tuple) else "object" for x in items}
    if len(kinds) > 1:
        raise InvalidKey(f"keys of several types: {', '.join(sorted(kinds))}")
    kind = kinds.pop()
    if kind == "bool":
        return T.BooleanType()
    if kind == "number":
        return T.DoubleType() if any(isinstance(x, float) for x in items) else T.LongType()
    if kind == "string":
        return T.StringType()
    if kind == "object":
        raise InvalidKey("an object can't be a key")
    sizes = {len(x) for x in items}
    try:
        return T.ArrayType(key_type([y for x in items for y in x]))
    except InvalidKey:
        if len(sizes) > 1:
            raise
        columns = zip(*items, strict=True)
        return T.StructType([T.StructField(f"_{i}", key_type(list(c))) for i, c in enumerate(columns, 1)])


def number_text(x: float) -> str:
    """A double as JSON numbers are written by the shortest digits that read back: no ``.0``, plain digits below 1e21."""
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(x).partition("e")
    if exponent:
        power = int(exponent)
        sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        whole, _, part = digits.partition(".")
        if -7 < power < 0:
            return f"{sign}0.{'0' * (-power - 1)}{whole}{part}"
        return f"{sign}{whole}{'.' + part if part.strip('0') else ''}e{'+' if power > 0 else ''}{power}"
    return digits


def canonical(key: Any) -> str:
    """A Python key's canonical JSON: no spaces, non-ASCII characters as they are."""
    if key is None or isinstance(key, bool) or isinstance(key, int):
        return json.dumps(key)
    if isinstance(key, float):
        return number_text(key)
    if isinstance(key, str):
        return json.dumps(key, ensure_ascii=False)
    if isinstance(key, list | tuple):
        return "[" + ",".join(canonical(x) for x in key) + "]"
    raise InvalidKey(f"{type(key).__name__} can't be a key")


def _escapes() -> list[tuple[str, str]]:
    """What JSON writes for characters that can't stand in a string; the backslash first."""
    return [(c, json.dumps(c)[1:-1]) for c in ["\\", '"', *map(chr, range(32))]]


def _has_doubles(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_doubles(kind.elementType)
    if is_tuple(kind):
        return any(_has_doubles(f.dataType) for f in kind.fields)
    return isinstance(kind, T.DoubleType | T.FloatType)


def canonical_json(key: Column, kind: T.DataType) -> Column:
    """The same as a column expression. Only keys with doubles leave the JVM, for their shortest digits."""
    if _has_doubles(kind):
        return F.udf(lambda x: canonical(x), T.StringType(), useArrow=True)(key)
    if isinstance(kind, T.NullType):
        return F.lit("null")
    if isinstance(kind, T.StringType | T.VarcharType | T.CharType):
        escaped = key
        for c, text in _escapes():
            escaped = F.replace(escaped, F.lit(c), F.lit(text))
        plain = F.concat(F.lit('"'), key, F.lit('"'))
        out = F.when(key.rlike(r'[\x00-\x1f"\\]'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(plain)
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(key, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif is_tuple(kind):
        out = F.when(key.isNotNull(), F.concat(F.lit("["), F.concat_ws(",", *[canonical_json(key[f.name], f.dataType) for f in kind.fields]), F.lit("]")))
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        out = key.cast("string")
    else:
        out = canonical_json(key.cast("string"), T.StringType())
    return F.coalesce(out, F.lit("null"))


def code_unit_order(key: Column) -> Column:
    """Sorts strings by UTF-16 code units rather than by code points."""
    return F.encode(key, "UTF-16BE")
