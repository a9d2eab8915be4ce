"""Keys and partitioners against Python twins."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairflow import Job, hash_partitioner
from pairflow.functions.keys import canonical, canonical_json, code_unit_order, number_text
from pairflow.functions.partitioning import partition_of

TEXT = st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=12)


def columns(spark, values, kind):
    frame = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("k", kind)]))
    return frame.select(canonical_json(F.col("k"), kind).alias("j"), partition_of(frame, 8, hash_partitioner).alias("p")).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=40))
def test_strings(spark, values):
    for v, r in zip(values, columns(spark, values, T.StringType()), strict=True):
        assert r.j == json.dumps(v, ensure_ascii=False, separators=(",", ":"))
        assert r.p == int(hashlib.sha1(r.j.encode()).hexdigest()[:5], 16) % 8 == hash_partitioner(v, 8)


@pytest.mark.parametrize(
    "values, kind",
    [
        ([1, -5, None, 2**53], T.LongType()),
        ([True, False, None], T.BooleanType()),
        ([0.5, 1.0, 1e21, 1e-7, 123456.789, -0.0, None, 1e10], T.DoubleType()),
        ([["a", None], [], None, ['"', "\u001f"]], T.ArrayType(T.StringType())),
        ([[1.5, 2.0], []], T.ArrayType(T.DoubleType())),
        ([(1, "a"), (None, "\\"), None], T.StructType([T.StructField("_1", T.IntegerType()), T.StructField("_2", T.StringType())])),
        ([(1, (2, "x"))], T.StructType([T.StructField("_1", T.IntegerType()), T.StructField("_2", T.StructType([T.StructField("_1", T.IntegerType()), T.StructField("_2", T.StringType())]))])),
    ],
)
def test_other_keys(spark, values, kind):
    for v, r in zip(values, columns(spark, values, kind), strict=True):
        assert r.j == canonical(v) and r.p == hash_partitioner(v, 8)


def test_numbers():
    assert [number_text(x) for x in (1.0, 1e10, 1e21, 1e-6, 1.25e-7, 0.1, float("nan"))] == ["1", "10000000000", "1e+21", "0.000001", "1.25e-7", "0.1", "null"]


def test_known_hashes_and_ranges():
    assert (hash_partitioner("item1", 8), hash_partitioner("key1", 8)) == (7, 1)
    assert all(0 <= hash_partitioner(k, 3) < 3 for k in ("a", 1, None, True, ["a", 1], [1, [2, "x"]]))
    for n in (0, -1):
        with pytest.raises(ValueError):
            hash_partitioner("a", n)


def test_order(spark):
    def ordered(values, kind, *by):
        return [r.k for r in spark.createDataFrame([(v,) for v in values], f"k {kind}").orderBy(*by or ["k"]).collect()]

    assert [tuple(x) for x in ordered([(1, "a"), (0, "b"), (0, "a")], "struct<_1:int,_2:string>")] == [(0, "a"), (0, "b"), (1, "a")]
    assert ordered([[1, 2, 3], [1, 2], [], None], "array<int>") == [None, [], [1, 2], [1, 2, 3]]
    assert ordered([10, 9, None], "int") == [None, 9, 10]
    odd = ["\U0001f600", "", "z"]
    assert ordered(odd, "string") == ["z", "", "\U0001f600"]
    assert ordered(odd, "string", code_unit_order(F.col("k"))) == ["z", "\U0001f600", ""]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abcde")), st.integers(-9, 9)), max_size=40), st.dictionaries(st.sampled_from("abxyz"), st.integers(0, 9)))
def test_folds_and_joins(spark, pairs, right):
    frame = spark.createDataFrame(pairs, "k string, v bigint")
    job = Job().scan(frame, "k", "v", partitions=3)
    expected = {}
    for k, v in pairs:
        expected[k] = expected.get(k, 0) + v
    for block, python in (("sum", False), (lambda k, a, b: a + b, False), (lambda k, a, b: a + b, True)):
        assert {r.k: r.v for r in job.reduce(block, python=python).to_df(spark).collect()} == expected
    other = Job().scan(spark.createDataFrame(list(right.items()), "k string, v bigint"), "k", "v", partitions=3)
    found = job.combine(other, lambda k, a, b: (k, F.struct(a.alias("_1"), b.alias("_2")))).to_df(spark).collect()
    assert sorted(((r.k, *r.v) for r in found), key=repr) == sorted(((k, v, right.get(k)) for k, v in pairs), key=repr)
