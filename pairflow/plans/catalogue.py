"""The registered queries of the engine's operators, and the SQL that each must equal.

Every query is a job over whole tables; amounts are cents, since sums of doubles
depend on their order.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import PairflowError
from ..functions.partitioning import hash_partitioner, identity_partitioner, partition_of
from .job import Job, together

QUERIES = {}
ORACLE = {}
PARTITIONS = 8


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _scan(sf_dir: str, name: str, key, value=None, **options) -> Job:
    return Job().scan(lambda spark: spark.read.parquet(f"{sf_dir}/{name}.parquet"), key, value, partitions=PARTITIONS, **options)


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def _named(frame: DataFrame, k: str, v: str) -> DataFrame:
    return frame.select(F.col("k").alias(k), F.col("v").alias(v))


_SQL_CENTS = "cast(round({} * 100) as bigint)"


@query("select word, count(*) as n from (select unnest(string_split_regex(text, '\\s+')) as word from documents) where word <> '' group by word")
def wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat map to (word, 1) and a reduce."""
    words = _scan(sf_dir, "documents", "doc_id", "text").map(lambda k, v: F.transform(F.filter(F.split(v, r"\s+"), lambda w: w != ""), lambda w: F.struct(w.alias("k"), F.lit(1).cast("bigint").alias("v"))))
    return _named(words.reduce("sum").to_df(spark), "word", "n")


@query(f"select o_custkey as custkey, cast(sum({_SQL_CENTS.format('o_totalprice')}) as bigint) as cents from orders group by 1")
def reduce_sum_cents(spark, sf_dir):
    return _named(_scan(sf_dir, "orders", "o_custkey", _cents("o_totalprice")).reduce("sum").to_df(spark), "custkey", "cents")


@query("select event_type, min(event_id) as least from events group by 1")
def reduce_min(spark, sf_dir):
    return _named(_scan(sf_dir, "events", "event_type", "event_id").reduce("min").to_df(spark), "event_type", "least")


@query("select event_type, max(user_id) as most from events group by 1")
def reduce_max(spark, sf_dir):
    return _named(_scan(sf_dir, "events", "event_type", "user_id").reduce("max").to_df(spark), "event_type", "most")


@query(f"select l_partkey as partkey, cast(max({_SQL_CENTS.format('l_extendedprice')}) as bigint) as cents from lineitem group by 1")
def reduce_column_block(spark, sf_dir):
    """A fold by a column block."""
    return _named(_scan(sf_dir, "lineitem", "l_partkey", _cents("l_extendedprice")).reduce(lambda k, a, b: F.greatest(a, b)).to_df(spark), "partkey", "cents")


@query("select l_suppkey as suppkey, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from lineitem group by 1")
def reduce_python_block(spark, sf_dir):
    """A fold by a Python block, in tasks before the shuffle and over sorted keys after it."""
    return _named(_scan(sf_dir, "lineitem", "l_suppkey", F.col("l_quantity").cast("bigint")).reduce(lambda k, a, b: a + b, python=True).to_df(spark), "suppkey", "quantity")


@query("select max(cast(json_extract_string(props, '$.k') as bigint)) as most, event_type from events group by event_type")
def json_map_reduce_max(spark, sf_dir):
    job = _scan(sf_dir, "events", "event_type", "props").map(lambda k, v: (k, F.get_json_object(v, "$.k").cast("bigint"))).reduce("max")
    return _named(job.to_df(spark), "event_type", "most")


@query(f"select l_orderkey as orderkey, {_SQL_CENTS.format('l_extendedprice')} as cents from lineitem")
def map_project(spark, sf_dir):
    return _named(_scan(sf_dir, "lineitem", "l_orderkey", "l_extendedprice").map(lambda k, v: (k, F.round(v * 100).cast("bigint"))).to_df(spark), "orderkey", "cents")


@query("select l_orderkey as orderkey, l_quantity as quantity from lineitem where l_quantity >= 45")
def map_filter(spark, sf_dir):
    """A map that emits nothing for some pairs: the condition reaches the scan."""
    return _named(_scan(sf_dir, "lineitem", "l_orderkey", "l_quantity").map(lambda k, v: (k, v, v >= 45)).to_df(spark), "orderkey", "quantity")


@query("select l_partkey as partkey, l_orderkey as orderkey from lineitem")
def map_rekey(spark, sf_dir):
    return _named(_scan(sf_dir, "lineitem", "l_orderkey", "l_partkey").map(lambda k, v: (v, k)).to_df(spark), "partkey", "orderkey")


@query("select upper(c_mktsegment) as segment, c_custkey as custkey from customer union all select 'ALL', c_custkey from customer where c_acctbal > 0")
def map_many_emits(spark, sf_dir):
    job = _scan(sf_dir, "customer", "c_custkey", F.struct("c_mktsegment", "c_acctbal")).map(lambda k, v: [(F.upper(v["c_mktsegment"]), k), (F.lit("ALL"), k, v["c_acctbal"] > 0)])
    return _named(job.to_df(spark), "segment", "custkey")


@query("select c_name || '-' || cast(c_nationkey as varchar) as name, cast(length(c_name) as bigint) as n from customer where c_nationkey % 2 = 0")
def map_python_block(spark, sf_dir):
    """A generator over Arrow batches."""

    def block(k, v):
        if v % 2 == 0:
            yield f"{k}-{v}", len(k)

    return _named(_scan(sf_dir, "customer", "c_name", "c_nationkey").map(block, schema="k string, v bigint").to_df(spark), "name", "n")


@query("select * from (values ('a'), ('b'), ('b'), ('c')) t(item)")
def parallelize_items(spark, sf_dir):
    """Items become pairs, duplicates too."""
    return Job().parallelize(lambda: ["a", "b", "b", "c"], partitions=PARTITIONS).to_df(spark).select(F.col("k").alias("item"))


@query("select ('0x' || substr(sha1(cast(to_json(c_name) as varchar)), 1, 5))::bigint % 8 as p, count(*) as n from customer group by 1")
def hash_partition_counts(spark, sf_dir):
    frame = _scan(sf_dir, "customer", "c_name").to_df(spark)
    return frame.groupBy(partition_of(frame, PARTITIONS, hash_partitioner).cast("bigint").alias("p")).agg(F.count("*").alias("n"))


@query("select ('0x' || substr(sha1(cast(c_custkey as varchar)), 1, 5))::bigint % 8 as p, count(*) as n from customer group by 1")
def hash_partition_int(spark, sf_dir):
    frame = _scan(sf_dir, "customer", "c_custkey").to_df(spark)
    return frame.groupBy(partition_of(frame, PARTITIONS, hash_partitioner).cast("bigint").alias("p")).agg(F.count("*").alias("n"))


@query("select p_partkey as partkey, ('0x' || substr(sha1(cast(p_partkey as varchar)), 1, 5))::bigint % 5 as p from part")
def repartition_layout(spark, sf_dir):
    """The partition that each key is in after a repartition, as a block sees it."""

    def block(partition, pairs):
        for k, _ in pairs:
            yield k, partition

    job = _scan(sf_dir, "part", "p_partkey").repartition(partitions=5).map_partitions(block, schema="k bigint, v bigint")
    return _named(job.to_df(spark), "partkey", "p")


@query("select c_custkey as custkey, c_custkey % 3 as p from customer")
def custom_partitioner(spark, sf_dir):
    def block(partition, pairs):
        for k, _ in pairs:
            yield k, partition

    job = _scan(sf_dir, "customer", "c_custkey").repartition(partitions=3, partitioner=lambda k, n: k % n).map_partitions(block, schema="k bigint, v bigint")
    return _named(job.to_df(spark), "custkey", "p")


_SQL_PARTITION = "('0x' || substr(sha1(cast({0} as varchar)), 1, 5))::bigint % 8"


@query(
    f"select o_custkey as custkey, cast(sum(cents) over (partition by {_SQL_PARTITION.format('o_custkey')} order by o_custkey rows unbounded preceding) as bigint) as running "
    f"from (select o_custkey, sum({_SQL_CENTS.format('o_totalprice')}) as cents from orders group by 1)"
)
def map_partitions_running_sum(spark, sf_dir):
    """A stream over each partition's sorted pairs."""

    def block(partition, pairs):
        total = 0
        for k, v in pairs:
            total += v
            yield k, total

    job = _scan(sf_dir, "orders", "o_custkey", _cents("o_totalprice")).reduce("sum").map_partitions(block, schema="k bigint, v bigint")
    return _named(job.to_df(spark), "custkey", "running")


@query(f"select p, custkey from (select {_SQL_PARTITION.format('c_custkey')} as p, c_custkey as custkey, row_number() over (partition by {_SQL_PARTITION.format('c_custkey')} order by c_custkey) as r from customer) where r <= 3")
def partition_topk(spark, sf_dir):
    """The first three keys of each partition, as a window."""
    frame = _scan(sf_dir, "customer", "c_custkey").to_df(spark)
    placed = frame.select(partition_of(frame, PARTITIONS, hash_partitioner).cast("bigint").alias("p"), F.col("k").alias("custkey"))
    return placed.withColumn("r", F.row_number().over(W.partitionBy("p").orderBy("custkey"))).where("r <= 3").drop("r")


def _order_counts(sf_dir: str) -> Job:
    return _scan(sf_dir, "orders", "o_custkey", F.lit(1).cast("bigint")).reduce("sum")


@query("select c_custkey as custkey, c_mktsegment as segment, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey is not distinct from o_custkey")
def combine_left(spark, sf_dir):
    job = _scan(sf_dir, "customer", "c_custkey", "c_mktsegment").combine(_order_counts(sf_dir), lambda k, left, right: (k, F.struct(left.alias("s"), F.coalesce(right, F.lit(0)).alias("n"))))
    return job.to_df(spark).select(F.col("k").alias("custkey"), F.col("v.s").alias("segment"), F.col("v.n").alias("n"))


@query("select c_custkey as custkey, n from customer join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def combine_inner(spark, sf_dir):
    """A combine that emits nothing where the right side has no such key."""
    return _named(_scan(sf_dir, "customer", "c_custkey").combine(_order_counts(sf_dir), lambda k, left, right: (k, right, right.isNotNull())).to_df(spark), "custkey", "n")


@query("select c_custkey as custkey, c_mktsegment as segment from customer where c_custkey in (select o_custkey from orders)")
def combine_semi(spark, sf_dir):
    return _named(_scan(sf_dir, "customer", "c_custkey", "c_mktsegment").semi(_scan(sf_dir, "orders", "o_custkey")).to_df(spark), "custkey", "segment")


@query("select c_custkey as custkey, c_mktsegment as segment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def combine_anti(spark, sf_dir):
    filled = _scan(sf_dir, "orders", "o_custkey", "o_orderstatus").filter(lambda k, v: v == "F")
    return _named(_scan(sf_dir, "customer", "c_custkey", "c_mktsegment").anti(filled).to_df(spark), "custkey", "segment")


@query("select n_name as nation, r_name as region, s_suppkey as suppkey from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def combine_chain(spark, sf_dir):
    """Two combines, each against unique keys."""
    nations = _scan(sf_dir, "nation", "n_nationkey", F.struct("n_name", "n_regionkey"), unique=True)
    regions = _scan(sf_dir, "region", "r_regionkey", "r_name", unique=True)
    job = _scan(sf_dir, "supplier", "s_nationkey", "s_suppkey").combine(nations, lambda k, s, n: (n["n_regionkey"], F.struct(s.alias("s"), n["n_name"].alias("n"))))
    job = job.combine(regions, lambda k, left, r: (left["s"], F.struct(left["n"].alias("n"), r.alias("r"))))
    return job.to_df(spark).select(F.col("v.n").alias("nation"), F.col("v.r").alias("region"), F.col("k").alias("suppkey"))


@query("select c_custkey as custkey, 'customer' as source from customer union all select o_custkey, 'order' from orders")
def append_all(spark, sf_dir):
    return _named(_scan(sf_dir, "customer", "c_custkey", F.lit("customer")).append(_scan(sf_dir, "orders", "o_custkey", F.lit("order"))).to_df(spark), "custkey", "source")


@query(
    "select coalesce(s_nationkey, c_nationkey) as nationkey, coalesce(s, 0) as suppliers, coalesce(c, 0) as customers "
    "from (select s_nationkey, count(*) as s from supplier group by 1) full join (select c_nationkey, count(*) as c from customer group by 1) on s_nationkey = c_nationkey"
)
def full_outer_append_reduce(spark, sf_dir):
    """A full join as append and reduce: one shuffle."""
    pair = lambda a, b: F.struct(F.lit(a).cast("bigint").alias("_1"), F.lit(b).cast("bigint").alias("_2"))
    job = _scan(sf_dir, "supplier", "s_nationkey", pair(1, 0)).append(_scan(sf_dir, "customer", "c_nationkey", pair(0, 1)))
    job = job.reduce(lambda k, a, b: F.struct((a["_1"] + b["_1"]).alias("_1"), (a["_2"] + b["_2"]).alias("_2")))
    return job.to_df(spark).select(F.col("k").alias("nationkey"), F.col("v._1").alias("suppliers"), F.col("v._2").alias("customers"))


@query("select coalesce(s_nationkey, -1) as nationkey, coalesce(s_suppkey, -1) as suppkey, coalesce(c_custkey, -1) as custkey from supplier full join customer on s_nationkey = c_nationkey and s_suppkey % 50 = c_custkey % 50")
def full_outer_join(spark, sf_dir):
    """Many to many, on a composite key."""
    key = lambda nation, number: F.struct(F.col(nation).alias("_1"), (F.col(number) % 50).alias("_2"))
    job = _scan(sf_dir, "supplier", key("s_nationkey", "s_suppkey"), F.struct("s_nationkey", "s_suppkey")).full_outer(_scan(sf_dir, "customer", key("c_nationkey", "c_custkey"), "c_custkey"))
    return job.to_df(spark).select(*[F.coalesce(f"v.{c}", F.lit(-1)).alias(name) for c, name in (("_1.s_nationkey", "nationkey"), ("_1.s_suppkey", "suppkey"), ("_2", "custkey"))])


@query("select distinct l_shipdate as shipdate from lineitem")
def distinct_keys(spark, sf_dir):
    return _scan(sf_dir, "lineitem", "l_shipdate").distinct_keys().to_df(spark).select(F.col("k").alias("shipdate"))


@query("select l_partkey as partkey, count(*) as n from lineitem group by 1")
def count_by_key(spark, sf_dir):
    return _named(_scan(sf_dir, "lineitem", "l_partkey").count().to_df(spark), "partkey", "n")


@query(f"select event_type, cast(sum({_SQL_CENTS.format('value')}) as bigint) as cents, count(*) as n from events group by 1")
def average_pair(spark, sf_dir):
    """An average as a pair of sum and count, so that parts of it can be merged."""
    job = _scan(sf_dir, "events", "event_type", F.struct(_cents("value").alias("_1"), F.lit(1).cast("bigint").alias("_2")))
    job = job.reduce(lambda k, a, b: F.struct((a["_1"] + b["_1"]).alias("_1"), (a["_2"] + b["_2"]).alias("_2")))
    return job.to_df(spark).select(F.col("k").alias("event_type"), F.col("v._1").alias("cents"), F.col("v._2").alias("n"))


@query("select n_regionkey as regionkey, string_agg(n_name, ',' order by n_name) as nations from nation group by 1")
def collect_values(spark, sf_dir):
    job = _scan(sf_dir, "nation", "n_regionkey", "n_name").collect().map_values(lambda v: F.array_join(v, ","))
    return _named(job.to_df(spark), "regionkey", "nations")


@query("select s_nationkey as nationkey from supplier union select c_nationkey from customer")
def union_distinct(spark, sf_dir):
    return _scan(sf_dir, "supplier", "s_nationkey").union_distinct(_scan(sf_dir, "customer", "c_nationkey")).to_df(spark).select(F.col("k").alias("nationkey"))


@query("select s_nationkey as nationkey from supplier intersect select c_nationkey from customer")
def intersect_keys(spark, sf_dir):
    return _scan(sf_dir, "supplier", "s_nationkey").intersect(_scan(sf_dir, "customer", "c_nationkey")).to_df(spark).select(F.col("k").alias("nationkey"))


@query("select c_custkey as custkey, c_nationkey as nationkey from customer except select s_suppkey, s_nationkey from supplier")
def except_keys(spark, sf_dir):
    return _named(_scan(sf_dir, "customer", "c_custkey", "c_nationkey").subtract(_scan(sf_dir, "supplier", "s_suppkey", "s_nationkey")).to_df(spark), "custkey", "nationkey")


@query("select l_returnflag as returnflag, l_linestatus as linestatus, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from lineitem group by 1, 2")
def array_key_reduce(spark, sf_dir):
    """A composite key."""
    key = F.struct(F.col("l_returnflag").alias("_1"), F.col("l_linestatus").alias("_2"))
    job = _scan(sf_dir, "lineitem", key, F.col("l_quantity").cast("bigint")).reduce("sum")
    return job.to_df(spark).select(F.col("k._1").alias("returnflag"), F.col("k._2").alias("linestatus"), F.col("v").alias("quantity"))


@query(f"select o_orderstatus as status, o_orderpriority as priority, cast(sum({_SQL_CENTS.format('o_totalprice')}) as bigint) as cents from orders group by rollup(1, 2)")
def rollup_keys(spark, sf_dir):
    key = F.struct(F.col("o_orderstatus").alias("_1"), F.col("o_orderpriority").alias("_2"))
    job = _scan(sf_dir, "orders", key, _cents("o_totalprice")).rollup(lambda k: k["_1"], lambda k: k["_2"])
    return job.to_df(spark).select(F.col("k._1").alias("status"), F.col("k._2").alias("priority"), F.col("v").alias("cents"))


@query("select date_trunc('hour', ts) as hour, count(*) as n from events group by 1")
def time_bucket_reduce(spark, sf_dir):
    """Windows of time as keys."""
    job = _scan(sf_dir, "events", F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.lit(1).cast("bigint")).reduce("sum")
    return _named(job.to_df(spark), "hour", "n")


@query(
    f"select 'total' as kind, cast(sum({_SQL_CENTS.format('o_totalprice')}) as bigint) as cents, o_orderstatus as status from orders group by 3 "
    f"union all select 'largest', cast(max({_SQL_CENTS.format('o_totalprice')}) as bigint), o_orderstatus from orders group by 3"
)
def shared_prefix(spark, sf_dir):
    """Two jobs that share their first steps: these are computed once, and both jobs' (few) pairs with them."""
    shared = _scan(sf_dir, "orders", "o_orderstatus", "o_totalprice").map(lambda k, v: (k, F.round(v * 100).cast("bigint")))
    with together(spark, shared.reduce("sum"), shared.reduce("max")) as (total, largest):
        both = total.select(F.lit("total").alias("kind"), F.col("k").alias("status"), F.col("v").alias("cents")).unionAll(largest.select(F.lit("largest"), "k", "v"))
        path = f"{_folder(spark)}/pairs"
        both.write.parquet(path)
    return spark.read.schema(both.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    """A folder that all executors reach; a temporary one only in local sessions that name none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise PairflowError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="pairs-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    return f"{top}/pairs-{uuid.uuid4().hex}"


@query("select r_regionkey as regionkey, r_name as name from region")
def dump_load_roundtrip(spark, sf_dir):
    """Dumped as JSON lines by partition, and loaded again."""
    prefix = _folder(spark)
    _scan(sf_dir, "region", "r_regionkey", "r_name").dump(prefix=prefix).to_df(spark)
    return _named(Job().load(prefix=prefix, partitions=PARTITIONS, partitioner=hash_partitioner, schema="k int, v string").to_df(spark), "regionkey", "name")


@query("select n_name as nation, n_nationkey as nationkey from nation")
def each_partition_roundtrip(spark, sf_dir):
    """A side effect by partition: files of its own, read again."""
    folder = _folder(spark)

    def block(partition, pairs):
        import json

        from pyarrow.fs import FileSystem

        # A store's own name may have another form for Spark. A task that runs again writes the same file again.
        system, path = FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{partition}.json") as f:
            f.write("".join(json.dumps({"nation": k, "nationkey": v}) + "\n" for k, v in pairs).encode())

    _scan(sf_dir, "nation", "n_name", "n_nationkey").each_partition(block).to_df(spark)
    return spark.read.schema("nation string, nationkey int").json(f"{folder}/*.json")


@query("select n_nationkey as nationkey, n_nationkey % 4 as p from nation")
def identity_partitions(spark, sf_dir):
    """Keys that are partition numbers."""

    def block(partition, pairs):
        for k, v in pairs:
            yield v, partition

    job = _scan(sf_dir, "nation", F.col("n_nationkey") % 4, "n_nationkey").repartition(partitions=4, partitioner=identity_partitioner).map_partitions(block, schema="k int, v int")
    return _named(job.to_df(spark), "nationkey", "p")


@query("select c_custkey as custkey, c_acctbal as balance from customer order by c_acctbal desc, c_custkey limit 10")
def top_pairs(spark, sf_dir):
    """The ten largest values: a heap in each task, then one of those."""
    return _named(_scan(sf_dir, "customer", "c_custkey", "c_acctbal").top(10, lambda k, v: [F.desc(v), F.asc(k)]).to_df(spark), "custkey", "balance")
