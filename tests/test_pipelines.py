"""Golden pipelines: the literal inputs and results that the engine must reproduce."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairflow import DuplicateKey, IncompatibleFrame, InvalidJob, InvalidKey, InvalidStep, Job, JobStopped, PairflowError, Runner, configure, hash_partitioner, identity_partitioner, resolve_jobs
from pairflow.plans import config
from pairflow.plans.job import together
from pairflow.plans.nodes import Action
from pairflow.sources.store import HadoopStore, MemoryStore, NoSuchObject


def keys(*names, partitions=8, **options):
    return Job().parallelize(lambda: list(names), partitions=partitions, **options)


def valued(pairs, partitions=8):
    """Pairs as a job, whatever their order."""
    kind = "double" if any(isinstance(v, float) for _, v in pairs) else "bigint"
    return Job().scan(lambda spark: spark.createDataFrame(pairs, f"k string, v {kind}"), "k", "v", partitions=partitions)


def rows(job, spark):
    return Counter((r.k, r.v) for r in job.to_df(spark).collect())


def numbered(k, v):
    return [(k, F.substring(k, 4, 2).cast("bigint"))] * 3


def seen(folder):
    """A block that writes what each partition holds, and a reader of that."""

    def block(partition, pairs):
        with open(f"{folder}/{partition}.json", "w") as f:
            json.dump([list(p) for p in pairs], f)

    return block, lambda: {int(n.split(".")[0]): json.load(open(f"{folder}/{n}")) for n in os.listdir(folder) if n.endswith(".json")}


@pytest.mark.parametrize("jobs", [None, 3, 6, 7])
def test_map_reduce_each_partition(spark, tmp_path, jobs):
    block, read = seen(tmp_path)
    job = keys(*[f"key{i}" for i in range(1, 10)]).map(numbered, jobs=jobs).reduce("sum", jobs=jobs).each_partition(block, jobs=jobs)
    assert rows(job, spark) == Counter({(f"key{i}", 3 * i): 1 for i in range(1, 10)})
    parts = read()
    assert sorted(parts) == list(range(8))  # empty partitions are visited
    for p, pairs in parts.items():
        assert [k for k, _ in pairs] == sorted(k for k, _ in pairs)
        assert all(hash_partitioner(k, 8) == p for k, _ in pairs)


def test_constructor_arguments_and_runner(spark):
    class Multiply:
        def __init__(self, factor):
            self.factor = factor

        def run(self):
            return keys("key1", "key2", "key3", partitions=4).map(lambda k, v: (k, F.substring(k, 4, 1).cast("bigint") * self.factor)).reduce("sum")

    configure(jobs={"Multiply": Multiply})
    (frame,) = Runner(Multiply, spark).run(2)
    assert {(r.k, r.v) for r in frame.collect()} == {("key1", 2), ("key2", 4), ("key3", 6)}
    config.reset()


def test_dump_and_load(spark, tmp_path):
    class Both:
        def run(self):
            write = keys(*[f"key{i}" for i in range(1, 10)], partitions=4).map(lambda k, v: (k, F.substring(k, 4, 1).cast("bigint"))).dump(prefix=f"{tmp_path}/out")
            read = Job().load(prefix=f"{tmp_path}/out", partitions=4, partitioner=hash_partitioner, schema="k string, v bigint")
            return [write, read]

    configure(jobs={"Both": Both})
    _, loaded = Runner(Both, spark).run()
    assert {(r.k, r.v) for r in loaded.collect()} == {(f"key{i}", i) for i in range(1, 10)}
    for p in range(4):
        lines = open(f"{tmp_path}/out/{p}/chunk.json").read().splitlines()
        assert lines == sorted(lines) and all(hash_partitioner(json.loads(x)[0], 4) == p for x in lines)
    config.reset()


def test_dump_writes_empty_partitions_nulls_and_tuples(spark, tmp_path):
    frame = spark.createDataFrame([((1, "a"), None), ((None, 'q"\n'), 2.5)], "k struct<_1:int,_2:string>, v double")
    Job().scan(frame, "k", "v", partitions=3).dump(prefix=f"{tmp_path}/x").to_df(spark)
    found = {p: open(f"{tmp_path}/x/{p}/chunk.json").read() for p in range(3)}
    assert sorted("".join(found.values()).splitlines()) == sorted(['[[1,"a"],null]', '[[null,"q\\"\\n"],2.5]'])
    assert "" in found.values()
    again = Job().load(prefix=f"{tmp_path}/x", partitions=3, partitioner=hash_partitioner, schema="k struct<_1:int,_2:string>, v double").to_df(spark)
    assert {(tuple(r.k), r.v) for r in again.collect()} == {((1, "a"), None), ((None, 'q"\n'), 2.5)}
    fewer = Job().load(prefix=f"{tmp_path}/x", partitions=1, partitioner=hash_partitioner, schema="k struct<_1:int,_2:string>, v double").to_df(spark)
    assert fewer.count() == len(found[0].splitlines())


def test_dump_takes_the_place_of_an_older_one(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1)
    try:
        for last in ("c", "d"):
            keys("a", "b", last, partitions=2).dump(prefix=f"{tmp_path}/x").to_df(spark)
            lines = [x for p in range(2) for x in open(f"{tmp_path}/x/{p}/chunk.json").read().splitlines()]
            assert sorted(json.loads(x)[0] for x in lines) == ["a", "b", last]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(n for _, _, names in os.walk(f"{tmp_path}/x") for n in names if not n.endswith(".crc")) == ["chunk.json"] * 2


def test_load_from_nowhere_is_empty(spark, tmp_path):
    assert Job().load(prefix=f"{tmp_path}/none", partitions=2, partitioner=hash_partitioner, schema="k string, v bigint").to_df(spark).count() == 0


def test_append(spark):
    left = keys("key1", "key2", "key3").map(lambda k, v: (k, F.lit(2)))
    right = keys("key3", "key4", "key5", "key6").map(lambda k, v: (k, F.lit(3)))
    assert rows(left.append(right), spark) == Counter([("key1", 2), ("key2", 2), ("key3", 2), ("key3", 3), ("key4", 3), ("key5", 3), ("key6", 3)])


def test_combine_chain(spark):
    add = lambda k, left, right: (k, left + F.coalesce(right, F.lit(0)))
    one = keys(*[f"key{i}" for i in range(1, 6)]).map(lambda k, v: (k, F.lit(1))).reduce("sum")
    two = keys(*[f"key{i}" for i in range(1, 5)]).map(lambda k, v: (k, F.lit(2))).combine(one, add).reduce("sum")
    three = keys("key1", "key2", "key3").map(lambda k, v: (k, F.lit(3))).combine(two, add)
    assert rows(three, spark) == Counter({("key1", 6): 1, ("key2", 6): 1, ("key3", 6): 1})


def test_shared_steps_run_once(spark, tmp_path):
    def once(name):
        def block(k, v):
            with open(f"{tmp_path}/{name}", "a") as f:
                f.write("x")
            yield k, 1
            yield k, 1

        return block

    class Shared:
        def run(self):
            shared = keys("key", partitions=1).map(once("map"), schema="k string, v bigint").reduce(lambda k, a, b: a + b, python=True)
            return [shared.each_partition(lambda p, pairs: list(pairs)), shared.each_partition(lambda p, pairs: list(pairs))]

    configure(jobs={"Shared": Shared})
    Runner(Shared, spark).run()
    assert open(f"{tmp_path}/map").read() == "x"
    config.reset()


def test_jobs_together_share_their_steps(spark, sf):
    shared = Job().scan(lambda s: s.read.parquet(f"{sf}/orders.parquet"), "o_orderstatus", "o_custkey", partitions=4).map(lambda k, v: (F.lower(k), v))
    with together(spark, shared.reduce("sum"), shared.reduce("max")) as (total, largest):
        plan = total.unionAll(largest)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("InMemoryRelation") == 2 and total.count() == largest.count() > 0
        # Both branches read one kept relation, of one scan.
        assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 1
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_a_steps_pool_is_its_own(spark, tmp_path):
    pool = lambda: spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    seen = []
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", "outer")
    try:
        job = keys("a", partitions=1, enqueuer="p1", before=lambda: seen.append(pool())).map(lambda k, v: (k, F.lit(1)), before=lambda: seen.append(pool()))
        job.map(lambda k, v: (k, v), enqueuer="p2", before=lambda: seen.append(pool())).dump(prefix=f"{tmp_path}/x").to_df(spark)
        assert seen == ["p1", "outer", "p2"] and pool() == "outer"

        class Pools:
            async def run(self):
                return [job.map(lambda k, v: (k, v), before=lambda: seen.append(pool()))]

        configure(jobs={"Pools": Pools}, enqueuer="all")
        (frame,) = Runner(Pools, spark).run()
        assert frame.count() == 1 and seen[3:] == ["p1", "all", "all"] and pool() == "outer"
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        config.reset()


SUMS = lambda k, a, b: F.struct((a["_1"] + b["_1"]).alias("_1"), F.greatest(a["_2"], b["_2"]).alias("_2"))


@pytest.mark.parametrize(
    ("block", "native"),
    [(lambda k, a, b: a + b, True), (lambda k, a, b: b + a, True), (lambda k, a, b: F.greatest(a, b), True), (lambda k, a, b: F.least(b, a), True), (lambda k, a, b: a * b, False), (lambda k, a, b: a + b + 0 * F.length(k), False), (lambda k, a, b: F.coalesce(a, b), False)],
)
def test_column_blocks_that_are_native_folds(spark, block, native):
    pairs = [("a", 3), ("a", 2), ("a", 4), ("b", None), ("b", 5), ("c", None), ("d", 7), (None, 1), (None, 2), ("e", None), ("e", None)]
    frame = valued(pairs).reduce(block).to_df(spark)
    assert ("collect_list" not in frame._jdf.queryExecution().executedPlan().toString()) == native
    from pairflow.operators import reduce as module

    slow, module.known_fold = module.known_fold, lambda *a: None
    try:
        plain = valued(pairs).reduce(block).to_df(spark).collect()
    finally:
        module.known_fold = slow
    if block(F.col("k"), F.col("a"), F.col("b")) is not None and "coalesce" not in str(block(F.lit("k"), F.lit(1), F.lit(2))):
        assert Counter(map(tuple, frame.collect())) == Counter(map(tuple, plain))


def test_struct_blocks_that_are_native_folds(spark):
    frame = spark.createDataFrame([("a", (1, 5)), ("a", (2, None)), ("b", (None, 1)), ("b", (3, 9)), ("c", None), ("d", (4, None))], "k string, v struct<_1:bigint,_2:int>")
    out = Job().scan(frame, "k", "v", partitions=2).reduce(SUMS).to_df(spark)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.v and tuple(r.v) for r in out.collect()} == {"a": (3, 5), "b": (None, 9), "c": None, "d": (4, None)}


def test_parallelize_places_items(spark, tmp_path):
    block, read = seen(tmp_path)
    keys("item1").each_partition(block).to_df(spark)
    assert {p: x for p, x in read().items() if x} == {7: [["item1", None]]}


def test_map(spark):
    assert rows(valued([("item1", 1), ("item2", 2)]).map(lambda k, v: (F.concat(k, F.lit("-extra")), v + 1)), spark) == Counter([("item1-extra", 2), ("item2-extra", 3)])


def test_map_then_reduce_sees_plain_keys(spark):
    def emit(k, v):
        yield from ((k + "a", 1), (k + "a", 1), (k + "b", 1))

    def add(k, a, b):
        assert isinstance(k, str)
        return a + b

    assert rows(keys("item1", "item2").map(emit, schema="k string, v bigint").reduce(add, python=True), spark) == Counter([("item1a", 2), ("item1b", 1), ("item2a", 2), ("item2b", 1)])


def test_map_partitions(spark):
    def block(partition, pairs):
        before = None
        for k, v in pairs:
            assert before is None or before <= k
            before = k
            yield k + "x", v + 1

    job = valued([("item1", 1), ("item3", 1), ("item2", 1), ("item3", 1)], partitions=1).map_partitions(block, schema="k string, v bigint")
    assert rows(job, spark) == Counter({("item1x", 2): 1, ("item2x", 2): 1, ("item3x", 2): 2})


FOLDS = [("sum", False), (lambda k, a, b: a + b, False), (lambda k, a, b: a + b, True)]


@pytest.mark.parametrize("block, python", FOLDS)
def test_reduce(spark, block, python):
    pairs = [("item1", 1), ("item1", 2), ("item2", 3), ("item3", 4), ("item2", 1), ("item3", 2), ("item4", 2)]
    assert rows(valued(pairs).reduce(block, python=python), spark) == Counter([("item1", 3), ("item2", 4), ("item3", 6), ("item4", 2)])
    assert rows(valued([("a", 1), ("a", 2), ("a", 3), ("b", 10), ("c", 100), ("c", 200)]).reduce(block, python=python), spark) == Counter([("a", 6), ("b", 10), ("c", 300)])
    assert rows(valued([("key", 2**i) for i in range(5)]).reduce(block, python=python), spark) == Counter([("key", 31)])
    assert valued([]).reduce(block, python=python).to_df(spark).count() == 0


@pytest.mark.parametrize("block, python", FOLDS)
def test_reduce_leaves_single_nulls(spark, block, python):
    assert rows(valued([("a", None), (None, 1), (None, 2)]).reduce(block, python=python), spark) == Counter([("a", None), (None, 3)])


def test_combine_kernel(spark):
    left, right = valued([("shared", 1), ("onlyLeft", 2), ("shared", 3), (None, 4)]), valued([("shared", 10), ("onlyRight", 99), (None, 40)])
    columns = left.combine(right, lambda k, a, b: (k, F.struct(a.alias("_1"), b.alias("_2"))))
    assert rows(columns, spark) == Counter([("onlyLeft", (2, None)), ("shared", (1, 10)), ("shared", (3, 10)), (None, (4, 40))])
    python = left.combine(right, lambda k, a, b: [(k, (a, b))], schema="k string, v struct<_1:bigint,_2:bigint>")
    assert rows(python, spark) == rows(columns, spark)


def test_combine_duplicates_on_the_right(spark):
    left, right = valued([("a", 1)]), valued([("a", 10), ("a", 20)])
    block = lambda k, a, b: (k, b)
    with pytest.raises(Exception, match="duplicate key"):
        left.combine(right, block).to_df(spark).collect()

    class Twice:
        def run(self):
            return left.combine(right, block)

    configure(jobs={"Twice": Twice})
    with pytest.raises(DuplicateKey):
        Runner(Twice, spark).run()
    config.reset()
    assert rows(left.combine(right, block, on_duplicate="min"), spark) == Counter([("a", 10)])
    with pytest.raises(InvalidStep):
        left.combine(right, block, on_duplicate="first").to_df(spark)


@pytest.mark.parametrize("step", ["append", "combine", "semi"])
def test_different_partitions(spark, step):
    other = valued([("a", 1)], partitions=4)
    with pytest.raises(IncompatibleFrame):
        job = valued([("a", 1)])
        (job.combine(other, lambda k, a, b: (k, a)) if step == "combine" else getattr(job, step)(other)).to_df(spark)


def test_custom_partitioner_and_range(spark, tmp_path):
    block, read = seen(tmp_path)
    by_letter = lambda k, n: F.ascii(k) % n
    job = keys("banana", "apple", "cherry", "date").repartition(partitions=2, partitioner=by_letter)
    job.each_partition(block).to_df(spark)
    assert {p: [k for k, _ in x] for p, x in read().items()} == {0: ["banana", "date"], 1: ["apple", "cherry"]}
    wrong = keys("a").repartition(partitions=2, partitioner=lambda k, n: F.lit(2))
    with pytest.raises(Exception, match="out of range"):
        wrong.each_partition(lambda p, pairs: None).to_df(spark)


def test_sinks_hand_on_their_input(spark, tmp_path):
    job = keys("a", "b", partitions=2).each_partition(lambda p, pairs: None).dump(prefix=f"{tmp_path}/d").map(lambda k, v: (k, F.lit(1)))
    assert rows(job, spark) == Counter([("a", 1), ("b", 1)])


def test_duplicates_are_kept_and_everything_may_be_dropped(spark):
    assert rows(keys("a", "a", "b"), spark) == Counter({("a", None): 2, ("b", None): 1})
    gone = keys("a", "b").map(lambda k, v: [])
    assert gone.reduce("max").to_df(spark).count() == 0
    assert keys().to_df(spark).count() == 0


def test_async_blocks(spark):
    async def emit(k, v):
        yield k, 1
        yield k, 2

    async def add(k, a, b):
        return a + b

    async def late(k, v):
        return [(k, v + 1)]

    job = keys("a").map(emit, schema="k string, v bigint").reduce(add, python=True).map(late, schema="k string, v bigint")
    assert rows(job, spark) == Counter([("a", 4)])


def test_before_hook(spark, tmp_path):
    def before():
        with open(f"{tmp_path}/hook", "a") as f:
            f.write("x")

    keys("a", "b", partitions=3).each_partition(lambda p, pairs: None, before=before).to_df(spark)
    assert open(f"{tmp_path}/hook").read() == "xxx"
    os.remove(f"{tmp_path}/hook")
    # Where the block is of columns, it runs on the driver, and so does the hook: no Python in the tasks.
    for job in (keys("a").map(lambda k, v: (k, F.lit(1)), before=before), valued([("a", 1)]).reduce("sum", before=before), valued([("a", 1)]).append(valued([]), before=before)):
        frame = job.to_df(spark)
        assert open(f"{tmp_path}/hook").read() == "x" and "Arrow" not in frame._jdf.queryExecution().executedPlan().toString()
        os.remove(f"{tmp_path}/hook")
        assert [tuple(r) for r in frame.collect()] == [("a", 1)]


def test_key_types(spark):
    with pytest.raises(InvalidKey):
        keys("a", 1).to_df(spark)
    with pytest.raises(InvalidKey):
        keys({"a": 1}).to_df(spark)
    with pytest.raises(InvalidKey):
        valued([("a", 1)]).map(lambda k, v: (F.create_map(k, v), v)).to_df(spark)
    assert {tuple(r.k) for r in keys((0, "a"), (1, "a"), (0, "b")).to_df(spark).collect()} == {(0, "a"), (0, "b"), (1, "a")}


def test_options(spark):
    job = keys("a", partitions=4)
    assert job.partitions == 4 and job.partitioner is hash_partitioner and Job().partitions == 0
    assert job.map(numbered).partitions == 4 and job.map(numbered, partitions=2).partitions == 2
    assert [n.jobs for n in job.map(numbered, jobs=9, partitions=2).map(numbered).steps] == [None, 4, 2]
    assert [n.jobs for n in job.map(numbered, jobs=0).steps] == [None, 0]
    assert Job("slow").parallelize(lambda: [], partitions=1).map(numbered, enqueuer="fast").steps[1].enqueuer == "fast"
    assert Job("slow").parallelize(lambda: [], partitions=1).steps[0].enqueuer == "slow"
    assert job.repartition(partitions=2, partitioner=identity_partitioner).steps[-1].action == Action.MAP
    for wrong in (lambda: job.map(numbered, jobs=-1), lambda: keys("a", partitions=0), lambda: Job().map(numbered), lambda: job.map(numbered, schema="a int, b int").to_df(spark)):
        with pytest.raises(InvalidStep):
            wrong()
    with pytest.raises(InvalidStep):
        job.map(lambda k, v: (k, F.lit(1))).reduce("median").to_df(spark)
    before = job.steps
    job.map(numbered)
    assert job.steps == before and len(before) == 1


def test_resolver():
    add = lambda k, a, b: (k, a)
    one = keys("a")
    two = keys("a").combine(one, add)
    three, four = keys("a").combine(two, add), keys("a").combine(one, add)
    assert resolve_jobs([three, four]) == [one.node, two.node, three.node, four.node]
    assert resolve_jobs(one) == [one.node] and resolve_jobs([one, one]) == [one.node]


def test_configuration(spark):
    class A:
        def run(self):
            return []

    config.reset()
    with pytest.raises(PairflowError):
        config.get_config()
    for wrong in ({"": A}, {"x": A, "y": A}):
        with pytest.raises(InvalidJob):
            configure(jobs=wrong)
    configure(jobs={"A": A}, show_progress=False)
    assert config.get_config().class_of("A") is A and configure(jobs={"A": A}).show_progress
    with pytest.raises(InvalidJob):
        config.get_config().class_of("B")
    with pytest.raises(InvalidJob):
        Runner(str, spark)
    runner = Runner(A, spark)
    assert runner.run() == []
    runner.stop()
    with pytest.raises(JobStopped):
        runner.run()
    config.reset()


def test_stores(spark, tmp_path):
    for store, top in ((MemoryStore("pre"), "pre"), (HadoopStore(spark, str(tmp_path)), str(tmp_path))):
        name = store.with_prefix("a/b.json")
        assert name == f"{top}/a/b.json" and not store.exists(name) and store.list(f"{top}/a") == []
        store.store(name, "één\n")
        assert store.exists(name) and store.value(name) == "één\n" and len(store.list(f"{top}/a")) == 1
        store.download(name, f"{tmp_path}/file")
        assert open(f"{tmp_path}/file", encoding="utf-8").read() == "één\n"
        for missing in (store.value, lambda n: store.download(n, f"{tmp_path}/other")):
            with pytest.raises(NoSuchObject):
                missing(store.with_prefix("none"))
    assert MemoryStore().with_prefix("x") == "x"


def test_idioms(spark):
    left, right = valued([("a", 1), ("b", 2), ("b", 3), (None, 4)]), valued([("b", 20), ("c", 30), (None, 40), ("b", 21)])
    assert rows(left.inner(right), spark) == Counter([("b", (2, 20)), ("b", (2, 21)), ("b", (3, 20)), ("b", (3, 21)), (None, (4, 40))])
    assert rows(left.semi(right), spark) == Counter([("b", 2), ("b", 3), (None, 4)])
    assert rows(left.anti(right), spark) == Counter([("a", 1)])
    assert rows(left.full_outer(right), spark)[("c", (None, 30))] == 1
    assert rows(left.left_outer(right), spark)[("a", (1, None))] == 1
    assert rows(left.count(), spark) == Counter([("a", 1), ("b", 2), (None, 1)])
    assert rows(left.average(), spark) == Counter([("a", 1.0), ("b", 2.5), (None, 4.0)])
    assert rows(left.min(), spark)[("b", 2)] and rows(left.max(), spark)[("b", 3)] and rows(left.sum(), spark)[("b", 5)]
    assert [(r.k, r.v) for r in left.top(2, lambda k, v: [F.desc(v)]).to_df(spark).collect()] == [(None, 4), ("b", 3)]
    assert rows(left.filter(lambda k, v: v > 2), spark) == Counter([("b", 3), (None, 4)])
    assert rows(left.union_distinct(left), spark) == rows(left, spark)
    assert rows(left.intersect(left.filter(lambda k, v: v == 1)), spark) == Counter([("a", 1)])
    assert rows(left.subtract(left.filter(lambda k, v: v > 1)), spark) == Counter([("a", 1)])
    assert {r.k for r in left.distinct_keys().to_df(spark).collect()} == {"a", "b", None}
    collected = left.collect().to_df(spark)
    assert {r.k: r.v for r in collected.collect()}["b"] == [2, 3]


def test_filters_reach_the_scan(spark, sf):
    frame = Job().scan(lambda s: s.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey", "l_quantity", partitions=4).map(lambda k, v: (k, v, v > 45)).to_df(spark)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45" in plan.replace(" ", "") and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_wordcount_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 1000
