"""Streams give what the batch gives."""

import pytest
from pyspark.sql import functions as F

from pairflow import InvalidStep
from pairflow.streaming.pairs import stream_map, stream_reduce


def test_windowed_reduce(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    spark.conf.set("spark.sql.streaming.schemaInference", "false")
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    pairs = stream.select(F.col("event_type").alias("k"), F.col("user_id").alias("v"), F.col("ts").cast("timestamp").alias("ts"))
    doubled = stream_map(pairs, lambda k, v: [(k, v), (F.lit("all"), v, v > 0)], time="ts")
    found = stream_reduce(doubled, "sum", "ts", "1 hour", "10 minutes")
    running = found.writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", f"{tmp_path}/c").start()
    running.processAllAvailable()
    running.stop()
    expected = batch.withColumn("start", F.date_trunc("hour", F.col("ts").cast("timestamp"))).groupBy("start").agg(F.sum("user_id").alias("v"))
    got = {r.start: r.v for r in spark.sql("select * from windowed where k = 'all'").collect()}
    assert got == {r.start: r.v for r in expected.collect() if r.v}
    with pytest.raises(InvalidStep):
        stream_reduce(doubled, "median", "ts", "1 hour", "1 hour")


def test_stream_map_without_time(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, v int").parquet(f"{tmp_path}/in")
    running = stream_map(stream, lambda k, v: (k, v + 1, v > 1)).writeStream.format("memory").queryName("mapped").option("checkpointLocation", f"{tmp_path}/c").start()
    running.processAllAvailable()
    running.stop()
    assert [(r.k, r.v) for r in spark.sql("select * from mapped").collect()] == [("b", 3)]
