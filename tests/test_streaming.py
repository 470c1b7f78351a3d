"""The streaming forms give what the batch forms give, over several files and restarts."""

import time

import pytest
from pyspark.sql import functions as F

from datadict import streaming
from datadict.operators import filters, relations

KEY = ["schema_name", "table_name", "column_name"]
SCHEMA = "event_id long, ts timestamp_ntz, schema_name string, table_name string, column_name string, elapsed double"


@pytest.fixture()
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(3000).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts",
        "if(id % 3 = 0, 'hot', concat('s', id % 5)) as schema_name", "concat('t', id % 7) as table_name",
        "'c' as column_name", "id % 20 / 10D as elapsed")
    df.repartition(6).write.parquet(path)
    return path


def stream(spark, log, files=2):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(log)


def test_once_per_key(spark, log):
    got = streaming.run_available(streaming.once_per_key(stream(spark, log), KEY, "event_id", salts=8), "once")
    want = relations.first_warnings(spark.read.parquet(log)).select(*KEY)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_once_within_watermark(spark, log):
    got = streaming.run_available(
        streaming.once_per_key_within(stream(spark, log), KEY, "ts", "1 day", "event_id", salts=8), "within")
    assert sorted(map(tuple, got.collect())) == sorted(
        map(tuple, spark.read.parquet(log).select(*KEY).distinct().collect()))


def test_slow_alerts(spark, log):
    got = streaming.run_available(streaming.slow_alerts(stream(spark, log)), "slow")
    want = filters.slow_extracts(spark.read.parquet(log))
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in want.collect())


def test_late_rows_and_evicted_state(spark, tmp_path):
    """One file per batch: a key comes again after its state is gone, a late row never.

    The watermark that the second batch moves is that of the third, which drops old state at its end.
    """
    path = str(tmp_path / "log")
    batches = [[("a", 0, 1), ("b", 1, 2), ("a", 2, 3)], [("a", 5, 4), ("c", 100, 5)], [("c", 102, 6)], [("d", 3, 7), ("a", 103, 8), ("c", 104, 9)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, f"2024-01-01 00:{s // 60:02}:{s % 60:02}", e) for k, s, e in rows], "k string, t string, e long")
        df.selectExpr("k", "cast(t as timestamp) as t", "e").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the files' times tell their order
    source = spark.readStream.schema("k string, t timestamp, e long").option("maxFilesPerTrigger", 1).parquet(path)
    got = streaming.run_available(streaming.once_per_key_within(source, ["k"], "t", "10 seconds", "e", salts=4), "late")
    assert sorted(r["k"] for r in got.collect()) == ["a", "a", "b", "c"]


def test_hot_key_goes_to_many_tasks(spark, log):
    """A third of the rows has one key; no task of the first shuffle gets a third."""
    df = spark.read.parquet(log).withColumn("table_name", F.when(F.col("schema_name") == "hot", "t").otherwise(F.col("table_name")))
    assert df.where("schema_name = 'hot'").count() >= df.count() // 3
    dealt = streaming.salted(df, KEY, "event_id", streaming.SALTS).repartition(32, *KEY, "_salt")
    most = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < df.count() / 6
