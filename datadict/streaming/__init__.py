"""Streaming forms of the two behaviours of an extraction run: warn once, and flag slow tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datadict.operators.filters import slow_extracts
from datadict.storage import place

SALTS = 64


def salted(stream: DataFrame, keys: Sequence[str], spread_by: str, salts: int, *kept: str) -> DataFrame:
    """The keys with a salt, so that the rows of a hot key go to many tasks."""
    return stream.select(*keys, *kept, F.pmod(F.xxhash64(spread_by), F.lit(salts)).alias("_salt"))


def once_per_key(stream: DataFrame, keys: Sequence[str], spread_by: str, salts: int = SALTS) -> DataFrame:
    """Each key once for the life of the query, as rows of the keys.

    A stream cannot pre-aggregate before its shuffle, so a hot key is first made unique per salt,
    over many tasks, and at most `salts` rows of it reach the task that keeps the key. State is
    bounded by the number of keys.
    """
    dealt = salted(stream, keys, spread_by, salts)
    return dealt.dropDuplicates([*keys, "_salt"]).select(*keys).dropDuplicates(list(keys))


def once_per_key_within(stream: DataFrame, keys: Sequence[str], time: str, delay: str, spread_by: str,
                        salts: int = SALTS) -> DataFrame:
    """For a stream without end: a key is repeated only after the watermark has passed its first row.

    Two stateful operators in a row: once per key and salt, then once per key; the watermark goes on
    from the first to the second. At most `salts` rows of a key and watermark reach its task. Rows
    older than the watermark are dropped, and state older than the delay. A key may come again when its
    state and that of the row's salt are gone, so it never comes earlier than without salts.
    `withWatermark` needs a timestamp with time zone.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    first = salted(timed, keys, spread_by, salts, time).dropDuplicatesWithinWatermark([*keys, "_salt"])
    return first.select(*keys, time).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def slow_alerts(stream: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Stateless: the same filter as in batch."""
    return slow_extracts(stream, seconds)


def read_files(spark: SparkSession, directory: str, file_name: str) -> DataFrame:
    """A table's file (or files of that name) as a stream."""
    schema = spark.read.parquet(f"{directory}/{file_name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(directory)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there, into a table in the shared folder, and read it back."""
    spark = stream.sparkSession
    root = place(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
