"""Session settings. A cluster sets its own; `local` is for tests, the bench and small runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the plans count on. They are Spark's defaults except the skew-join force, which lets a
# split join keep its split although the next operator then needs a shuffle.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call-site capture for error messages costs several milliseconds per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local(cpus: str | int = "*", memory: str = "8g", **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("datadict")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        # Small data, heavy rows: the usual least size of 1 MB would leave most cores idle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        # Lists of many small groups stay in the hash map; a cluster keeps the memory-safe default.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
    )
    for name, value in {**ADAPTIVE, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
