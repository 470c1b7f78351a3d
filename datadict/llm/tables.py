"""Intermediate tables that an operator removes after use, and filters of fixed size sent to tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datadict.storage import place


class Scratch:
    """Tables in the shared folder, written once and read back with their sizes known."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = place(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove the tables written so far. Only for tables that no returned DataFrame reads."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in self.paths:
            where = hadoop.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []


FIELD_SLOTS = 1 << 22


def slot_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(FIELD_SLOTS)).cast("int")


def bit_field(values: DataFrame, column: str) -> np.ndarray:
    """Which slots the values take: half a megabyte, whatever their number. A filter with false positives only."""
    slots = values.select(slot_of(F.col(column)).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 31)")).alias("bits"))
    field = np.zeros(FIELD_SLOTS // 32, np.uint32)
    for r in words.collect():  # at most FIELD_SLOTS / 32 rows
        field[r["at"]] = r["bits"]
    return field


def in_field(field: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (field[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1 == 1
