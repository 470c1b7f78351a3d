"""Dictionary of lake data sets: what is in the schema, and what is in the rows.

All columns of all data sets go through one two-level aggregation: (column, value) counts, which
Spark reduces before its shuffle so that a frequent value costs one row per task, then one row per
column. Long values are compared by SHA-256, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG = 64  # bytes; a hashed key has 65 characters, so it never equals a short value

_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
           "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def stored_bytes(field: T.StructField) -> Column:
    """Bytes of one value: text length, the width of a number, widths times the elements of an array."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType):
        return F.octet_length(column)
    if isinstance(kind, T.BinaryType):
        return F.octet_length(column)
    if isinstance(kind, T.ArrayType):
        width = _WIDTHS.get(kind.elementType.simpleString())
        if width is not None:
            return F.when(column.isNotNull(), F.size(column) * width)
        return F.octet_length(F.to_json(column))
    if isinstance(kind, T.DecimalType):
        return F.when(column.isNotNull(), F.lit(8 if kind.precision <= 18 else 16))
    return F.when(column.isNotNull(), F.lit(_WIDTHS.get(kind.simpleString(), 8)))


def value_key(field: T.StructField) -> Column:
    """Text that is equal for equal values; null for null."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = (column + F.lit(0).cast(kind)).cast("string")  # -0.0 and 0.0 are one value
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(column)
    elif isinstance(kind, T.BinaryType):
        text = F.hex(column)
    else:
        text = column.cast("string")
    return F.when(F.octet_length(text) > _LONG, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def schema_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, ordinal, column, type, nullable) as the readers see them, with a number for each column."""
    spark = next(iter(tables.values())).sparkSession
    fields = [(name, at, f) for name, df in tables.items() for at, f in enumerate(df.schema.fields, 1)]
    rows = [(i, name, at, f.name, f.dataType.simpleString(), f.nullable) for i, (name, at, f) in enumerate(fields)]
    return spark.createDataFrame(
        rows, "column_no int, table_name string, ordinal_position int, column_name string, type_text string,"
              " nullable boolean")


def _cells(first: int, df: DataFrame) -> DataFrame:
    """One row per column and row: number of the column, value key, bytes."""
    fields = df.schema.fields
    prepared = df.select(
        *[value_key(f).alias(f"k{i}") for i, f in enumerate(fields)],
        *[stored_bytes(f).cast("bigint").alias(f"b{i}") for i, f in enumerate(fields)])
    triples = ", ".join(f"{first + i}, k{i}, b{i}" for i in range(len(fields)))
    return prepared.select(F.expr(f"stack({len(fields)}, {triples}) as (column_no, value_key, value_bytes)"))


def column_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, nulls, distinct values and bytes of every column, by its number in `schema_rows`."""
    parts, first = [], 0
    for df in tables.values():
        parts.append(_cells(first, df))
        first += len(df.columns)
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("column_no", "value_key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value_bytes").alias("b"))
        .groupBy("column_no")
        .agg(F.sum("n").cast("bigint").alias("row_count"),
             F.coalesce(F.sum(F.when(F.col("value_key").isNull(), F.col("n"))), F.lit(0)).cast("bigint")
             .alias("null_count"),
             F.count("value_key").cast("bigint").alias("distinct_count"),
             F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("byte_count"))
    )


def dictionary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Schema rows with their profile; a column of an empty data set has zeros."""
    joined = schema_rows(tables).join(column_profile(tables), "column_no", "left").drop("column_no")
    return joined.fillna(0, ["row_count", "null_count", "distinct_count", "byte_count"])
