"""Writers: text documents per schema, nested records, and flat CSV per child table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datadict.plans.dictionary import TABLE, Dictionary, records
from datadict.plans.documents import DOCUMENT, ORDER
from datadict.sources.dumps import CSV_OPTIONS, read_csv
from datadict.storage import store


def write_documents(document_lines: DataFrame, path: str) -> None:
    """`path/source_id=.../schema_name=.../part-*`, overwritten.

    Range partitioning on the full line key spreads a large document over many tasks. Its files in
    name order are the document; a small document is one file, or two where a range ends in it.

    The lines are stored first. Of a constant `source_id` (one server) Spark would drop the sort key,
    then miss the order the writer asks for, and sort again by directory alone, which loses the order
    of the lines; a stored column is never constant to it. Sampling the ranges is then a cheap read.
    """
    stored = store(document_lines.select(*DOCUMENT, *ORDER, "line"), "lines")
    filled = stored.withColumns({c: F.coalesce(c, F.lit("")) for c in DOCUMENT})
    ordered = filled.repartitionByRange(*DOCUMENT, *ORDER).sortWithinPartitions(*DOCUMENT, *ORDER)
    ordered.select(*DOCUMENT, "line").write.mode("overwrite").partitionBy(*DOCUMENT).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Lines of written documents with their place in the files: source, schema, position, line.

    A document is its files in name order. Inside a file, lines follow the start of the block that a
    task reads, and inside a block the order in which the reader meets them. So the lines of a block have numbers
    one after the other, and need only the sizes of the blocks before theirs; no line is shuffled or sorted.
    """
    kinds = ", ".join(f"{c} string" for c in ("value", *DOCUMENT))
    read = spark.read.schema(kinds).text(path).select(
        *DOCUMENT, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    kept = store(read, "read")  # row numbers are those of this one reading
    place = [*DOCUMENT, "file", "block"]
    blocks = kept.groupBy(*place).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy(*DOCUMENT).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    marks = store(blocks.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size"), "blocks")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}")) for c in place])
    return kept.alias("r").join(marks.alias("m"), same).select(
        *[F.col(f"r.{c}") for c in DOCUMENT], (F.col("row") - F.col("first") + F.col("before") + 1).cast("bigint").alias("position"),
        "line")


def write_records(d: Dictionary, path: str) -> None:
    """Nested records, one directory per source."""
    records(d).write.mode("overwrite").partitionBy("source_id").parquet(path)


# Columns of the sheets that are numbers; all others are texts.
SHEET_NUMBERS = {"columns": {"ordinal_position": "int"}, "indexes": {"non_unique": "int"}}


def write_sheets(d: Dictionary, path: str) -> None:
    """Flat CSV per child table for spreadsheet users. A null is nothing, an empty text is `""`."""
    for name in d.present:
        df = getattr(d, name)
        key = [c for c in TABLE if c != "source_id"]
        rest = [c for c in df.columns if c not in TABLE]
        df.select(*key, *rest, "source_id").write.mode("overwrite").partitionBy("source_id") \
            .options(**CSV_OPTIONS).csv(f"{path}/{name}")


def read_sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A sheet as it was written: nulls, empty texts, line breaks and numbers come back."""
    df = read_csv(spark, f"{path}/{name}")
    kinds = {"source_id": "string", **SHEET_NUMBERS.get(name, {})}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
