"""A table, an index and a key that hold a third of all rows do not become one task's work."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from datadict.operators import ordered, relations
from datadict.sources import fixtures

N = 60000


@pytest.fixture(scope="module")
def skewed_dir(spark, sf_dir, tmp_path_factory):
    """The given lineitem with a third of its rows moved to one part and one order."""
    path = str(tmp_path_factory.mktemp("skew"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("u", F.xxhash64("*"))
    hot = F.pmod("u", F.lit(3)) == 0
    rows.withColumn("l_partkey", F.when(hot, 7).otherwise(F.col("l_partkey"))).drop("u").write.parquet(
        f"{path}/lineitem.parquet")
    return path


def test_numbered_views_on_a_hot_key(spark, skewed_dir, monkeypatch):
    """Small slices: the numbering equals a plain window over whole groups."""
    monkeypatch.setattr(fixtures, "SLICE_SPAN", 50)
    spec = fixtures.VIEWS["cat_columns"]
    got = fixtures.Catalog(spark, skewed_dir).view("cat_columns")
    lineitem = spark.read.parquet(f"{skewed_dir}/lineitem.parquet")
    plain = lineitem.withColumn("rn", F.row_number().over(
        Window.partitionBy(*spec.group).orderBy(*spec.order))).selectExpr(*spec.select)
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    assert got.where("oid = 7").count() > lineitem.count() // 4


def test_no_slice_is_large(spark):
    """A third of the rows has one key, yet no window group is larger than a slice."""
    df = spark.range(N).selectExpr("if(id % 3 = 0, 0, id) as g", "id as pos")
    sliced = df.groupBy("g", F.floor(F.col("pos") / 1000)).count().agg(F.max("count")).first()[0]
    assert sliced <= 1000
    numbered = ordered.number_rows(df, ["g"], ["pos"], F.floor(F.col("pos") / 1000))
    assert numbered.where("g = 0").agg(F.max("rn"), F.countDistinct("rn")).first()[:] == (N // 3, N // 3)


def test_range_slices_are_even(spark):
    df = spark.range(N).selectExpr("if(id % 3 = 0, 'hot', concat('g', id)) as g", "concat('n', id) as name")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ordered.arrange(df, ["g"], ["name"]).groupBy("_slice").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == N and max(sizes) < 2 * N / len(sizes)


def test_hot_index_is_one_row(spark):
    """Slices are sorted by several tasks; the list is one row with every member in order."""
    df = spark.range(1, N + 1).selectExpr(
        "1 as oid", "'ix' as index_name", "1 as non_unique", "concat('c', id) as column_name",
        "cast(id as int) as seq_in_index").repartition(8)
    listed = relations.listed_indexes(df)
    assert [r["index_columns"].split(",") for r in listed.collect()] == [[f"c{i}" for i in range(1, N + 1)]]
    slices = df.groupBy("oid", ordered.slice_of(F.col("seq_in_index"))).count().agg(F.max("count")).first()[0]
    assert slices == ordered.LIST_SLICE


def test_key_ranks_are_reduced_before_the_join(spark):
    """Many indexes on one column reach the join as one row."""
    indexes = spark.range(N).selectExpr("1L as oid", "concat('i', id) as index_name", "'1' as indkey",
                                        "false as indisprimary", "id = 5 as indisunique")
    attributes = spark.createDataFrame([(1, 1, "a", False)], "oid long, attnum int, attname string, attisdropped boolean")
    keys = relations.column_keys(indexes, attributes)
    assert [tuple(r) for r in keys.collect()] == [(1, "a", "UNI")]
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def test_stored_columns_are_those_of_the_dialect(spark, sf_dir):
    """A build of one dialect stores, and so numbers, no columns of the other."""
    whole = fixtures.Catalog(spark, sf_dir).view("cat_columns")
    for dialect, rule in (("postgres", fixtures.IS_POSTGRES), ("mysql", f"not ({fixtures.IS_POSTGRES})")):
        stored = fixtures.Catalog(spark, sf_dir).stored().of_dialect("cat_columns", dialect)
        kept = spark.read.schema(stored.schema).parquet(*{f.rsplit("/", 1)[0] for f in stored.inputFiles()})
        assert kept.count() == whole.where(rule).count()
        assert kept.exceptAll(whole.where(rule)).count() == 0
