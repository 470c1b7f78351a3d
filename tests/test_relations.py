"""Joins and aggregates on small relations that show each rule."""

import pytest
from pyspark.sql import functions as F

from datadict.operators import relations as rel


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_comment_comes_from_the_table_of_the_same_schema(spark):
    tables = spark.createDataFrame([("s", "a", "t"), ("s", "b", "t"), ("s", "b", "u"), ("z", "a", "t")],
                                   "source_id string, schema_name string, table_name string")
    classes = spark.createDataFrame([("s", 1, 10, "t", "of a"), ("s", 2, 20, "t", "of b"), ("z", 1, 10, "t", None)],
                                    "source_id string, oid long, relnamespace long, relname string, description string")
    spaces = spark.createDataFrame([("s", 10, "a"), ("s", 20, "b"), ("z", 10, "a")],
                                   "source_id string, oid long, nspname string")
    got = rel.with_class(tables, classes, spaces)
    assert rows(got, "source_id", "schema_name", "table_name", "description") == {
        ("s", "a", "t", "of a"), ("s", "b", "t", "of b"), ("s", "b", "u", None), ("z", "a", "t", None)}


ATTRIBUTES = [(1, 0, "sys", False), (1, 1, "a", False), (1, 2, "gone", True), (1, 3, "c", False), (1, 4, "d", False),
              (2, 1, "p", False), (2, 2, "q", False)]


def attributes(spark):
    return spark.createDataFrame(ATTRIBUTES, "oid long, attnum int, attname string, attisdropped boolean")


def indexes(spark):
    return spark.createDataFrame(
        [(1, "pk", "1", True, True), (1, "uq", "1 3", False, True), (1, "ix", "3 0 4", False, False),
         (1, "dead", "2", False, True)],
        "oid long, index_name string, indkey string, indisprimary boolean, indisunique boolean")


def test_index_members_keep_order_and_skip_expressions(spark):
    got = rel.index_members(indexes(spark), attributes(spark))
    assert rows(got, "index_name", "at", "attname") == {
        ("pk", 0, "a"), ("uq", 0, "a"), ("uq", 1, "c"), ("ix", 0, "c"), ("ix", 2, "d")}


def test_strongest_key_wins(spark):
    got = rel.column_keys(indexes(spark), attributes(spark))
    assert rows(got, "oid", "column_name", "column_key") == {
        (1, "a", "PRI"), (1, "c", "UNI"), (1, "d", "MUL"), (2, "p", None), (2, "q", None)}


def test_constraint_columns_in_declared_order(spark):
    constraints = spark.createDataFrame(
        [(1, "fk", "f", "4 1", "2 1", 2), (1, "pk", "p", "2 3", None, None), (1, "ck", "c", None, None, None)],
        "oid long, conname string, contype string, conkey string, confkey string, confrelid long")
    got = {r["conname"]: (r["local_columns"], r["ref_columns"])
           for r in rel.with_column_names(constraints, attributes(spark)).collect()}
    assert got == {"fk": (["d", "a"], ["q", "p"]), "pk": (["c"], []), "ck": ([], [])}


def test_indexes_without_constraint(spark):
    constraints = spark.createDataFrame([("pk", "p"), ("uq", "u"), ("ix", "c")], "index_name string, contype string")
    assert rows(rel.without_constraint(indexes(spark), constraints, ["p"]), "index_name") == {("uq",), ("ix",), ("dead",)}
    assert rows(rel.without_constraint(indexes(spark), constraints, ["p", "u"]), "index_name") == {("ix",), ("dead",)}


USAGE = [(1, "fk", "b", 2, "t", "y"), (1, "fk", "a", 1, "t", "x"), (2, "fk", "m", 1, "u", "z"),
         (1, "PRIMARY", "a", 1, None, None), (1, "lost", "a", 1, "t", "x")]
USAGE_SCHEMA = ("oid long, constraint_name string, column_name string, ordinal_position int,"
                " referenced_table_name string, referenced_column_name string")


def test_composite_foreign_keys_are_paired(spark):
    usage = spark.createDataFrame(USAGE, USAGE_SCHEMA)
    rules = spark.createDataFrame([("fk", "CASCADE", "NO ACTION")],
                                  "constraint_name string, delete_rule string, update_rule string")
    got = rel.foreign_keys(usage, rules).collect()
    assert {(r["oid"], r["constraint_column"], r["reference"], tuple(r["ref_columns"]), r["delete_action"])
            for r in got} == {(1, "a, b", "t.x", ("x", "y"), "CASCADE"), (2, "m", "u.z", ("z",), "CASCADE")}
    by_reference = rel.foreign_keys_by_reference(usage, rules)
    assert rows(by_reference, "oid", "constraint_column", "reference") == {
        (1, "a", "t.x"), (1, "b", "t.y"), (2, "m", "u.z")}
    assert rows(rel.first_references(usage.where("constraint_name = 'fk'")), "oid", "reference") == {
        (1, "t.x"), (2, "u.z")}


def test_usage_of_equal_names_on_two_tables_does_not_mix(spark):
    usage = spark.createDataFrame(USAGE, USAGE_SCHEMA)
    declared = spark.createDataFrame([(1, "fk", "FOREIGN KEY"), (2, "fk", "FOREIGN KEY"), (1, "lost", "CHECK")],
                                     "oid long, constraint_name string, constraint_type string")
    rules = spark.createDataFrame([("fk", "CASCADE", "NO ACTION"), ("lost", "CASCADE", "CASCADE")],
                                  "constraint_name string, delete_rule string, update_rule string")
    local = usage.select("oid", "constraint_name", "ordinal_position", "column_name")
    remote = usage.select("oid", "constraint_name", "ordinal_position", "referenced_table_name", "referenced_column_name")
    got = rel.fk_usage_paired(declared, local, remote, rules)
    assert rows(got, "oid", "column_name", "referenced_table_name", "referenced_column_name") == {
        (1, "a", "t", "x"), (1, "b", "t", "y"), (2, "m", "u", "z")}


def test_long_lists_are_one_row(spark):
    statistics = spark.range(1, 10_001).select(
        F.lit(1).alias("oid"), F.lit("ix").alias("index_name"), F.lit(1).alias("non_unique"),
        F.concat(F.lit("c"), "id").alias("column_name"), F.col("id").cast("int").alias("seq_in_index"))
    want = ",".join(f"c{i}" for i in range(1, 10_001))
    for size in (7, 4096, 1 << 20):
        assert [r["index_columns"] for r in rel.listed_indexes(statistics.repartition(5), size=size).collect()] == [want]


@pytest.mark.parametrize("size", [10, 4096])
def test_long_foreign_key_names_a_column_once(spark, size):
    """A column that comes again in a later slice is left out; the reference is that of the first pair."""
    usage = spark.range(1, 26).select(
        F.lit(1).alias("oid"), F.lit("fk").alias("constraint_name"), F.concat(F.lit("c"), F.col("id") % 20).alias("column_name"),
        F.col("id").cast("int").alias("ordinal_position"), F.lit("t").alias("referenced_table_name"),
        F.concat(F.lit("r"), "id").alias("referenced_column_name"))
    rules = spark.createDataFrame([("fk", "CASCADE", "NO ACTION")],
                                  "constraint_name string, delete_rule string, update_rule string")
    (got,) = rel.foreign_keys(usage, rules, size=size).collect()
    assert got["reference"] == "t.r1" and got["constraint_column"] == ", ".join(f"c{i % 20}" for i in range(1, 21))
    assert got["ref_columns"] == [f"r{i}" for i in range(1, 26)]


def test_list_members_without_place_or_value(spark):
    df = spark.createDataFrame([(1, "ix", 0, "b", 2), (1, "ix", 0, None, 3), (1, "ix", 0, "z", None), (2, "iy", 1, None, 1)],
                               "oid long, index_name string, non_unique int, column_name string, seq_in_index int")
    assert rows(rel.listed_indexes(df, size=1), "oid", "index_columns") == {(1, "z,b"), (2, "")}


def test_column_numbers_close_gaps(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 9000, "c"), (2, 3, "x")],
                               "oid long, ordinal_position int, name string")
    assert rows(rel.numbered_columns(df), "oid", "name", "no") == {(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "x", 0)}


def test_warnings_once(spark):
    log = spark.createDataFrame([(3, "s", "t", "c"), (1, "s", "t", "c"), (2, "s", "t", "d")],
                                "event_id long, schema_name string, table_name string, column_name string")
    assert rows(rel.first_warnings(log), "column_name", "first_event_id", "occurrences") == {("c", 1, 2), ("d", 2, 1)}


def test_constraints_without_reference_are_spread(spark):
    """Null and 0 in `confrelid` are no hot key: each row has a key of its own, below zero."""
    n = 5000
    constraints = spark.range(n).selectExpr(
        "id as oid", "concat('k', id) as conname", "if(id % 10 = 0, 'f', 'c') as contype",
        "case when id % 10 = 0 then 7L when id % 2 = 0 then 0L end as confrelid")
    classes = spark.createDataFrame([(7, 1, "t"), (0, 1, "zero")], "oid long, relnamespace long, relname string")
    spaces = spark.createDataFrame([(1, "s")], "oid long, nspname string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = rel.with_referenced_table(constraints, classes, spaces)
        assert got.columns == [*constraints.columns, "ref_schema", "ref_table"]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_referenced" in plan and "hashpartitioning(confrelid" not in plan
        shown = got.groupBy("contype", "ref_schema", "ref_table").count().collect()
        spread = got.where("contype = 'c'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert spread < 2 * n * 0.9 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, shown)) == [("c", None, None, n * 9 // 10), ("f", "s", "t", n // 10)]


def test_columns_and_attributes_are_not_broadcast(spark, sf_dir):
    """Attributes are as many as the columns, so no side is sent whole, however small its file is."""
    from datadict.sources.fixtures import Catalog

    dump = Catalog(spark, sf_dir).stored().postgres()
    plan = rel.live_columns(dump["columns"], dump["attributes"])._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
