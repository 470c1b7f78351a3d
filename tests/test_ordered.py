"""Positions in groups of any size, with one group holding most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from datadict.operators import ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(6000):
        group = "hot" if i % 3 else f"g{rng.randrange(200)}"
        out.append((group, rng.randrange(10 ** 6) * 10 + i % 10, f"n{rng.randrange(10 ** 9):09d}-{i}", rng.randrange(5)))
    return out


def expected(rows, key):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    return {g: sorted(rs, key=key) for g, rs in groups.items()}


SCHEMA = "g string, pos bigint, name string, w int"


@pytest.mark.parametrize("span", [1, 1000, 1 << 40])
def test_number_rows(spark, rows, span):
    df = spark.createDataFrame(rows, SCHEMA)
    got = ordered.number_rows(df, ["g"], ["pos", "name"], F.floor(F.col("pos") / span)).collect()
    want = {r: i for rs in expected(rows, lambda r: (r[1], r[2])).values() for i, r in enumerate(rs, 1)}
    assert {(r["g"], r["pos"], r["name"], r["w"]): r["rn"] for r in got} == want


def test_small_groups_are_not_counted_one_by_one(spark):
    """Only groups in a bucket of more than `hot` rows are counted; small ones never reach a shuffle on the group."""
    df = spark.createDataFrame([(i % 40, i) for i in range(400)] + [(99, i) for i in range(60)], "g bigint, pos bigint")
    assert [r["g"] for r in ordered._hot_groups(df, ["g"], 50).collect()] == [99]
    assert ordered._hot_groups(df, ["g"], 60).count() == 0
    got = ordered.number_rows(df, ["g"], ["pos"], F.floor(F.col("pos") / 7), hot=50).collect()
    assert {(r["g"], r["pos"]): r["rn"] for r in got} == {
        **{(i % 40, i): i // 40 + 1 for i in range(400)}, **{(99, i): i + 1 for i in range(60)}}
    plan = ordered.number_rows(df, ["g"], ["pos"], F.floor(F.col("pos") / 7))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_bucket") > 0


def test_number_rows_puts_null_positions_first(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("a", 1)], "g string, pos int")
    got = ordered.number_rows(df, ["g"], ["pos"], ordered.slice_of(F.col("pos"), 2)).collect()
    assert sorted((r["rn"], r["pos"]) for r in got) == [(1, None), (2, 1), (3, 5)]


def test_number_rows_by_range(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ordered.number_rows_by_range(df, ["g"], ["name"], "at").collect()
    want = {r[2]: i for rs in expected(rows, lambda r: r[2]).values() for i, r in enumerate(rs, 1)}
    assert {r["name"]: r["at"] for r in got} == want


def test_sum_before(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ordered.sum_before(df, ["g"], ["name"], "w", "before").collect()
    want = {}
    for rs in expected(rows, lambda r: r[2]).values():
        total = 0
        for r in rs:
            want[r[2]] = total
            total += r[3]
    assert {r["name"]: r["before"] for r in got} == want


def test_hot_group_spreads_over_slices(spark, rows):
    df = spark.createDataFrame(rows * 4, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        slices = ordered.arrange(df, ["g"], ["name"]).where("g = 'hot'").select("_slice").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert slices > 2


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_lists_of_slices(spark, size):
    df = spark.createDataFrame([(g, p, f"v{p % 4}") for g in ("a", "b") for p in range(1, 12 if g == "a" else 2)],
                               "g string, at int, v string").repartition(4)
    got = {r["g"]: [tuple(m) for m in r["m"]] for r in ordered.ordered_lists(df, ["g"], "at", ["v"], "m", size).collect()}
    assert got == {"a": [(p, f"v{p % 4}") for p in range(1, 12)], "b": [(1, "v1")]}


@pytest.mark.parametrize("hot", [1, 5, 1 << 40])
def test_number_rows_cuts_only_hot_groups(spark, rows, hot):
    df = spark.createDataFrame([*rows, (None, 1, "no group", 0)], SCHEMA)
    got = ordered.number_rows(df, ["g"], ["pos", "name"], F.floor(F.col("pos") / 3), hot=hot).collect()
    want = {r: i for rs in expected(rows, lambda r: (r[1], r[2])).values() for i, r in enumerate(rs, 1)}
    assert {(r["g"], r["pos"], r["name"], r["w"]): r["rn"] for r in got} == want


def test_number_rows_shuffles_rows_once(spark, tmp_path):
    """Slice sizes of hot groups are few: the numbered rows meet them by a broadcast."""
    spark.range(1000).selectExpr("id % 7 as g", "id as pos", "cast(id as string) as name").write.parquet(f"{tmp_path}/rows")
    got = ordered.number_rows(spark.read.parquet(f"{tmp_path}/rows"), ["g"], ["pos"], F.col("pos"), hot=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and got.count() == 1000


def test_arranged_rows_are_stored_by_column(spark):
    """Numbering reads only the group and the row of what it counts, so rows are files, not a checkpoint of whole rows."""
    plan = ordered.arrange(spark.range(50).selectExpr("id % 3 as g", "id as name"), ["g"], ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan
