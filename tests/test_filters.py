"""Filters against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from datadict.operators import filters
from datadict.schemas import normalise_dialect


def like(name, pattern, dialect):
    """Brute force: a walk over the pattern's tokens, letters compared one by one."""
    tokens = re.findall(r"\\.|[%_]|[^\\]", pattern, re.S)

    def same(a, b):
        fold = lambda x: x.lower().replace("ς", "σ")
        return fold(a) == fold(b) if dialect == "mysql" else a == b

    places = {0}
    for t in tokens:
        if t == "%":
            places = {j for i in places for j in range(i, len(name) + 1)}
        else:
            places = {i + 1 for i in places if i < len(name) and (t == "_" or same(name[i], t[-1]))}
    return len(name) in places


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    words = ["t", "tmp", "log", "Order", "user", "x", "y1", "", "*", "a_b", "100%", "ΑΣΒ", "ΑΣ", "가", "é"]
    made = {"_".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(400)}
    made = sorted(made) + ["_", "_x", "x_", "%", "", None]
    return [(i, n, rng.choice(["mysql", "postgres"])) for i, n in enumerate(made)]


PATTERNS = ["tmp_%", "LOG%", "%user%", "t_", "____", "*", "%\\_b", "x%y", "Order"]


def frame(spark, names):
    return spark.createDataFrame(names, "oid int, table_name string, dialect string")


def kept(names, patterns):
    return {i for i, n, d in names if n is None or not any(like(n, p, d) for p in patterns)}


def test_exclude_like(spark, names):
    got = filters.exclude_like(frame(spark, names), PATTERNS)
    assert {r["oid"] for r in got.collect()} == kept(names, PATTERNS)
    assert filters.exclude_like(frame(spark, names), []).count() == len(names)


@pytest.mark.parametrize("patterns", [
    PATTERNS, ["_______________%", "___"], ["%"], ["tmp%"], [r"\_%"], [r"%\_"], [r"\%"], ["_"], [r"%\%%"], [""], ["ΑΣ%", "ας"],
    [r"\_", r"\__"], ["%가%", "É"], ["__%"], []])
def test_pattern_table(spark, names, patterns):
    table = spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string")
    got = filters.exclude_by_pattern_table(frame(spark, names), table, ["oid"])
    assert {r["oid"] for r in got.collect()} == kept(names, patterns)
    assert {r["oid"] for r in filters.exclude_like(frame(spark, names), patterns).collect()} == kept(names, patterns)


@pytest.mark.parametrize("gram_names", [1, 7, 50_000])
def test_split_grams_and_short_literals(spark, gram_names):
    names = [f"t_{i}" for i in range(40)] + ["a", "ab", "ABC", "xaby", "\u0130x", "ςΣσ", "", "a%b", "a_b", None]
    patterns = ["t\\_1%", "%a", "ab", "_b%", "%B%", "a\\%b", "ΣΣς", "zzz%9", "t%3%", "i̇x"]
    df = frame(spark, [(i, n, ("mysql", "postgres")[i % 2]) for i, n in enumerate(names * 2 + names[:1])]).repartition(3)
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = filters.exclude_by_pattern_table(df, table, ["oid"], gram_names)
    want = filters.exclude_like(df, patterns)
    assert sorted(r["oid"] for r in got.collect()) == sorted(r["oid"] for r in want.collect())


def test_names_offer_rows_by_their_length(spark):
    name = "".join(chr(97 + i % 26) + str(i) for i in range(40))[:64]
    grams = spark.range(1).select(F.explode(F.array_distinct(F.concat(
        *[filters._grams(F.lit(name), n) for n in (1, 2, 3)]))).alias("g"))
    assert len(name) == 64 and grams.count() <= 3 * len(name)


def test_wildcards_alone_need_no_join(spark):
    df = frame(spark, [(i, n, "mysql") for i, n in enumerate(["a", "bb", "ccc", "dddd"])])
    for patterns, left in ((["__", "____%"], ["a", "ccc"]), (["%"], []), (["_%"], []), (["_____"], ["a", "bb", "ccc", "dddd"])):
        got = filters.exclude_by_pattern_table(df, spark.createDataFrame([(p,) for p in patterns], "pattern string"), ["oid"])
        assert {r["table_name"] for r in got.collect()} == set(left)
        assert not got.where("false").collect()


def test_targets(spark):
    df = spark.createDataFrame([("public",), ("app",), ("ops",)], "schema_name string")
    assert filters.target_schemas(df, None).count() == 3
    assert filters.target_schemas(df, []).count() == 3
    assert filters.target_schemas(df, ["app", "none"]).count() == 1
    wanted = spark.createDataFrame([("app",), ("app",), ("ops",)], "schema_name string")
    assert filters.target_schemas(df, wanted).count() == 2


def test_types_are_split_without_loss(spark):
    kinds = ["BASE TABLE", "VIEW", "FOREIGN", None, "view"]
    df = spark.createDataFrame([(k,) for k in kinds], "table_type string")
    assert [p.count() for p in filters.by_type(df)] == [1, 1, 3]


def test_unsafe_schema_is_rejected(spark):
    df = spark.createDataFrame([("s", "t", "mysql"), ("s*/", "t", "mysql"), ("s", "t;", "postgres")],
                               "schema_name string, table_name string, dialect string")
    accepted, rejected = filters.split_unsafe(df)
    assert accepted.count() == 1
    assert {r["reason"] for r in rejected.collect()} == {"unsafe schema name", "unsafe table name"}


def test_constraint_kinds(spark):
    rows = [("a_not_null", "c"), ("a_not_null", "p"), ("ck", "c"), ("x", "x"), ("f", "f")]
    df = spark.createDataFrame(rows, "conname string, contype string")
    assert {tuple(r) for r in filters.table_constraints(df).collect()} == {("a_not_null", "p"), ("ck", "c"), ("f", "f")}


def test_slow_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.999,), (1.0,), (2.5,)], "elapsed double")
    assert filters.slow_extracts(df).agg(F.count("*")).first()[0] == 2


def test_dialect_names():
    assert normalise_dialect(" PostgreSQL ") == "postgres"
    assert normalise_dialect("MySQL") == "mysql"
    with pytest.raises(ValueError):
        normalise_dialect("oracle")


def test_pattern_table_gathers_nothing_on_the_driver(spark, tmp_path):
    """Exploded names look as small as their file to Spark, which would broadcast them."""
    rows, likes = [(i, f"t_{i}", "mysql") for i in range(200)], [f"t\\_{i}%" for i in range(0, 200, 7)]
    frame(spark, rows).write.parquet(f"{tmp_path}/names")
    spark.createDataFrame([(p,) for p in likes], "pattern string").write.parquet(f"{tmp_path}/patterns")
    got = filters.exclude_by_pattern_table(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("names", "patterns")), ["oid"])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["oid"] for r in got.collect()} == kept(rows, likes)


def test_long_literals_ask_for_long_grams(spark):
    """Names that end in numbers share all short grams, so the rows that meet would grow with names times patterns."""
    patterns = spark.createDataFrame([("t\\_1234567%",), ("%12345%",)], "pattern string")
    grams = filters._asked(patterns)[0].groupBy("pattern").agg(F.min(F.length("gram")).alias("n")).collect()
    assert {r["pattern"]: r["n"] for r in grams} == {"t\\_1234567%": 8, "%12345%": 5}
