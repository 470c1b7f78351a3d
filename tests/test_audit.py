"""Null rules and limits of each contract kind, on small tables."""

import pytest

from datadict.plans import audit as aud
from datadict.plans.audit import Contract
from datadict.sources import lake


def violations(tables, contract):
    row = aud.audit(tables, [contract]).first()
    return row["checked_rows"], row["violations"]


@pytest.fixture(scope="module")
def tables(spark):
    t = spark.createDataFrame(
        [(1, "a", 10.0, 1, 1), (1, "b", 12.5, 2, None), (None, "b", None, 9, 9), (None, "ccc", -3.0, None, 1),
         (2, None, 99.996, 3, 3)],
        "k int, s string, x double, p int, q int")
    parent = spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, 4), (None, None)], "a int, b int")
    return {"t": t, "parent": parent}


def test_not_null(tables):
    assert violations(tables, Contract(aud.NOT_NULL, "t", ("k",))) == (5, 2)


def test_keys(tables):
    # Repeated: k = 1. The group of nulls breaks a primary key and is exempt from UNIQUE.
    assert violations(tables, Contract(aud.UNIQUE, "t", ("k",))) == (5, 1)
    assert violations(tables, Contract(aud.PRIMARY_KEY, "t", ("k",))) == (5, 2)
    assert violations(tables, Contract(aud.UNIQUE, "t", ("k", "s"))) == (5, 0)


def test_partial_unique(tables):
    assert violations(tables, Contract(aud.PARTIAL_UNIQUE, "t", ("k",), "x < 11")) == (2, 0)
    assert violations(tables, Contract(aud.PARTIAL_UNIQUE, "t", ("s",), "x is null or x > 11")) == (3, 1)


def test_foreign_keys(tables):
    one = Contract(aud.FOREIGN_KEY, "t", ("p",), parent="parent", parent_columns=("a",))
    assert violations(tables, one) == (5, 1)  # 9 has no parent, null is exempt
    two = Contract(aud.FOREIGN_KEY, "t", ("p", "q"), parent="parent", parent_columns=("a", "b"))
    assert violations(tables, two) == (5, 2)  # (9, 9) and (3, 3)
    assert {tuple(r) for r in aud.orphan_keys(tables["t"], tables["parent"], two).collect()} == {(9, 9, 1), (3, 3, 1)}
    few = Contract(aud.FOREIGN_KEY, "t", ("p",), parent="parent", parent_columns=("a",), parent_filter="a < 2")
    assert violations(tables, few) == (5, 3)


def test_check_passes_on_null(tables):
    assert violations(tables, Contract(aud.CHECK, "t", ("x",), "x > 0")) == (5, 1)


def test_generated_is_null_safe(tables):
    assert violations(tables, Contract(aud.GENERATED, "t", ("p",), "q")) == (5, 2)


def test_type_limits(tables):
    assert violations(tables, Contract(aud.TYPE_LIMIT, "t", ("s",), "varchar(2)")) == (5, 1)
    assert violations(tables, Contract(aud.TYPE_LIMIT, "t", ("x",), "numeric(4,2)")) == (5, 1)  # 99.996 rounds to 100
    assert violations(tables, Contract(aud.TYPE_LIMIT, "t", ("x",), "numeric(3,2)")) == (5, 3)
    with pytest.raises(ValueError):
        aud.type_violation("s", "varchar(2")


@pytest.mark.parametrize("type_text, good, bad", [
    ("varchar(3)", "abc", "abcd"), ("char(1)", "a", "ab"), ("bpchar(2)", "äö", "äöü"), ("bit(8)", "x" * 9, None),
    ("numeric(4,2)", 99.99, 100.0), ("numeric(3)", 999.4, 999.5), ("numeric", 1e30, None),
    ("int2", 32767.4, 32767.5), ("int4", -2147483648.0, -2147483649.0), ("int8", 9.2e18, 9.3e18),
    ("varchar(2)[]", ["ab", None], ["a", "abc"]), ("bpchar(2)[]", [], ["abc"]), ("numeric(3,1)[]", [99.9], [1.0, 99.96]),
    ("int2[]", [1.0, None], [40000.0]), ("int4[][]", [[1.0], []], [[1.0], [3e9]]), ("text", "x" * 999, None),
    ("varchar", "x" * 999, None), ("bool", True, None), ("timestamptz", "2024", None), ("uuid", "u", None), ("jsonb[]", ["{}"], None),
])
def test_every_type_text(spark, type_text, good, bad):
    kind = "string" if isinstance(good, (str, bool)) else "double"
    if isinstance(good, list):
        kind = "string" if "char" in type_text or "json" in type_text else "double"
        kind = "array<" * type_text.count("[]") + kind + ">" * type_text.count("[]")
    good = str(good) if isinstance(good, bool) else good
    df = spark.createDataFrame([(good, False), (None, False)] + ([] if bad is None else [(bad, True)]), f"v {kind}, want boolean")
    assert [r["got"] == r["want"] for r in df.select("want", aud.type_violation("v", type_text).alias("got")).collect()] == [True] * df.count()


def test_empty_table_reports_zero(spark):
    empty = {"t": spark.createDataFrame([], "k int, p int"), "parent": spark.createDataFrame([], "a int")}
    contracts = [Contract(aud.NOT_NULL, "t", ("k",)), Contract(aud.PRIMARY_KEY, "t", ("k",)),
                 Contract(aud.FOREIGN_KEY, "t", ("p",), parent="parent", parent_columns=("a",))]
    assert [(r["checked_rows"], r["violations"]) for r in aud.audit(empty, contracts).collect()] == [(0, 0)] * 3


def test_hot_key_travels_as_counts(spark):
    hot = spark.range(200000).selectExpr("if(id % 3 = 0, 7, id) as k")
    got = aud.audit({"t": hot}, [Contract(aud.UNIQUE, "t", ("k",))]).first()
    assert (got["checked_rows"], got["violations"]) == (200000, 1)
    plan = aud.key_counts(hot, Contract(aud.UNIQUE, "t", ("k",)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_sequence(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (7,), (None,)], "id int")
    row = aud.sequence_report(df, "t", "id").first()
    assert (row["min_value"], row["max_value"], row["distinct_count"], row["gaps"], row["repeats"]) == (1, 7, 3, 4, 1)


def test_lake_dictionary(spark):
    long = "x" * 100
    t = spark.createDataFrame(
        [(1, long, 0.0, [1.0, 2.0]), (2, long, -0.0, None), (None, "é", 1.5, [1.0, 2.0]), (2, None, None, [])],
        "i int, s string, d double, a array<float>")
    none = spark.createDataFrame([], "z string")
    got = {(r["table_name"], r["column_name"]): (r["row_count"], r["null_count"], r["distinct_count"], r["byte_count"])
           for r in lake.dictionary({"t": t, "none": none}).collect()}
    assert got == {("t", "i"): (4, 1, 2, 12), ("t", "s"): (4, 1, 2, 202), ("t", "d"): (4, 1, 2, 24),
                   ("t", "a"): (4, 1, 2, 16), ("none", "z"): (0, 0, 0, 0)}


def test_key_classes(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "a", "x")], "k int, s string, u string")
    got = {r["column_name"]: (r["observed"], r["holds"]) for r in aud.key_classes(
        {"t": t}, {("t", "k"): "PRI", ("t", "s"): "UNI", ("t", "u"): "UNI"}).collect()}
    assert got == {"k": ("KEY", True), "s": ("PLAIN", False), "u": ("PLAIN", True)}


def test_key_candidates_by_sketch(spark):
    """Keys, near keys and plain columns: the verdict equals exact counts, and plain columns end at the sketch."""
    n = 20000
    t = spark.range(n).selectExpr(
        "id as k", "if(id = 5, 4, id) as almost", "id % 10 as plain", "if(id % 2 = 0, id, null) as sparse",
        "array(id, 1) as pair", "cast(null as string) as none", "if(id < 2, 0.0D * (2 * id - 1), cast(id as double)) as zeros")
    empty = spark.createDataFrame([], "z int")
    got = {(r["table_name"], r["column_name"]): r for r in aud.key_candidates({"t": t, "e": empty}).collect()}
    for name in t.columns:
        values, distinct = t.selectExpr(f"count({name}) as a", f"count(distinct {name}) as b").first()
        r = got["t", name]
        assert r["is_unique"] == (values == distinct), name
        assert r["observed"] == ("KEY" if values == distinct == n else "PLAIN"), name
        assert (r["row_count"], r["null_count"]) == (n, n - values)
    assert {c for (_, c), r in got.items() if r["ruled_out"]} == {"plain"}
    assert got["e", "z"]["observed"] == "PLAIN" and got["e", "z"]["is_unique"]
