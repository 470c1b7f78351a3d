"""Text rules on fixed rows, and as properties over generated rows."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from datadict.functions import definitions, names, texts, types

C = F.col


def test_type_text(evaluate):
    rows = [
        ("int4", None, None, None, "int4"), ("int8", None, 64, 0, "int8"), ("text", None, None, None, "text"),
        ("varchar", 255, None, None, "varchar(255)"), ("varchar", None, None, None, "varchar"),
        ("bpchar", 10, None, None, "char(10)"), ("bpchar", None, None, None, "bpchar"),
        ("numeric", None, 10, 2, "numeric(10,2)"), ("numeric", None, 10, None, "numeric"),
        ("_int4", None, None, None, "int4[]"), ("_text", 100, None, None, "text[]"),
        ("_varchar", 255, None, None, "varchar(255)[]"), ("_varchar", None, None, None, "varchar[]"),
        ("_bpchar", 10, None, None, "bpchar(10)[]"), ("_numeric", None, 10, 2, "numeric(10,2)[]"),
        ("_numeric", None, None, None, "numeric[]"), ("timestamptz", None, None, None, "timestamptz"),
    ]
    got = evaluate([r[:4] for r in rows], "u string, l int, p int, s int",
                   types.pg_type_text(C("u"), C("l"), C("p"), C("s")))
    assert got == [r[4] for r in rows]


def test_extra(evaluate):
    rows = [("a", "", None, "auto_increment"), ("d", "s", "0", "auto_increment"),
            ("", "s", "nextval('q'::regclass)", "auto_increment"), ("", "s", None, "STORED GENERATED"),
            ("", "s", "now()", "STORED GENERATED"), ("", "", "now()", None), ("", "", None, None)]
    got = evaluate([r[:3] for r in rows], "i string, g string, d string", types.pg_extra(C("i"), C("g"), C("d")))
    assert got == [r[3] for r in rows]


def test_mysql_extra(evaluate):
    rows = [("auto_increment", None, "auto_increment"), ("auto_increment", "", "auto_increment"),
            ("STORED GENERATED", "a + b", "STORED GENERATED a + b"), (None, "a + b", "a + b"),
            ("", "a + b", " a + b"), ("", "", ""), (None, "", None), (None, None, None)]
    got = evaluate([r[:2] for r in rows], "e string, g string", types.mysql_extra(C("e"), C("g")))
    assert got == [r[2] for r in rows]


def test_spark_types():
    assert types.spark_type("varchar(20)") == "string"
    assert types.spark_type("numeric(10,2)") == "decimal(10,2)"
    assert types.spark_type("int4[]") == "array<int>"
    assert types.spark_type("timestamptz") == "timestamp"
    with pytest.raises(ValueError):
        types.spark_type("numeric(50,2)")


def made_index(rng):
    """An index definition put together from its parts, and what must be read from it."""
    def term(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind < 2:
            return rng.choice(["shelf_no", "q", "weight_kg", '"Mixed, Case"', "길이", "k2"])
        inner = ", ".join(term(depth - 1) for _ in range(rng.randrange(1, 3)))
        return f"({inner})" if kind == 2 else f"round_up({inner})"

    terms = [t for t in (term(3) for _ in range(rng.randrange(1, 5))) if "Mixed" not in t] or ["q"]
    order = ["", " DESC", " ASC", " NULLS LAST", " DESC NULLS FIRST", " asc nulls last"]
    unique = rng.random() < 0.4
    head = rng.choice(["CREATE UNIQUE INDEX", "create unique index"] if unique else ["CREATE INDEX", "Create Index"])
    method = rng.choice(["", " USING brin", " USING spgist", " using btree"])
    extra = rng.choice(["", " INCLUDE (weight_kg, k2)", " WITH (pages_per_range='8')", " INCLUDE (q) WITH (fillfactor='55')"])
    rule = rng.choice([None, "(q > 7)", "k2 IS NULL", "round_up(q, (3)) < weight_kg", "(note = '😀 where')"])
    tail = "" if rule is None else f"{rng.choice([' WHERE ', ' where ', ' WHERE   '])}{rule}{rng.choice(['', '  '])}"
    ordered = [t + rng.choice(order) for t in terms]
    # Sort words go after a column; an expression is kept as it is written.
    read = [o if "(" in t else t for t, o in zip(terms, ordered)]
    return f"{head} n{rng.randrange(99)} ON depot.crates{method} ({', '.join(ordered)}){extra}{tail}", unique, ", ".join(read), rule


def test_index_definitions(spark):
    rng = random.Random(11)
    rows = [made_index(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, indexdef string")
    got = definitions.with_index_parts(df).orderBy("i").collect()
    assert [(r["indexdef"], r["is_unique"], r["index_columns"], r["predicate"]) for r in got] == rows


def test_broken_index_definitions(spark):
    """No list, an unclosed list or an empty one: no columns, and never an error."""
    rows = ["", "CREATE", "CREATE INDEX n ON crates", "CREATE INDEX n ON crates (q, k2", "CREATE INDEX n ON crates ()"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, indexdef string")
    got = definitions.with_index_parts(df).orderBy("i").collect()
    assert [(r["is_unique"], r["index_columns"], r["predicate"]) for r in got] == [(False, "", None)] * len(rows)


def test_fk_actions(evaluate):
    rows = [("FOREIGN KEY (a) REFERENCES t(b)", "NO ACTION", "NO ACTION"),
            ("FOREIGN KEY (a) REFERENCES t(b) ON DELETE CASCADE ON UPDATE SET NULL", "CASCADE", "SET NULL"),
            ("FOREIGN KEY (a) REFERENCES t(b) ON UPDATE CASCADE ON DELETE SET NULL", "SET NULL", "CASCADE"),
            ("FOREIGN KEY (a) REFERENCES t(b) ON DELETE SET DEFAULT DEFERRABLE", "SET DEFAULT", "NO ACTION")]
    column = F.concat_ws("|", definitions.fk_action(C("d"), "DELETE"), definitions.fk_action(C("d"), "UPDATE"))
    assert evaluate([r[:1] for r in rows], "d string", column) == [f"{r[1]}|{r[2]}" for r in rows]


def test_check_body(evaluate):
    rows = [("CHECK ((age > 0))", "(age > 0)"), ("CHECK (a) NOT VALID", "a) NOT VALID"), ("x", "x"), ("", "")]
    assert evaluate([r[:1] for r in rows], "d string", definitions.check_body(C("d"))) == [r[1] for r in rows]


def test_terminator(evaluate):
    rows = [("CREATE TABLE t ()", "CREATE TABLE t ();"), ("a;", "a;"), ("a);  \n", "a);"), ("a \t\n", "a;"),
            ("", ";"), (None, ";"), ("x;;", "x;"), ("a; b", "a; b;"), ("a 　", "a;")]
    assert evaluate([r[:1] for r in rows], "d string", texts.terminate(C("d"))) == [r[1] for r in rows]


def test_fences(evaluate):
    rows = [("", 3), ("select 1", 3), ("`a`", 3), ("a```b", 4), ("`a```b``c", 4), ("``x````", 5)]
    assert evaluate([r[:1] for r in rows], "d string", F.length(texts.fence(C("d")))) == [r[1] for r in rows]


def test_bytes_text(evaluate):
    rows = [(0, "0B"), (1023, "1023B"), (1024, "1.0KiB"), (1536, "1.5KiB"), (1280, "1.2KiB"), (1792, "1.8KiB"),
            (1048575, "1024.0KiB"), (1048576, "1.0MiB"), (5 * 1048576 + 262144, "5.2MiB"), (1 << 40, "1048576.0MiB")]
    assert evaluate([r[:1] for r in rows], "n bigint", texts.bytes_text(C("n"))) == [r[1] for r in rows]
    counts = [(n,) for n in range(1024, 40000, 7)]
    assert evaluate(counts, "n bigint", texts.bytes_text(C("n"))) == [f"{n / 1024:.1f}KiB" for (n,) in counts]


def test_unsafe_names(evaluate):
    bad = ["a;b", "a/*", "*/a", "a\nb", "a\rb"]
    good = ["users", "사용자", 'we"ird', "back`tick", "a/b", "a*b", "a b"]
    for dialect in ("mysql", "postgres"):
        flag = names.is_unsafe(C("n"), dialect)
        assert evaluate([(n,) for n in bad + good], "n string", flag) == [True] * len(bad) + [False] * len(good)
    assert evaluate([("a\0b",)], "n string", names.is_unsafe(C("n"), "postgres")) == [True]
    assert evaluate([("a\0b",)], "n string", names.is_unsafe(C("n"), "mysql")) == [False]


def test_system_schemas(evaluate):
    rows = [("pg_catalog", "postgres", True), ("pg_toast", "postgres", True), ("pg_temp_1", "postgres", True),
            ("pg_toast_temp_2", "postgres", True), ("pg_tempx", "postgres", False), ("mysql", "postgres", False),
            ("public", "postgres", False), ("sys", "mysql", True), ("performance_schema", "mysql", True),
            ("tmp", "mysql", True), ("pg_catalog", "mysql", False), ("information_schema", "mysql", True)]
    got = evaluate([r[:2] for r in rows], "s string, d string", names.is_system_schema(C("s"), C("d")))
    assert got == [r[2] for r in rows]


def test_unquote_needs_quotes(evaluate):
    rows = [('"a"', "a"), ('"a""b"', 'a"b'), ("a", None), ('"a', None), ('"', None), ('""', "")]
    assert evaluate([r[:1] for r in rows], "q string", names.unquote(C("q"), "postgres")) == [r[1] for r in rows]


TEXT = st.text(alphabet=st.sampled_from(list("ab`\"; \n\r*/(),x가😀 ")), max_size=14)
ONCE = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


@ONCE
@given(st.lists(TEXT, min_size=200, max_size=400))
def test_quoting_round_trip(spark, evaluate, values):
    """Safe names come back unchanged; unsafe names are never quoted."""
    for dialect in ("mysql", "postgres"):
        quoted = names.quote(C("n"), dialect)
        kept = F.when(quoted.isNull(), names.is_unsafe(C("n"), dialect)).otherwise(
            names.unquote(quoted, dialect) == C("n"))
        assert all(evaluate([(v,) for v in values], "n string", kept))


@ONCE
@given(st.lists(TEXT, min_size=200, max_size=400))
def test_terminated_once(evaluate, values):
    for value, out in zip(values, evaluate([(v,) for v in values], "n string", texts.terminate(C("n")))):
        assert re.fullmatch(r"(?s).*;", out) and not out.endswith(";;") and value.startswith(out[:-1])


@ONCE
@given(st.lists(TEXT, min_size=200, max_size=400))
def test_top_level_parts(evaluate, values):
    """Splitting at commas outside parentheses, against a character scan."""

    def scan(text):
        parts, depth, now = [], 0, ""
        for ch in text:
            if ch == "," and depth <= 0:
                parts.append(now)
                now = ""
                continue
            depth += (ch == "(") - (ch == ")")
            now += ch
        return parts + [now] if now else parts

    got = evaluate([(v,) for v in values], "n string", definitions.split_top_level(C("n")))
    assert got == [scan(v) for v in values]
