"""Contract audit over the given tables, and the streaming forms over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from checks.catalog import _lake_sql, size_text_sql
from datadict import streaming
from datadict.plans import audit as aud
from datadict.plans.audit import Contract
from datadict.sources.fixtures import TABLES, VIEWS, Catalog, with_clause

KEYS = [
    Contract(aud.PRIMARY_KEY, "orders", ("o_orderkey",)),
    Contract(aud.PRIMARY_KEY, "conversations", ("conv_id", "turn")),
    Contract(aud.PRIMARY_KEY, "lineitem", ("l_orderkey", "l_linenumber")),
    Contract(aud.UNIQUE, "documents", ("text",)),
    Contract(aud.UNIQUE, "part", ("p_partkey",)),
]
PARTIAL = [
    Contract(aud.PARTIAL_UNIQUE, "lineitem", ("l_orderkey", "l_linenumber"), "l_returnflag = 'R'"),
    Contract(aud.PARTIAL_UNIQUE, "orders", ("o_custkey",), "o_orderstatus = 'F' and o_orderpriority = '1-URGENT'"),
]


def _fk(child: str, column: str, parent: str, key: str, only: str | None = None) -> Contract:
    name = f"{child}({column}) in {parent}" + (f" where {only}" if only else "")
    return Contract(aud.FOREIGN_KEY, child, (column,), parent=parent, parent_columns=(key,), parent_filter=only, name=name)


FOREIGN = [
    _fk("lineitem", "l_orderkey", "orders", "o_orderkey"),
    _fk("lineitem", "l_partkey", "part", "p_partkey"),
    _fk("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    _fk("orders", "o_custkey", "customer", "c_custkey"),
    _fk("customer", "c_nationkey", "nation", "n_nationkey"),
    _fk("supplier", "s_nationkey", "nation", "n_nationkey"),
    _fk("nation", "n_regionkey", "region", "r_regionkey"),
    _fk("labels", "doc_id", "documents", "doc_id"),
    _fk("events", "user_id", "customer", "c_custkey"),
    _fk("lineitem", "l_partkey", "part", "p_partkey", "p_size < 40"),
]
CHECKS = [
    Contract(aud.CHECK, "lineitem", ("l_discount",), "l_discount between 0 and 0.1"),
    Contract(aud.CHECK, "lineitem", ("l_quantity",), "l_quantity < 50"),
    Contract(aud.CHECK, "orders", ("o_orderstatus",), "o_orderstatus in ('F', 'O', 'P')"),
    Contract(aud.CHECK, "customer", ("c_acctbal",), "c_acctbal > 0"),
]
GENERATED = [
    Contract(aud.GENERATED, "documents", ("n_chars",), "length(text)"),
    Contract(aud.GENERATED, "part", ("p_size",), "p_partkey % 50 + 1"),
]
LIMITS = [
    Contract(aud.TYPE_LIMIT, "part", ("p_name",), "varchar(11)"),
    Contract(aud.TYPE_LIMIT, "customer", ("c_mktsegment",), "varchar(10)"),
    Contract(aud.TYPE_LIMIT, "documents", ("text",), "varchar(1000)"),
    Contract(aud.TYPE_LIMIT, "orders", ("o_totalprice",), "numeric(7,2)"),
    Contract(aud.TYPE_LIMIT, "lineitem", ("l_quantity",), "numeric(4,2)"),
]

# Columns of the given tables that a document would call PRI, UNI or MUL.
DECLARED = {
    ("region", "r_regionkey"): "PRI", ("nation", "n_nationkey"): "PRI", ("customer", "c_custkey"): "PRI",
    ("supplier", "s_suppkey"): "PRI", ("part", "p_partkey"): "PRI", ("orders", "o_orderkey"): "PRI",
    ("documents", "doc_id"): "PRI", ("documents", "text"): "UNI", ("events", "event_id"): "PRI",
    ("lineitem", "l_orderkey"): "MUL", ("lineitem", "l_partkey"): "MUL", ("labels", "doc_id"): "UNI",
}


def tables(c: Catalog) -> dict[str, DataFrame]:
    return {name: c.table(name) for name in TABLES}


# --- SQL for comparison -------------------------------------------------------------------------

def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _report(c: Contract, checked: str, violations: str, source: str) -> str:
    return (f"select {_text(c.label)} as contract, {_text(c.kind)} as kind, {_text(c.table)} as table_name,"
            f" {_text(', '.join(c.columns))} as columns, cast({checked} as bigint) as checked_rows,"
            f" cast({violations} as bigint) as violations from {source}")


def _row_sql(c: Contract, breaks: str) -> str:
    return _report(c, "count(*)", f"count(*) filter (where {breaks})", c.table)


def _key_sql(c: Contract) -> str:
    columns = ", ".join(c.columns)
    null_key = " or ".join(f"{k} is null" for k in c.columns)
    breaks = f"n > 1 and not ({null_key})" + (f" or {null_key}" if c.kind == aud.PRIMARY_KEY else "")
    where = f" where {c.expression}" if c.kind == aud.PARTIAL_UNIQUE else ""
    groups = f"(select {columns}, count(*) as n from {c.table}{where} group by {columns}) g"
    return _report(c, "coalesce(sum(n), 0)", f"count(*) filter (where {breaks})", groups)


def _fk_sql(c: Contract) -> str:
    child, key = c.columns[0], c.parent_columns[0]
    where = f" where {c.parent_filter}" if c.parent_filter else ""
    orphan = f"{child} is not null and {child} not in (select {key} from {c.parent}{where})"
    return _row_sql(c, orphan)


def _limit_sql(c: Contract) -> str:
    column, kind = c.columns[0], c.expression
    if kind.startswith("varchar"):
        return _row_sql(c, f"length({column}) > {kind[8:-1]}")
    precision, scale = kind[8:-1].split(",")
    return _row_sql(c, f"abs(round({column}, {scale})) >= {10 ** (int(precision) - int(scale))}")


def _union(parts: list[str]) -> str:
    return "\nunion all ".join(parts)


def _not_null_sql() -> str:
    columns = {}
    for line in _lake_sql().splitlines():
        words = line.split("'")
        columns.setdefault(words[1], []).append(words[3])
    return _union([_row_sql(Contract(aud.NOT_NULL, t, (k,)), f"{k} is null") for t, ks in columns.items() for k in ks])


CHECKS_SQL = _union([_row_sql(c, f"not ({c.expression})") for c in CHECKS])
GENERATED_SQL = _union([_row_sql(c, f"{c.columns[0]} is distinct from {c.expression}") for c in GENERATED])
LIMITS_SQL = _union([_limit_sql(c) for c in LIMITS])


# --- audits -------------------------------------------------------------------------------------

@check("aud_1_not_null", _not_null_sql())
def not_null(c: Catalog) -> DataFrame:
    return aud.audit(tables(c), aud.not_null_contracts(tables(c)))


@check("aud_2_keys", _union([_key_sql(k) for k in KEYS]))
def keys(c: Catalog) -> DataFrame:
    return aud.audit(tables(c), KEYS)


@check("aud_2_repeated_keys", "select l_orderkey, l_linenumber, count(*) as row_count from lineitem group by 1, 2"
       " having count(*) > 1")
def repeated_keys(c: Catalog) -> DataFrame:
    return aud.broken_keys(c.table("lineitem"), KEYS[2])


@check("aud_3_partial_unique", _union([_key_sql(k) for k in PARTIAL]))
def partial_unique(c: Catalog) -> DataFrame:
    return aud.audit(tables(c), PARTIAL)


@check("aud_3_partial_repeats", "select l_orderkey, l_linenumber, count(*) as row_count from lineitem"
       " where l_returnflag = 'R' group by 1, 2 having count(*) > 1")
def partial_repeats(c: Catalog) -> DataFrame:
    return aud.broken_keys(c.table("lineitem"), PARTIAL[0])


@check("aud_4_foreign_keys", _union([_fk_sql(k) for k in FOREIGN]))
def foreign_keys(c: Catalog) -> DataFrame:
    return aud.audit(tables(c), FOREIGN)


@check("aud_4_orphan_keys", "select l_partkey, count(*) as row_count from lineitem"
       " where l_partkey not in (select p_partkey from part where p_size < 40) group by 1")
def orphan_keys(c: Catalog) -> DataFrame:
    return aud.orphan_keys(c.table("lineitem"), c.table("part"), FOREIGN[-1])


@check("aud_5_checks", CHECKS_SQL)
def checks_hold(c: Catalog) -> DataFrame:
    return aud.audit(tables(c), CHECKS)


@check("aud_5_failing_rows", "select l_orderkey, l_linenumber, l_quantity from lineitem where not (l_quantity < 50)")
def failing_rows(c: Catalog) -> DataFrame:
    return aud.failing_rows(c.table("lineitem"), CHECKS[1], ["l_orderkey", "l_linenumber", "l_quantity"])


@check("aud_6_generated", GENERATED_SQL)
def generated(c: Catalog) -> DataFrame:
    return aud.audit(tables(c), GENERATED)


@check("aud_7_type_limits", LIMITS_SQL)
def type_limits(c: Catalog) -> DataFrame:
    return aud.audit(tables(c), LIMITS)


TYPE_TEXTS = [
    Contract(aud.TYPE_LIMIT, "orders", ("o_custkey",), "int2"),
    Contract(aud.TYPE_LIMIT, "orders", ("o_totalprice",), "numeric(5)"),
    Contract(aud.TYPE_LIMIT, "orders", ("o_orderkey",), "int8"),
    Contract(aud.TYPE_LIMIT, "orders", ("o_orderdate",), "timestamp"),
    Contract(aud.TYPE_LIMIT, "embeddings", ("embedding",), "numeric(3,3)[]"),
    Contract(aud.TYPE_LIMIT, "part_names", ("words",), "varchar(4)[]"),
    Contract(aud.TYPE_LIMIT, "part_names", ("words",), "text[]"),
]
TYPE_TEXT_RULES = [
    ("orders", "o_custkey > 32767 or o_custkey < -32768"), ("orders", "abs(round(o_totalprice)) >= 100000"), ("orders", "false"),
    ("orders", "false"), ("embeddings", "len(list_filter(embedding, lambda e: abs(round(e, 3)) >= 1)) > 0"),
    ("part", "len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4)) > 0"), ("part", "false"),
]


@check("aud_7_type_texts", " union all ".join(
    f"select '{c.label}' as contract, '{c.kind}' as kind, '{c.table}' as table_name, '{', '.join(c.columns)}' as columns,"
    f" count(*) as checked_rows, count(*) filter (where {rule}) as violations from {origin}"
    for c, (origin, rule) in zip(TYPE_TEXTS, TYPE_TEXT_RULES)))
def type_texts(c: Catalog) -> DataFrame:
    words = c.table("part").select(F.split("p_name", " ").alias("words"))
    return aud.audit({**{t: c.table(t) for t in ("orders", "embeddings")}, "part_names": words}, TYPE_TEXTS)


@check("aud_7_longest_texts", """
select 'part' as table_name, 'p_name' as column_name, max(length(p_name)) as max_length from part
union all select 'part', 'p_type', max(length(p_type)) from part""")
def longest_texts(c: Catalog) -> DataFrame:
    return aud.type_widths(c.table("part"), "part", ["p_name", "p_type"])


def _key_class_sql() -> str:
    said = ", ".join(f"('{t}', '{k}', '{d}')" for (t, k), d in DECLARED.items())
    return f"""
with said(table_name, column_name, declared) as (values {said}), profile as ({_lake_sql()})
select p.table_name, p.column_name, row_count, distinct_count,
  case when distinct_count = row_count and row_count > 0 then 'KEY' else 'PLAIN' end as observed,
  coalesce(declared, '') as declared,
  case when declared = 'PRI' then distinct_count = row_count and row_count > 0
       when declared = 'UNI' then distinct_count = row_count - null_count else true end as holds
from profile p left join said s on s.table_name = p.table_name and s.column_name = p.column_name"""


@check("aud_8_key_classes", _key_class_sql())
def key_classes(c: Catalog) -> DataFrame:
    return aud.key_classes(tables(c), DECLARED)


@check("aud_8_key_candidates", f"""
select table_name, column_name, row_count, null_count, distinct_count = row_count - null_count as is_unique,
  case when distinct_count = row_count and row_count > 0 then 'KEY' else 'PLAIN' end as observed from ({_lake_sql()})""")
def key_candidates(c: Catalog) -> DataFrame:
    return aud.key_candidates(tables(c)).drop("ruled_out")


@check("aud_9_sequences", _union([f"""
select '{t}' as table_name, '{k}' as column_name, cast(min({k}) as bigint) as min_value, cast(max({k}) as bigint) as max_value,
  count(distinct {k}) as distinct_count, cast(max({k}) - min({k}) + 1 - count(distinct {k}) as bigint) as gaps,
  count({k}) - count(distinct {k}) as repeats from {t}""" for t, k in (("orders", "o_orderkey"), ("part", "p_partkey"),
                                                                       ("lineitem", "l_suppkey"))]))
def sequences(c: Catalog) -> DataFrame:
    parts = [aud.sequence_report(c.table(t), t, k)
             for t, k in (("orders", "o_orderkey"), ("part", "p_partkey"), ("lineitem", "l_suppkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TEXTS = {"documents": ("text", "lang", "source"), "pages": ("url", "html"), "conversations": ("role", "text"),
         "lineitem": ("l_returnflag", "l_linestatus")}


def _text_bytes_sql() -> str:
    parts = []
    for table, columns in TEXTS.items():
        parts += [f"select '{table}' as table_name, '{k}' as column_name,"
                  f" cast(coalesce(sum(strlen({k})), 0) as bigint) as byte_count from {table}" for k in columns]
        whole = " + ".join(f"coalesce(strlen({k}), 0)" for k in columns)
        parts.append(f"select '{table}', '', cast(coalesce(sum({whole}), 0) as bigint) from {table}")
    return f"select *, {size_text_sql('byte_count')} as size_text from ({_union(parts)})"


@check("aud_10_text_bytes", _text_bytes_sql())
def text_bytes(c: Catalog) -> DataFrame:
    return aud.text_bytes({name: c.table(name) for name in TEXTS})


ALL = [*KEYS, *PARTIAL, *FOREIGN, *CHECKS, *GENERATED, *LIMITS]


@check("aud_all_contracts", _union([*[_key_sql(k) for k in KEYS + PARTIAL], *[_fk_sql(k) for k in FOREIGN],
                                    CHECKS_SQL, GENERATED_SQL, LIMITS_SQL]))
def all_contracts(c: Catalog) -> DataFrame:
    return aud.audit(tables(c), ALL)


# --- streams ------------------------------------------------------------------------------------

WARN_KEY = ["schema_name", "table_name", "column_name"]


def log_stream(c: Catalog) -> DataFrame:
    return streaming.read_files(c.spark, c.sf_dir, "events.parquet").selectExpr(*VIEWS["cat_log"].select)


@check("str_1_warn_once", with_clause("cat_log") + "select distinct schema_name, table_name, column_name from cat_log")
def warn_once(c: Catalog) -> DataFrame:
    return streaming.run_available(streaming.once_per_key(log_stream(c), WARN_KEY, "event_id"), "warn-once")


@check("str_1_warn_once_within_watermark",
       with_clause("cat_log") + "select distinct schema_name, table_name, column_name from cat_log")
def warn_once_within(c: Catalog) -> DataFrame:
    stream = streaming.once_per_key_within(log_stream(c), WARN_KEY, "ts", "3650 days", "event_id")
    return streaming.run_available(stream, "warn-within")


@check("str_2_slow_alerts", with_clause("cat_log")
       + " select event_id, schema_name, table_name from cat_log where elapsed >= 1.0")
def slow_alerts(c: Catalog) -> DataFrame:
    alerts = streaming.slow_alerts(log_stream(c)).select("event_id", "schema_name", "table_name")
    return streaming.run_available(alerts, "slow")
