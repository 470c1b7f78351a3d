"""Catalog relations: scans, filters, text rules, joins, aggregates, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check, sql
from datadict.functions import definitions, names, texts, types
from datadict.operators import filters, ordered, relations
from datadict.plans import dictionary as dic
from datadict.sources import decode, lake
from datadict.sources.fixtures import TABLES, Catalog, with_clause

OID = ("oid",)
TARGETS = ["public", "app"]
PATTERNS = ["tmp_%", "log_%"]


def mysql_of(c: Catalog, patterns=()) -> dic.Dictionary:
    return dic.mysql_dictionary(c.stored().mysql(), OID, except_patterns=patterns)


def postgres_of(c: Catalog, patterns=()) -> dic.Dictionary:
    return dic.postgres_dictionary(c.stored().postgres(), OID, except_patterns=patterns, backing=("index_name",))


def fleet(c: Catalog, patterns=()) -> dic.Dictionary:
    return dic.combine(mysql_of(c, patterns), postgres_of(c, patterns))


# --- sources ------------------------------------------------------------------------------------

def _register_scans() -> None:
    """One check per dictionary table and dialect (scan), and per dictionary table (combination)."""
    dialects = {"mysql": ("src_1", mysql_of, "my"), "postgres": ("src_2", postgres_of, "pg")}
    for dialect, (key, build, short) in dialects.items():
        for part in dic.Dictionary.PARTS:
            if part in ("tables", "views"):
                where = f"where dialect = '{dialect}'" if part == "tables" else (
                    "where charset " + ("<>" if dialect == "mysql" else "=") + " ''")
                body = f"select * from d_{part} {where}"
            else:
                body = f"select * from {short}_{part}"
            check(f"{key}_{dialect}_{part}", sql.dictionary() + "\n" + body)(
                lambda c, build=build, part=part: getattr(build(c), part))
    for part in dic.Dictionary.PARTS:
        check(f"set_2_combined_{part}", sql.dictionary() + f"\nselect * from d_{part}")(
            lambda c, part=part: getattr(fleet(c), part))


_register_scans()


@check("src_3_definition_texts", with_clause("cat_views") + """
select oid, view_query as ddl_text, oid % 7 = 0 as is_view from cat_views""")
def definition_texts(c: Catalog) -> DataFrame:
    from datadict.sources.fixtures import SHOW_CREATE_SELECT
    dump = c.view("cat_views").selectExpr(*SHOW_CREATE_SELECT).withColumns(
        {n: F.col(n).cast("binary") for n in ("create_table", "create_view")})
    return dump.select("oid", decode.ddl_text(F.col("create_table"), F.col("create_view")).alias("ddl_text"),
                       F.col("create_view").isNotNull().alias("is_view"))


# A view's bytes, with a sequence that is no UTF-8 before and after: the bytes, and the text they become.
BROKEN = {0: ("FF", "\ufffd"), 1: ("E282", "\ufffd"), 2: ("C0AF", "\ufffd\ufffd"), 3: ("C3A9", "é"), 4: ("F0908D", "\ufffd")}


@check("src_3_broken_bytes", with_clause("cat_views") + """
select oid, mark || view_query || mark as ddl_text from cat_views join (values """ + ", ".join(
    f"({rest}, '{text}')" for rest, (_, text) in BROKEN.items()) + """) v(rest, mark) on rest = oid % 5""")
def broken_bytes(c: Catalog) -> DataFrame:
    """Definition texts that arrive as bytes, with invalid ones at both ends."""
    mark = F.element_at(F.create_map(*[F.lit(x) for rest, (code, _) in BROKEN.items() for x in (rest, code)]),
                        F.pmod(F.col("oid"), F.lit(len(BROKEN))).cast("int"))
    body = F.concat(F.unhex(mark), F.col("view_query").cast("binary"), F.unhex(mark))
    return c.view("cat_views").select("oid", decode.ddl_text(body, F.lit(None).cast("binary")).alias("ddl_text"))


def _lake_sql() -> str:
    """Profile of every column of the given tables, from their documented schemas."""
    columns = {
        "region": "r_regionkey int, r_name string",
        "nation": "n_nationkey int, n_name string, n_regionkey int",
        "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
        "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
                  " o_orderdate timestamp_ntz, o_orderpriority string",
        "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
                    " l_linestatus string, l_shipdate timestamp_ntz",
        "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
        "embeddings": "vec_id bigint, embedding array<float>, label int",
        "pages": "page_id bigint, url string, html string",
        "benchmark": "item_id bigint, text string",
        "labels": "doc_id bigint, quality int, toxic int",
        "conversations": "conv_id bigint, turn bigint, role string, text string",
    }
    size = {"string": "strlen({0})", "int": "4", "bigint": "8", "double": "8", "timestamp_ntz": "8",
            "array<float>": "4 * len({0})"}
    selects = []
    for table, listed in columns.items():
        for at, entry in enumerate(listed.split(", "), 1):
            name, kind = entry.strip().split(" ")
            width = size[kind].format(name)
            selects.append(
                f"select '{table}' as table_name, {at} as ordinal_position, '{name}' as column_name,"
                f" '{kind}' as type_text, true as nullable, count(*) as row_count,"
                f" count(*) - count({name}) as null_count, count(distinct {name}) as distinct_count,"
                f" cast(coalesce(sum(case when {name} is not null then {width} end), 0) as bigint) as byte_count"
                f" from {table}")
    return "\nunion all ".join(selects)


@check("src_4_lake_dictionary", _lake_sql())
def lake_dictionary(c: Catalog) -> DataFrame:
    return lake.dictionary({name: c.table(name) for name in TABLES})


@check("src_5_decoded_defaults", with_clause("cat_columns") + """
select oid, ordinal_position, case when column_default is null then null
  else coalesce(try_cast(column_default as integer), 0) end as default_number from cat_columns""")
def decoded_defaults(c: Catalog) -> DataFrame:
    return c.view("cat_columns").select(
        "oid", "ordinal_position", decode.decoded(F.col("column_default"), "int").alias("default_number"))


@check("src_5_decode_faults", with_clause("cat_columns") + """
select oid, ordinal_position, 'column_default' as field, column_default as raw from cat_columns
where column_default is not null and try_cast(column_default as integer) is null""")
def decode_faults(c: Catalog) -> DataFrame:
    return decode.faults(c.view("cat_columns"), {"column_default": "int"}, ["oid", "ordinal_position"])


# --- filters ------------------------------------------------------------------------------------

FLEET = with_clause("cat_tables", "fleet_tables")


@check("flt_1_user_schemas", f"{FLEET} select oid, dialect, schema_name from fleet_tables where {sql.USER_SCHEMA}")
def user_schemas(c: Catalog) -> DataFrame:
    return filters.user_schemas(c.fleet_tables()).select("oid", "dialect", "schema_name")


@check("flt_2_target_schemas",
       f"{FLEET} select oid, schema_name from fleet_tables where ({sql.USER_SCHEMA}) and schema_name in ('public', 'app')")
def target_schemas(c: Catalog) -> DataFrame:
    return filters.target_schemas(filters.user_schemas(c.fleet_tables()), TARGETS).select("oid", "schema_name")


@check("flt_3_excluded_names",
       f"{FLEET} select oid, table_name from fleet_tables where case dialect when 'mysql'"
       " then not table_name ilike 'TMP_%' and not table_name ilike 'log_%'"
       " else not table_name like 'TMP_%' and not table_name like 'log_%' end")
def excluded_names(c: Catalog) -> DataFrame:
    return filters.exclude_like(c.fleet_tables(), ["TMP_%", "log_%"]).select("oid", "table_name")


@check("flt_4_table_types", f"{FLEET} select table_type, count(*) as table_count from fleet_tables group by 1")
def table_types(c: Catalog) -> DataFrame:
    parts = filters.by_type(c.fleet_tables())
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("table_type").agg(F.count(F.lit(1)).alias("table_count"))


@check("flt_5_secondary_indexes", with_clause("cat_indexes")
       + " select oid, index_name from cat_indexes where not indisprimary")
def secondary_indexes(c: Catalog) -> DataFrame:
    return filters.without_primary_flag(c.view("cat_indexes")).select("oid", "index_name")


@check("flt_5_secondary_statistics", with_clause("cat_statistics")
       + " select oid, index_name, seq_in_index from cat_statistics where index_name <> 'PRIMARY'")
def secondary_statistics(c: Catalog) -> DataFrame:
    return filters.without_primary(c.view("cat_statistics")).select("oid", "index_name", "seq_in_index")


@check("flt_6_live_attributes", with_clause("cat_columns", "cat_attributes")
       + f" select oid, attnum, attname from cat_attributes where {sql.LIVE}")
def live_attributes(c: Catalog) -> DataFrame:
    return filters.live_attributes(c.attributes()).select("oid", "attnum", "attname")


@check("flt_7_table_constraints", with_clause("cat_constraints") + """
select oid, conname, contype from cat_constraints where contype in ('p', 'u', 'f', 'c')
and not (contype = 'c' and ends_with(conname, '_not_null'))""")
def table_constraints(c: Catalog) -> DataFrame:
    return filters.table_constraints(c.view("cat_constraints")).select("oid", "conname", "contype")


@check("flt_8_accepted_names", f"{FLEET} select oid, table_name from fleet_tables where not contains(table_name, ';')")
def accepted_names(c: Catalog) -> DataFrame:
    return filters.split_unsafe(c.fleet_tables())[0].select("oid", "table_name")


@check("flt_8_rejected_names", f"{FLEET} select oid, table_name, 'unsafe table name' as reason from fleet_tables"
       " where contains(table_name, ';')")
def rejected_names(c: Catalog) -> DataFrame:
    return filters.split_unsafe(c.fleet_tables())[1].select("oid", "table_name", "reason")


@check("flt_9_slow_extracts", with_clause("cat_log")
       + " select event_id, schema_name, table_name from cat_log where elapsed >= 1.0")
def slow_extracts(c: Catalog) -> DataFrame:
    return filters.slow_extracts(c.view("cat_log")).select("event_id", "schema_name", "table_name")


# --- text rules ---------------------------------------------------------------------------------

@check("txt_1_type_texts", with_clause("cat_columns")
       + f" select oid, ordinal_position, {sql.PG_TYPE} as column_type from cat_columns")
def type_texts(c: Catalog) -> DataFrame:
    return c.view("cat_columns").select("oid", "ordinal_position", types.pg_type_text(
        F.col("udt_name"), F.col("char_max_length"), F.col("numeric_precision"), F.col("numeric_scale"))
        .alias("column_type"))


@check("txt_2_extra_flags", with_clause("cat_columns")
       + f" select oid, ordinal_position, {sql.PG_EXTRA} as extra from cat_columns")
def extra_flags(c: Catalog) -> DataFrame:
    return c.view("cat_columns").select("oid", "ordinal_position", types.pg_extra(
        F.col("attidentity"), F.col("attgenerated"), F.col("column_default")).alias("extra"))


@check("txt_3_mysql_extra", with_clause("cat_columns")
       + f" select oid, ordinal_position, {sql.MYSQL_EXTRA} as extra from cat_columns")
def mysql_extra(c: Catalog) -> DataFrame:
    return c.view("cat_columns").select("oid", "ordinal_position", types.mysql_extra(
        F.nullif(F.col("attidentity"), F.lit("")), F.col("attgenerated")).alias("extra"))


@check("txt_4_index_definitions", with_clause("cat_indexes")
       + f" select oid, index_name, {sql.PARSED_INDEX} from cat_indexes")
def index_definitions(c: Catalog) -> DataFrame:
    return definitions.with_index_parts(c.view("cat_indexes")).select(
        "oid", "index_name", "is_unique", "index_columns", "predicate")


@check("txt_5_fk_actions", with_clause("cat_constraints") + f"""
select oid, conname, {sql.DELETE_ACTION} as delete_action, {sql.UPDATE_ACTION} as update_action
from cat_constraints where contype = 'f'""")
def fk_actions(c: Catalog) -> DataFrame:
    return relations.with_fk_actions(c.view("cat_constraints").where("contype = 'f'")).select(
        "oid", "conname", "delete_action", "update_action")


@check("txt_6_check_bodies", with_clause("cat_constraints")
       + f" select oid, conname, {sql.CHECK_BODY} as check_body from cat_constraints where contype in ('c', 'f')")
def check_bodies(c: Catalog) -> DataFrame:
    return c.view("cat_constraints").where("contype in ('c', 'f')").select(
        "oid", "conname", definitions.check_body(F.col("condef")).alias("check_body"))


@check("txt_7_quoted_names", with_clause("cat_views", "cat_tables", "fleet_tables") + """
select v.oid, case when contains(view_query, ';') or contains(view_query, '/*') or contains(view_query, '*/')
    or contains(view_query, chr(10)) or contains(view_query, chr(13)) then null
  when dialect = 'mysql' then '`' || replace(view_query, '`', '``') || '`'
  else '"' || replace(view_query, '"', '""') || '"' end as quoted,
  case when contains(view_query, ';') or contains(view_query, '/*') or contains(view_query, '*/')
    or contains(view_query, chr(10)) or contains(view_query, chr(13)) then null else view_query end as restored
from cat_views v join fleet_tables t on t.oid = v.oid""")
def quoted_names(c: Catalog) -> DataFrame:
    text = c.view("cat_views").join(c.fleet_tables().select("oid", "dialect"), "oid")
    quoted = text.withColumn("quoted", names.quote(F.col("view_query"), F.col("dialect")))
    return quoted.select("oid", "quoted", names.unquote(F.col("quoted"), F.col("dialect")).alias("restored"))


@check("txt_8_terminated", with_clause("cat_views")
       + r" select oid, regexp_replace(view_query, '[;\s]+$', '') || ';' as script from cat_views")
def terminated(c: Catalog) -> DataFrame:
    return c.view("cat_views").select("oid", texts.terminate(F.col("view_query")).alias("script"))


@check("txt_9_fences", with_clause("cat_views") + """
select oid, repeat('`', cast(greatest(3, 1 + coalesce(list_max(list_transform(
  regexp_extract_all(view_query, '`+'), lambda x: length(x))), 0)) as integer)) as fence from cat_views""")
def fences(c: Catalog) -> DataFrame:
    return c.view("cat_views").select("oid", texts.fence(F.col("view_query")).alias("fence"))


@check("txt_10_labels", with_clause("cat_statistics", "cat_tables") + """
select s.oid, s.index_name, s.seq_in_index, case s.non_unique when 1 then 'Normal' else 'Unique' end as label,
  coalesce(t.table_comment, '') as comment from cat_statistics s join cat_tables t on t.oid = s.oid""")
def labels(c: Catalog) -> DataFrame:
    rows = c.view("cat_statistics").join(c.view("cat_tables").select("oid", "table_comment"), "oid")
    return rows.select("oid", "index_name", "seq_in_index", texts.index_label(F.col("non_unique")).alias("label"),
                       texts.text_or_empty(F.col("table_comment")).alias("comment"))


# --- joins --------------------------------------------------------------------------------------

@check("jon_1_table_comments", with_clause("cat_tables", "cat_class", "cat_namespace") + """,
named as (
  select c.source_id, n.nspname, c.relname, c.oid, c.description,
         row_number() over (partition by c.source_id, n.nspname, c.relname order by c.oid) as place,
         count(*) over (partition by c.source_id, n.nspname, c.relname) as classes
  from cat_class c join cat_namespace n on n.source_id = c.source_id and n.oid = c.relnamespace)
select t.source_id, t.schema_name, t.table_name, n.oid as class_oid, n.description, n.classes
from cat_tables t left join named n on n.source_id = t.source_id and n.nspname = t.schema_name
  and n.relname = t.table_name and n.place = 1""")
def table_comments(c: Catalog) -> DataFrame:
    return relations.with_class(c.view("cat_tables"), c.view("cat_class"), c.view("cat_namespace")).select(
        "source_id", "schema_name", "table_name", "class_oid", "description", "classes")


COLUMNS = with_clause("cat_columns", "cat_attributes")


@check("jon_2_live_columns", COLUMNS.replace("cat_columns as (", "cat_columns as materialized (") + """,
named as materialized (select oid, ordinal_position, udt_name, concat('c', cast(ordinal_position as varchar)) as column_name from cat_columns)
select c.oid, c.ordinal_position, c.column_name, a.attnum, c.udt_name, a.attidentity
from named c join cat_attributes a on a.oid = c.oid and a.attname = c.column_name
where a.attnum > 0 and not a.attisdropped""")
def live_columns(c: Catalog) -> DataFrame:
    columns = c.view("cat_columns").selectExpr(
        "oid", "ordinal_position", "udt_name", "concat('c', cast(ordinal_position as string)) as column_name")
    return relations.live_columns(columns, c.attributes()).select(
        "oid", "ordinal_position", "column_name", "attnum", "udt_name", "attidentity")


KEYED = with_clause("cat_columns", "cat_attributes", "cat_indexes") + "," + sql.KEYS


@check("jon_3_index_members", KEYED + """
select a.oid, i.index_name, i.place - 1 as place, a.attname as column_name
from index_places i join cat_attributes a on a.oid = i.oid and a.attnum = i.attnum
where a.attnum > 0 and not a.attisdropped""")
def index_members(c: Catalog) -> DataFrame:
    return relations.index_members(c.view("cat_indexes"), c.attributes()).select(
        "oid", "index_name", F.col("at").cast("bigint").alias("place"), F.col("attname").alias("column_name"))


def _backed(c: Catalog) -> DataFrame:
    return c.view("cat_constraints").selectExpr("*", "replace(conname, 'con_', 'ix_') as index_name")


for _key, _kinds in (("jon_4_not_primary", ["p"]), ("jon_5_not_backing", ["p", "u"])):
    check(_key, with_clause("cat_indexes", "cat_constraints") + f"""
select oid, index_name from cat_indexes where index_name not in (
  select replace(conname, 'con_', 'ix_') from cat_constraints where contype in ({str(_kinds)[1:-1]}))""")(
        lambda c, kinds=_kinds: relations.without_constraint(
            c.view("cat_indexes"), _backed(c), kinds).select("oid", "index_name"))

USAGE = with_clause("cat_kcu", "cat_rc")


@check("jon_6_fk_usage", USAGE + """
select k.oid, k.constraint_name, k.ordinal_position, k.column_name, k.referenced_table_name,
  k.referenced_column_name, r.delete_rule, r.update_rule
from cat_kcu k join cat_rc r on r.constraint_name = k.constraint_name""")
def fk_usage(c: Catalog) -> DataFrame:
    return relations.fk_usage(c.view("cat_kcu"), c.view("cat_rc")).select(
        "oid", "constraint_name", "ordinal_position", "column_name", "referenced_table_name",
        "referenced_column_name", "delete_rule", "update_rule")


@check("jon_6_fk_usage_paired", USAGE + """
select k.oid, k.constraint_name, k.ordinal_position, k.column_name, k.referenced_table_name,
  k.referenced_column_name, r.delete_rule, r.update_rule
from cat_kcu k join cat_rc r on r.constraint_name = k.constraint_name""")
def fk_usage_paired(c: Catalog) -> DataFrame:
    usage = c.view("cat_kcu")
    declared = usage.selectExpr("oid", "constraint_name", "'FOREIGN KEY' as constraint_type").distinct()
    referenced = usage.select("oid", "constraint_name", "ordinal_position", "referenced_table_name",
                              "referenced_column_name")
    local = usage.select("oid", "constraint_name", "ordinal_position", "column_name")
    return relations.fk_usage_paired(declared, local, referenced, c.view("cat_rc")).select(
        "oid", "constraint_name", "ordinal_position", "column_name", "referenced_table_name",
        "referenced_column_name", "delete_rule", "update_rule")


@check("jon_7_referenced_tables", with_clause("cat_constraints", "cat_tables", "cat_namespace") + """
select c.oid, c.conname, n.nspname as ref_schema, t.table_name as ref_table
from cat_constraints c left join cat_tables t on t.oid = c.confrelid
left join (select distinct oid, nspname from cat_namespace) n on n.oid = t.oid % 10 where c.contype = 'f'""")
def referenced_tables(c: Catalog) -> DataFrame:
    classes = c.view("cat_tables").selectExpr("oid", "oid % 10 as relnamespace", "table_name as relname")
    spaces = c.view("cat_namespace").select("oid", "nspname").distinct()
    return relations.with_referenced_table(
        c.view("cat_constraints").where("contype = 'f'"), classes, spaces).select(
        "oid", "conname", "ref_schema", "ref_table")


@check("jon_8_pattern_table", f"{FLEET} select oid, table_name from fleet_tables where {sql.KEPT_NAME}")
def pattern_table(c: Catalog) -> DataFrame:
    patterns = c.spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return filters.exclude_by_pattern_table(c.fleet_tables(), patterns, OID).select("oid", "table_name")


# A pattern table that grows with the data: names of a kind of part, with and without wildcards.
GROWING_PATTERNS = ("concat(case p_partkey % 3 when 0 then 't_' when 1 then 'TMP_' else '%_' end,"
                    " cast(p_partkey as string), case when p_partkey % 2 = 0 then '%' else '' end) as pattern")


@check("jon_8_long_pattern_table", f"""{FLEET}, patterns as (select {GROWING_PATTERNS} from part)
select oid, table_name from fleet_tables t where not exists (select 1 from patterns p where
  case t.dialect when 'mysql' then t.table_name ilike p.pattern else t.table_name like p.pattern end)""")
def long_pattern_table(c: Catalog) -> DataFrame:
    patterns = c.table("part").selectExpr(GROWING_PATTERNS)
    return filters.exclude_by_pattern_table(c.fleet_tables(), patterns, OID).select("oid", "table_name")


RESOLVED = with_clause("cat_columns", "cat_attributes", "cat_constraints")


@check("jon_9_constraint_columns", RESOLVED + f""",
local as ({sql.names_at("cat_constraints", "conkey", "oid", "local_columns").format(attributes="cat_attributes")}),
remote as ({sql.names_at("cat_constraints", "confkey", "confrelid", "ref_columns").format(attributes="cat_attributes")})
select c.oid, c.conname, coalesce(local_columns, '') as local_columns, coalesce(ref_columns, '') as ref_columns
from cat_constraints c left join local l on l.oid = c.oid and l.conname = c.conname
left join remote r on r.oid = c.oid and r.conname = c.conname""")
def constraint_columns(c: Catalog) -> DataFrame:
    return relations.with_column_names(c.view("cat_constraints"), c.attributes()).select(
        "oid", "conname", F.array_join("local_columns", ", ").alias("local_columns"),
        F.array_join("ref_columns", ", ").alias("ref_columns"))


RECORD_SQL = sql.dictionary() + """,
c as (select source_id, schema_name, table_name, count(*) as n_columns,
        string_agg(column_name || ' ' || column_type, ',' order by ordinal_position) as columns from d_columns group by 1, 2, 3),
i as (select source_id, schema_name, table_name, count(*) as n_indexes,
        string_agg(index_name || '(' || index_columns || ')', ',' order by index_name) as indexes from d_indexes group by 1, 2, 3),
f as (select source_id, schema_name, table_name, count(*) as n_foreign_keys,
        string_agg(constraint_name || '>' || reference, ',' order by constraint_name) as foreign_keys
      from d_foreign_keys group by 1, 2, 3)
"""


def _flat(name: str, value) -> list:
    return [F.greatest(F.size(name), F.lit(0)).cast("bigint").alias(f"n_{name}"),
            F.array_join(F.transform(name, value), ",").alias(name)]


def _flat_records(records: DataFrame, *keep: str) -> DataFrame:
    """Nested lists as text, so that any engine can compare them."""
    return records.select(
        *dic.TABLE, *keep,
        *_flat("columns", lambda m: F.concat(m["column_name"], F.lit(" "), m["column_type"])),
        *_flat("indexes", lambda m: F.concat(m["index_name"], F.lit("("), m["index_columns"], F.lit(")"))),
        *_flat("foreign_keys", lambda m: F.concat(m["constraint_name"], F.lit(">"), m["reference"])))


@check("jon_10_records", RECORD_SQL + """
select t.source_id, t.schema_name, t.table_name, t.table_type, v.view_query,
  coalesce(n_columns, 0) as n_columns, columns, coalesce(n_indexes, 0) as n_indexes, indexes,
  coalesce(n_foreign_keys, 0) as n_foreign_keys, foreign_keys
from d_tables t left join d_views v using (source_id, schema_name, table_name)
left join c using (source_id, schema_name, table_name) left join i using (source_id, schema_name, table_name)
left join f using (source_id, schema_name, table_name)""")
def table_records(c: Catalog) -> DataFrame:
    records = dic.records(fleet(c)).withColumn("view_query", F.col("view.view_query"))
    return _flat_records(records, "table_type", "view_query")


# --- aggregates ---------------------------------------------------------------------------------

@check("agg_1_index_columns", with_clause("cat_statistics") + """
select oid, index_name, non_unique, string_agg(column_name, ',' order by seq_in_index) as index_columns
from cat_statistics where index_name <> 'PRIMARY' group by oid, index_name, non_unique""")
def index_columns(c: Catalog) -> DataFrame:
    return relations.listed_indexes(c.view("cat_statistics"))


@check("agg_2_foreign_keys", USAGE + """
select k.oid, k.constraint_name, string_agg(column_name, ', ' order by ordinal_position) as constraint_column,
  string_agg(referenced_column_name, ', ' order by ordinal_position) as ref_columns,
  min_by(referenced_table_name || '.' || referenced_column_name, ordinal_position) as reference,
  delete_rule as delete_action, update_rule as update_action
from cat_kcu k join cat_rc r on r.constraint_name = k.constraint_name
group by k.oid, k.constraint_name, delete_rule, update_rule""")
def foreign_keys(c: Catalog) -> DataFrame:
    return relations.foreign_keys(c.view("cat_kcu"), c.view("cat_rc")).select(
        "oid", "constraint_name", "constraint_column",
        F.array_join("ref_columns", ", ").alias("ref_columns"), "reference", "delete_action", "update_action")


@check("agg_2_foreign_keys_by_reference", USAGE + """
select k.oid, k.constraint_name, referenced_table_name || '.' || referenced_column_name as reference,
  string_agg(column_name, ',' order by ordinal_position) as constraint_column,
  delete_rule as delete_action, update_rule as update_action
from cat_kcu k join cat_rc r on r.constraint_name = k.constraint_name
group by k.oid, k.constraint_name, referenced_table_name, referenced_column_name, delete_rule, update_rule""")
def foreign_keys_by_reference(c: Catalog) -> DataFrame:
    return relations.foreign_keys_by_reference(c.view("cat_kcu"), c.view("cat_rc")).select(
        "oid", "constraint_name", "reference", "constraint_column", "delete_action", "update_action")


@check("agg_3_column_keys", KEYED + " select oid, column_name, column_key from column_keys")
def column_keys(c: Catalog) -> DataFrame:
    return relations.column_keys(c.view("cat_indexes"), c.attributes())


@check("agg_4_ordered_names", RESOLVED + f""",
local as ({sql.names_at("cat_constraints", "conkey", "oid", "local_columns").format(attributes="cat_attributes")})
select oid, conname, local_columns from local""")
def ordered_names(c: Catalog) -> DataFrame:
    named = relations.with_column_names(c.view("cat_constraints"), c.attributes())
    return named.where(F.size("local_columns") > 0).select(
        "oid", "conname", F.array_join("local_columns", ", ").alias("local_columns"))


@check("agg_5_nested_columns", RECORD_SQL
       + " select source_id, schema_name, table_name, n_columns, columns from c")
def nested_columns(c: Catalog) -> DataFrame:
    columns = dic.nested_children(fleet(c))[0]
    return columns.select(*dic.TABLE, *_flat(
        "columns", lambda m: F.concat(m["column_name"], F.lit(" "), m["column_type"])))


def _bytes(*columns: str) -> str:
    return " + ".join(f"coalesce(strlen(\"{c}\"), 0)" for c in columns)


def sizes_cte(start: str) -> str:
    """Bytes of every row of the dictionary's parts."""
    return start + f"""
sizes as (
  select source_id, schema_name, table_name, 256 + {_bytes("table_name", "table_type", "engine", "row_format", "collation", "comment")} as b from d_tables
  union all select source_id, schema_name, table_name, 216 + {_bytes("column_name", "column_type", "nullable", "default_value", "charset", "collation", "column_key", "extra", "comment")} from d_columns
  union all select source_id, schema_name, table_name, 96 + {_bytes("index_name", "index_columns", "predicate")} from d_indexes
  union all select source_id, schema_name, table_name, 120 + {_bytes("constraint_name", "constraint_column", "reference", "delete_action", "update_action")} from d_foreign_keys
  union all select source_id, schema_name, table_name, {_bytes("view_query", "charset", "collation")} from d_views)
"""


SIZES_SQL = sql.dictionary() + sizes_cte(",")


def size_text_sql(n: str) -> str:
    """Tenths of a unit, ties to even, in whole numbers."""

    def tenths(unit: int) -> str:
        whole, rest = f"({n} * 10 // {unit})", f"({n} * 10 % {unit})"
        return f"({whole} + case when {rest} * 2 > {unit} or ({rest} * 2 = {unit} and {whole} % 2 = 1) then 1 else 0 end)"

    def shown(unit: int, suffix: str) -> str:
        t = tenths(unit)
        return f"cast({t} // 10 as varchar) || '.' || cast({t} % 10 as varchar) || '{suffix}'"

    return (f"case when {n} >= 1048576 then {shown(1048576, 'MiB')} when {n} >= 1024 then {shown(1024, 'KiB')}"
            f" else cast({n} as varchar) || 'B' end")


@check("agg_6_table_sizes", SIZES_SQL + f"""
select source_id, schema_name, table_name, size_bytes, {size_text_sql("size_bytes")} as size_text from (
select source_id, schema_name, table_name, cast(sum(b) as bigint) as size_bytes from sizes group by 1, 2, 3)""")
def table_sizes(c: Catalog) -> DataFrame:
    return dic.table_sizes(fleet(c)).withColumn("size_text", texts.bytes_text(F.col("size_bytes")))


@check("agg_6_schema_sizes", SIZES_SQL + f"""
select source_id, schema_name, size_bytes, {size_text_sql("size_bytes")} as size_text from (
select source_id, schema_name, cast(sum(b) as bigint) as size_bytes from sizes group by 1, 2)""")
def schema_sizes(c: Catalog) -> DataFrame:
    return dic.schema_sizes(fleet(c)).withColumn("size_text", texts.bytes_text(F.col("size_bytes")))


@check("agg_7_table_counts", f"""{FLEET}
select source_id, schema_name, count(*) as table_count from fleet_tables where {sql.USER_SCHEMA} group by 1, 2""")
def table_counts(c: Catalog) -> DataFrame:
    return relations.table_counts(filters.user_schemas(c.fleet_tables()))


@check("agg_7_schema_counts", f"""{FLEET}
select source_id, count(distinct schema_name) as schema_count, count(*) as table_count
from fleet_tables where {sql.USER_SCHEMA} group by 1""")
def schema_counts(c: Catalog) -> DataFrame:
    return relations.schema_counts(filters.user_schemas(c.fleet_tables()))


@check("agg_8_first_warnings", with_clause("cat_log") + """
select schema_name, table_name, column_name, min(event_id) as first_event_id, count(*) as occurrences
from cat_log group by 1, 2, 3""")
def first_warnings(c: Catalog) -> DataFrame:
    return relations.first_warnings(c.view("cat_log"))


# --- positions and order ------------------------------------------------------------------------

@check("win_1_column_numbers", COLUMNS + """
select oid, attname, row_number() over (partition by oid order by attnum) - 1 as no
from cat_attributes where attnum > 0 and not attisdropped""")
def column_numbers(c: Catalog) -> DataFrame:
    live = filters.live_attributes(c.attributes()).withColumnRenamed("attnum", "ordinal_position")
    return relations.numbered_columns(live).select("oid", "attname", "no")


@check("win_2_first_references", with_clause("cat_kcu") + """
select oid, constraint_name, referenced_table_name || '.' || referenced_column_name as reference from (
  select *, row_number() over (partition by oid, constraint_name order by ordinal_position) as place from cat_kcu)
where place = 1""")
def first_references(c: Catalog) -> DataFrame:
    return relations.first_references(c.view("cat_kcu"))


@check("srt_1_sorted_names", f"{FLEET} select source_id, schema_name, table_name from fleet_tables"
       " order by source_id, schema_name, table_name")
def sorted_names(c: Catalog) -> DataFrame:
    return c.fleet_tables().select(*dic.TABLE).orderBy(*dic.TABLE)


@check("srt_2_sorted_columns", with_clause("cat_columns")
       + " select oid, ordinal_position, udt_name from cat_columns order by oid, ordinal_position")
def sorted_columns(c: Catalog) -> DataFrame:
    return c.view("cat_columns").select("oid", "ordinal_position", "udt_name").orderBy("oid", "ordinal_position")


@check("srt_3_sorted_constraints", with_clause("cat_constraints") + """
select oid, contype, conname from cat_constraints where contype in ('p', 'u', 'f', 'c')
order by oid, case contype when 'p' then 1 when 'u' then 2 when 'f' then 3 else 4 end, conname""")
def sorted_constraints(c: Catalog) -> DataFrame:
    rows = c.view("cat_constraints").where(F.col("contype").isin("p", "u", "f", "c"))
    return rows.select("oid", "contype", "conname").orderBy(
        "oid", relations.constraint_rank(F.col("contype")), "conname")
