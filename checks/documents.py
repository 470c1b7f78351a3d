"""Documents: Markdown, CREATE TABLE, SQL scripts, sheet layout, and what the writers leave on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check, sql
from checks.catalog import OID, PATTERNS, _flat_records, fleet, sizes_cte
from datadict.operators import filters, ordered
from datadict.plans import dictionary as dic
from datadict.plans import documents as doc
from datadict.sources import sinks
from datadict.sources.fixtures import Catalog
from datadict.storage import place, store

DICT = sql.dictionary(sql.KEPT_NAME)
T3 = "source_id, schema_name, table_name"

# Lines as (section, table_name, block, item, item_name, line_no, line); block numbers only order.
MARKDOWN = DICT + f""",
docs as (select source_id, schema_name, min(table_name) as first_name from d_tables group by 1, 2),
tv as (
  select t.*, v.view_query, v.charset as v_charset, v.collation as v_collation,
    repeat('`', cast(greatest(3, 1 + coalesce(list_max(list_transform(
      regexp_extract_all(v.view_query, '`+'), lambda x: length(x))), 0)) as integer)) as mark
  from d_tables t left join d_views v using ({T3})),
body as (
  select {T3}, unnest(string_split(regexp_replace(view_query, '\\n$', ''), chr(10))) as line,
         generate_subscripts(string_split(regexp_replace(view_query, '\\n$', ''), chr(10)), 1) as line_no
  from d_views),
fixed(kind, block, line) as (values
  ('BASE TABLE', 3, '|Table type|Engine|Row format|Collate|Comment|'), ('BASE TABLE', 4, '|---|---|---|---|---|'),
  ('BASE TABLE', 6, ''), ('BASE TABLE', 7, '**Columns**'),
  ('BASE TABLE', 8, '|Name|Type|Nullable|Default|Charset|Collation|Key|Extra|Comment|'),
  ('BASE TABLE', 9, '|---|---|---|---|---|---|---|---|---|'), ('BASE TABLE', 11, ''),
  ('VIEW', 3, '|Table type|Charset|Collate|'), ('VIEW', 4, '|---|---|---|'), ('VIEW', 6, ''),
  ('VIEW', 18, '**View Create SQL**')),
all_lines as (
  select source_id, schema_name, 0 as section, '' as table_name, 1 as block, 0 as item, '' as item_name, 0 as line_no,
         schema_name || ' ' as line from docs
  union all select source_id, schema_name, 0, '', 2, 0, '', 0, '=============' from docs
  union all select source_id, schema_name, 0, '', 3, 0, '', 0, '' from docs
  union all select source_id, schema_name, 0, '', 4, 0, '', 0, '## Table List' from docs
  union all select t.source_id, t.schema_name, 1, t.table_name, 0, 0, '', 0,
    case when t.table_name = d.first_name then '' else ' ' end || '- [' || t.table_name || ' ('
      || coalesce(t.comment, '') || ')](#' || lower(t.table_name) || ')'
    from d_tables t join docs d on d.source_id = t.source_id and d.schema_name = t.schema_name
  union all select source_id, schema_name, 2, '', 0, 0, '', 0, ' ' from docs
  union all select {T3.replace("table_name", "3, table_name")}, 1, 0, '', 0, '## ' || lower(table_name) from d_tables
  union all select source_id, schema_name, 3, table_name, 2, 0, '', 0, '**Information**' from d_tables
  union all select source_id, schema_name, 3, table_name, 99, 0, '', 0, ' ' from d_tables
  union all select t.source_id, t.schema_name, 3, t.table_name, f.block, 0, '', 0, f.line
    from d_tables t join fixed f on f.kind = t.table_type
  union all select source_id, schema_name, 3, table_name, 5, 0, '', 0,
    case when table_type = 'BASE TABLE' then concat('|', table_type, '|', engine, '|', row_format, '|', "collation", '|', comment, '|')
         when view_query is null then '|VIEW||  |' else concat('|VIEW|', v_charset, '|', v_collation, '|') end from tv
  union all select source_id, schema_name, 3, table_name, 10, ordinal_position, '', 0,
    concat('|', column_name, '|', column_type, '|', nullable, '|', default_value, '|', charset, '|', "collation", '|',
           column_key, '|', extra, '|', comment, '|') from d_columns
  union all select distinct source_id, schema_name, 3, table_name, 12, 0, '', 0, '**Index**' from d_indexes
  union all select distinct source_id, schema_name, 3, table_name, 14, 0, '', 0, '' from d_indexes
  union all select source_id, schema_name, 3, table_name, 13, 0, index_name, 0,
    concat('- [', case non_unique when 1 then 'Normal' else 'Unique' end, ']', index_name, '(', index_columns, ')',
           case when predicate is not null then ' WHERE ' || predicate end) from d_indexes
  union all select distinct source_id, schema_name, 3, table_name, 15, 0, '', 0, '**Constraint**' from d_foreign_keys
  union all select distinct source_id, schema_name, 3, table_name, 17, 0, '', 0, '' from d_foreign_keys
  union all select source_id, schema_name, 3, table_name, 16, 0, constraint_name, 0,
    concat('- ', constraint_name, ' FOREIGN KEY (', constraint_column, ') Reference ', reference,
           ' ON DELETE ', delete_action, ' ON UPDATE ', update_action) from d_foreign_keys
  union all select source_id, schema_name, 3, table_name, 19, 0, '', 0, '' from tv where table_type = 'VIEW' and view_query is not null
  union all select source_id, schema_name, 3, table_name, 20, 0, '', 0, mark || 'sql' from tv
    where table_type = 'VIEW' and view_query is not null
  union all select source_id, schema_name, 3, table_name, 21, 0, '', line_no, line from body
  union all select source_id, schema_name, 3, table_name, 22, 0, '', 0, mark from tv
    where table_type = 'VIEW' and view_query is not null)
"""

PLACED = ("select source_id, schema_name, row_number() over (partition by source_id, schema_name"
          " order by section, table_name, block, item, item_name, line_no) as position, line from all_lines")


def markdown(c: Catalog) -> DataFrame:
    return doc.markdown_lines(fleet(c, PATTERNS))


@check("doc_2_markdown", MARKDOWN + PLACED)
def markdown_positions(c: Catalog) -> DataFrame:
    return doc.positions(markdown(c))


@check("win_4_line_positions", MARKDOWN + """
select source_id, schema_name, section, count(*) as line_count, min(position) as first_position,
  max(position) as last_position from (
  select *, row_number() over (partition by source_id, schema_name
    order by section, table_name, block, item, item_name, line_no) as position from all_lines) group by 1, 2, 3""")
def line_positions(c: Catalog) -> DataFrame:
    placed = ordered.number_rows_by_range(store(markdown(c), "lines"), doc.DOCUMENT, doc.ORDER, "position")
    return placed.groupBy(*doc.DOCUMENT, "section").agg(
        F.count(F.lit(1)).alias("line_count"), F.min("position").alias("first_position"),
        F.max("position").alias("last_position"))


@check("set_1_document_lines", MARKDOWN + "select source_id, schema_name, section, table_name, line from all_lines")
def document_lines(c: Catalog) -> DataFrame:
    return markdown(c).select("source_id", "schema_name", "section", "table_name", "line")


@check("win_3_sheet_starts", DICT + f""",
c as (select {T3}, count(*) as n from d_columns group by all),
i as (select {T3}, count(*) as n from d_indexes group by all),
f as (select {T3}, count(*) as n from d_foreign_keys group by all),
heights as (
  select t.source_id, t.schema_name, t.table_name, 9 + case t.table_type
    when 'BASE TABLE' then 1 + coalesce(c.n, 0) + coalesce(2 + i.n, 0) + coalesce(2 + f.n, 0)
    when 'VIEW' then 2 else 0 end as height
  from d_tables t left join c using ({T3}) left join i using ({T3}) left join f using ({T3}))
select {T3}, height, cast(coalesce(sum(height) over (partition by source_id, schema_name order by table_name
  rows between unbounded preceding and 1 preceding), 0) as bigint) as start_row from heights""")
def sheet_starts(c: Catalog) -> DataFrame:
    return doc.sheet_starts(fleet(c, PATTERNS))


# --- CREATE TABLE and scripts -------------------------------------------------------------------

def _quoted(name: str) -> str:
    return f"'\"' || replace({name}, '\"', '\"\"') || '\"'"


def _quoted_list(names: str) -> str:
    return f"coalesce(case when {names} <> '' then '\"' || replace({names}, ', ', '\", \"') || '\"' end, '')"


CREATED = DICT + f""",
pg_base as (select * from base_pg),
entries as (
  select {sql.TABLE}, 20 as block, ordinal_position as item, '' as item_name,
    '    ' || {_quoted("a.attname")} || ' ' || ({sql.PG_TYPE}) || case is_nullable when 'YES' then '' else ' NOT NULL' end
    || case when a.attgenerated = 's' then ' GENERATED ALWAYS AS (' || a.attgenerated || ') STORED'
            when column_default is not null then ' DEFAULT ' || column_default else '' end as line
  from cat_columns c join pg_base t on t.oid = c.oid
  join cat_attributes a on a.oid = c.oid and a.attname = concat('c', cast(ordinal_position as varchar))
  where a.attnum > 0 and not a.attisdropped
  union all
  select {sql.TABLE}, 30, case contype when 'p' then 1 when 'u' then 2 when 'f' then 3 else 4 end, conname,
    '    CONSTRAINT ' || {_quoted("conname")} || ' ' || case contype
      when 'p' then 'PRIMARY KEY (' || {_quoted_list("local_columns")} || ')'
      when 'u' then 'UNIQUE (' || {_quoted_list("local_columns")} || ')'
      when 'f' then 'FOREIGN KEY (' || {_quoted_list("local_columns")} || ') REFERENCES '
        || {_quoted("ref_schema")} || '.' || case when contains(ref_table, ';') then null else {_quoted("ref_table")} end
        || ' (' || {_quoted_list("ref_columns")} || ') ON DELETE '
        || delete_action || ' ON UPDATE ' || update_action
      else 'CHECK (' || {sql.CHECK_BODY} || ')' end
  from pg_resolved c join pg_base t on t.oid = c.oid
  where contype in ('p', 'u', 'f', 'c') and not (contype = 'c' and ends_with(conname, '_not_null'))),
failed as (
  select {T3}, case when contains(table_name, ';') then 'unsafe table name' else 'unsafe name in a column or constraint' end as reason
  from pg_base where contains(table_name, ';') or ({T3}) in (select ({T3}) from entries where line is null)),
counted as (select *, row_number() over (partition by {T3} order by block desc, item desc, item_name desc) as back from entries),
created as (
  select {T3}, 10 as block, 0 as item, '' as item_name,
    'CREATE TABLE ' || {_quoted("schema_name")} || '.' || {_quoted("table_name")} || ' (' as line from pg_base
  union all select {T3}, 11, 0, '', '' from pg_base where ({T3}) not in (select ({T3}) from entries)
  union all select {T3}, block, item, item_name, line || case back when 1 then '' else ',' end from counted
  union all select {T3}, 90, 0, '', ');' from pg_base
  union all select {sql.TABLE}, 95, indexrelid, '', indexdef || ';' from cat_indexes i join pg_base t on t.oid = i.oid
    where not indisprimary and index_name not in (select replace(conname, 'con_', 'ix_') from pg_constraints
                                                  where contype in ('p', 'u'))),
create_lines as (select * from created where ({T3}) not in (select ({T3}) from failed))
"""


def _postgres_ddl(c: Catalog) -> tuple[DataFrame, DataFrame]:
    rel = c.stored().postgres()
    base = filters.by_type(dic.kept_tables(rel["tables"], except_patterns=PATTERNS))[0]
    return doc.create_table_lines(doc.postgres_ddl_inputs(rel, base, OID, backing=("index_name",)))


@check("doc_1_create_table", CREATED + f"""
select {T3}, row_number() over (partition by {T3} order by block, item, item_name) as position, line from create_lines""")
def create_table(c: Catalog) -> DataFrame:
    made = store(_postgres_ddl(c)[0], "lines")
    return ordered.number_rows_by_range(made, dic.TABLE, ["block", "item", "item_name", "line_no"], "position") \
        .select(*dic.TABLE, "position", "line")


@check("doc_1_failed_tables", CREATED + f"select {T3}, reason from failed")
def failed_tables(c: Catalog) -> DataFrame:
    return _postgres_ddl(c)[1]


SCRIPTS = CREATED + f""",
accepted as (select * from located where not contains(table_name, ';')),
dump_texts as (
  select {sql.TABLE}, case when t.dialect = 'postgres' then 'CREATE VIEW ' || {_quoted("t.schema_name")} || '.'
    || {_quoted("t.table_name")} || ' AS' || chr(10) || v.view_query else v.view_query end as ddl_text
  from accepted t join cat_views v on v.oid = t.oid where t.dialect = 'mysql' or t.table_type = 'VIEW'),
other_texts as (
  select t.source_id, t.schema_name, t.table_name,
    regexp_replace(coalesce(d.ddl_text, ''), '[;\\s]+$', '') || ';' as script
  from accepted t left join dump_texts d using ({T3}) where not (t.dialect = 'postgres' and t.table_type = 'BASE TABLE')),
all_lines as (
  select distinct source_id, schema_name, 0 as section, '' as table_name, 0 as block, 0 as item, '' as item_name,
    0 as line_no, '/* Database : ' || schema_name || ' */' as line from located
  union all select source_id, schema_name, 3, table_name, 1, 0, '', 0, '/* Table : ' || table_name || ' */' from accepted
  union all select source_id, schema_name, 3, table_name, 98, 0, '', 0, '' from accepted
  union all select source_id, schema_name, 3, table_name, 99, 0, '', 0, '' from accepted
  union all select source_id, schema_name, 3, table_name, block, item, item_name, 0, line from create_lines
  union all select source_id, schema_name, 3, table_name, 40, 0, '', 0, ';' from failed where not contains(table_name, ';')
  union all select source_id, schema_name, 3, table_name, 40, 0, '',
    generate_subscripts(string_split(script, chr(10)), 1), unnest(string_split(script, chr(10))) from other_texts)
"""


def _dumped(c: Catalog, tables: DataFrame) -> DataFrame:
    """Script texts that came whole: of MySQL, and of the views of PostgreSQL."""
    mysql, postgres = c.stored().mysql(), c.stored().postgres()
    dumped = dic.locate(mysql["show_create"], tables, OID).select(
        *dic.TABLE, F.coalesce("create_table", "create_view").alias("ddl_text"))
    views = dic.postgres_dictionary(postgres, OID, except_patterns=PATTERNS).views
    return dumped.unionByName(doc.view_script(views, "postgres"))


def scripts(c: Catalog) -> tuple[DataFrame, DataFrame]:
    tables = dic.kept_tables(c.fleet_tables(), except_patterns=PATTERNS)
    made, failed = _postgres_ddl(c)
    return doc.script_lines(tables, made, failed, _dumped(c, tables))


@check("agg_6_ddl_sizes", SCRIPTS + sizes_cte(",") + f""",
texts as (
  select {T3}, string_agg(line, chr(10) order by block, item, item_name) as t from create_lines group by {T3}
  union all select {T3}, ddl_text from accepted join dump_texts using ({T3}))
select {T3}, cast(sum(b) as bigint) as size_bytes, cast(sum(d) as bigint) as ddl_bytes from (
  select {T3}, b, 0 as d from sizes
  union all select {T3}, strlen(coalesce(t, '')), strlen(coalesce(t, '')) from texts) group by {T3}""")
def ddl_sizes(c: Catalog) -> DataFrame:
    tables = dic.kept_tables(c.fleet_tables(), except_patterns=PATTERNS)
    accepted = filters.split_unsafe(tables)[0]
    dumped = _dumped(c, tables).join(accepted.select(*dic.TABLE), list(dic.TABLE), "left_semi")
    return dic.table_sizes_with_ddl(fleet(c, PATTERNS), dic.ddl_sizes(_postgres_ddl(c)[0], dumped))


@check("doc_3_sql_scripts", SCRIPTS + PLACED)
def sql_scripts(c: Catalog) -> DataFrame:
    return doc.positions(scripts(c)[0])


@check("doc_3_rejected_tables", DICT + f"select {T3}, 'unsafe table name' as reason from located where contains(table_name, ';')")
def rejected_tables(c: Catalog) -> DataFrame:
    return scripts(c)[1].select(*dic.TABLE, "reason")


# --- writers ------------------------------------------------------------------------------------

@check("snk_1_markdown_files", MARKDOWN + "select source_id, schema_name, line from all_lines")
def markdown_files(c: Catalog) -> DataFrame:
    path = place(c.spark, "markdown")
    sinks.write_documents(markdown(c), path)
    return c.spark.read.text(path).selectExpr("source_id", "schema_name", "value as line")


@check("snk_1_file_order", MARKDOWN + PLACED)
def markdown_file_order(c: Catalog) -> DataFrame:
    """The positions come from the files alone."""
    path = place(c.spark, "markdown")
    sinks.write_documents(markdown(c), path)
    return sinks.read_documents(c.spark, path)


@check("snk_2_script_files", SCRIPTS + "select source_id, schema_name, line from all_lines")
def script_files(c: Catalog) -> DataFrame:
    path = place(c.spark, "scripts")
    sinks.write_documents(scripts(c)[0], path)
    return c.spark.read.text(path).selectExpr("source_id", "schema_name", "value as line")


@check("snk_2_file_order", SCRIPTS + PLACED)
def script_file_order(c: Catalog) -> DataFrame:
    path = place(c.spark, "scripts")
    sinks.write_documents(scripts(c)[0], path)
    return sinks.read_documents(c.spark, path)


RECORDS = DICT + f"""
select t.source_id, t.schema_name, t.table_name, t.table_type,
  coalesce(c.n, 0) as n_columns, columns, coalesce(i.n, 0) as n_indexes, indexes, coalesce(f.n, 0) as n_foreign_keys, foreign_keys
from d_tables t
left join (select {T3}, count(*) as n, string_agg(column_name || ' ' || column_type, ',' order by ordinal_position) as columns
           from d_columns group by {T3}) c using ({T3})
left join (select {T3}, count(*) as n, string_agg(index_name || '(' || index_columns || ')', ',' order by index_name) as indexes
           from d_indexes group by {T3}) i using ({T3})
left join (select {T3}, count(*) as n, string_agg(constraint_name || '>' || reference, ',' order by constraint_name) as foreign_keys
           from d_foreign_keys group by {T3}) f using ({T3})"""


@check("snk_3_record_files", RECORDS)
def record_files(c: Catalog) -> DataFrame:
    path = place(c.spark, "records")
    sinks.write_records(fleet(c, PATTERNS), path)
    return _flat_records(c.spark.read.parquet(path), "table_type")


def _register_sheets() -> None:
    """One check per sheet: what comes back from the files is the part of the dictionary."""
    for part in dic.Dictionary.PARTS:
        def sheet(c: Catalog, part: str = part) -> DataFrame:
            path = place(c.spark, "sheets")
            sinks.write_sheets(dic.Dictionary(**{part: getattr(fleet(c, PATTERNS), part)}), path)
            return sinks.read_sheet(c.spark, path, part)

        check("snk_3_sheet_files" if part == "indexes" else f"snk_3_sheet_{part}", DICT + f"select * from d_{part}")(sheet)


_register_sheets()
