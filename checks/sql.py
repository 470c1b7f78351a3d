"""SQL of the dictionary for DuckDB, written independently of the Spark plans."""

from datadict.sources.fixtures import with_clause

USER_SCHEMA = (
    "case when dialect = 'mysql'"
    " then schema_name not in ('information_schema', 'mysql', 'sys', 'performance_schema', 'tmp')"
    " else schema_name not in ('pg_catalog', 'information_schema', 'pg_toast')"
    " and not starts_with(schema_name, 'pg_temp_') and not starts_with(schema_name, 'pg_toast_temp_') end")
KEPT_NAME = "table_name not like 'tmp_%' and table_name not like 'log_%'"

PARSED_INDEX = r"""
  starts_with(upper(indexdef), 'CREATE UNIQUE INDEX') as is_unique,
  regexp_replace(regexp_extract(indexdef, 'USING btree \((.*?)\)( WHERE \(c1 > \d+\))?$', 1),
                 ' (ASC|DESC)( NULLS (FIRST|LAST))?', '', 'g') as index_columns,
  nullif(regexp_extract(indexdef, ' WHERE (.*)$', 1), '') as predicate"""

PG_TYPE = """
  case when udt_name in ('_varchar', '_bpchar') and char_max_length is not null
         then substr(udt_name, 2) || '(' || char_max_length || ')[]'
       when udt_name = '_numeric' and numeric_precision is not null and numeric_scale is not null
         then 'numeric(' || numeric_precision || ',' || numeric_scale || ')[]'
       when udt_name like '\\_%' escape '\\' then substr(udt_name, 2) || '[]'
       when char_max_length is not null
         then case udt_name when 'bpchar' then 'char' else udt_name end || '(' || char_max_length || ')'
       when udt_name = 'numeric' and numeric_precision is not null and numeric_scale is not null
         then 'numeric(' || numeric_precision || ',' || numeric_scale || ')'
       else udt_name end""".replace("\\\\", "\\")

PG_EXTRA = """
  case when attidentity in ('a', 'd') or column_default like '%nextval(%' then 'auto_increment'
       when attgenerated = 's' then 'STORED GENERATED' end"""

MYSQL_EXTRA = """
  case when nullif(attidentity, '') is not null and attgenerated <> '' then attidentity || ' ' || attgenerated
       when nullif(attidentity, '') is not null then attidentity
       when attgenerated <> '' then attgenerated end"""

LIVE = "(attnum > 0 and not attisdropped)"

# Column keys: strongest index membership per live column.
KEYS = f"""
index_places as (
  select oid, index_name, indisprimary, indisunique,
         cast(unnest(string_split(indkey, ' ')) as integer) as attnum,
         generate_subscripts(string_split(indkey, ' '), 1) as place
  from cat_indexes),
column_keys as (
  select a.oid, a.attname as column_name,
         case max(case when indisprimary then 3 when indisunique then 2 when i.attnum is not null then 1 end)
           when 3 then 'PRI' when 2 then 'UNI' when 1 then 'MUL' end as column_key
  from cat_attributes a left join index_places i on i.oid = a.oid and i.attnum = a.attnum
  where (a.attnum > 0 and not a.attisdropped) group by a.oid, a.attname)"""


def names_at(source: str, number_column: str, owner: str, out: str) -> str:
    return f"""
    select k.oid, k.conname, string_agg(attname, ', ' order by place) as {out}, min_by(attname, place) as first_{out}
    from (select c.oid, c.conname, c.{owner} as owner,
                 cast(unnest(string_split({number_column}, ' ')) as integer) as attnum,
                 generate_subscripts(string_split({number_column}, ' '), 1) as place
          from {source} c) k
    join {{attributes}} a on a.oid = k.owner and a.attnum = k.attnum and a.attnum > 0 and not a.attisdropped
    group by 1, 2"""


DELETE_ACTION = """
  case when condef like '%ON DELETE SET NULL%' then 'SET NULL' else 'NO ACTION' end"""
UPDATE_ACTION = """
  case when condef like '%ON UPDATE CASCADE%' then 'CASCADE' else 'NO ACTION' end"""

CHECK_BODY = r"case when condef like '%CHECK (%' then regexp_extract(condef, 'CHECK \((.*)\)$', 1) else condef end"

TABLE = "t.source_id, t.schema_name, t.table_name"
NULL = "cast(null as varchar)"


def dictionary(kept: str = "true") -> str:
    """CTEs d_tables, d_columns, d_indexes, d_foreign_keys, d_views (and their parts per dialect)."""
    views = with_clause("cat_tables", "fleet_tables", "cat_columns", "cat_attributes", "cat_indexes",
                        "cat_constraints", "cat_statistics", "cat_kcu", "cat_rc", "cat_views", "cat_namespace")
    return f"""{views},
located as (select * from fleet_tables where ({USER_SCHEMA}) and ({kept})),
base_my as (select * from located where dialect = 'mysql' and table_type = 'BASE TABLE'),
base_pg as (select * from located where dialect = 'postgres' and table_type = 'BASE TABLE'),
pg_attributes as (select * from cat_attributes where oid % 4 in (0, 1)),
{KEYS},
d_tables as (select source_id, schema_name, table_name, dialect, table_type, engine, row_format,
                    table_collation as collation, table_comment as comment from located),
my_columns as (
  select {TABLE}, ordinal_position, concat('c', cast(ordinal_position as varchar)) as column_name,
         udt_name as column_type, is_nullable as nullable, column_default as default_value,
         {NULL} as charset, {NULL} as collation, {NULL} as column_key, {MYSQL_EXTRA} as extra, {NULL} as comment
  from cat_columns c join base_my t on t.oid = c.oid),
pg_columns as (
  select {TABLE}, ordinal_position, a.attname as column_name, {PG_TYPE} as column_type, is_nullable as nullable,
         column_default as default_value, {NULL} as charset, {NULL} as collation, k.column_key,
         {PG_EXTRA.replace("attidentity", "a.attidentity").replace("attgenerated", "a.attgenerated")} as extra,
         {NULL} as comment
  from cat_columns c join base_pg t on t.oid = c.oid
  join cat_attributes a on a.oid = c.oid and a.attname = concat('c', cast(ordinal_position as varchar))
  left join column_keys k on k.oid = c.oid and k.column_name = a.attname
  where a.attnum > 0 and not a.attisdropped),
d_columns as (select * from my_columns union all select * from pg_columns),
my_indexes as (
  select {TABLE}, index_name, non_unique,
         string_agg(column_name, ',' order by seq_in_index) as index_columns, {NULL} as predicate
  from cat_statistics s join base_my t on t.oid = s.oid
  where index_name <> 'PRIMARY' group by {TABLE}, index_name, non_unique),
pg_indexes as (
  select {TABLE}, index_name, case when is_unique then 0 else 1 end as non_unique,
         index_columns, predicate
  from (select oid, index_name, {PARSED_INDEX} from cat_indexes
        where index_name not in (select replace(conname, 'con_', 'ix_') from cat_constraints
                                 where contype = 'p' and oid % 4 in (0, 1))) i
  join base_pg t on t.oid = i.oid),
d_indexes as (select * from my_indexes union all select * from pg_indexes),
my_foreign_keys as (
  select {TABLE}, k.constraint_name, string_agg(column_name, ',' order by ordinal_position) as constraint_column,
         min_by(referenced_table_name || '.' || referenced_column_name, ordinal_position) as reference,
         delete_rule as delete_action, update_rule as update_action
  from cat_kcu k join cat_rc r on r.constraint_name = k.constraint_name join base_my t on t.oid = k.oid
  group by {TABLE}, k.constraint_name, delete_rule, update_rule),
pg_constraints as (select * from cat_constraints where oid % 4 in (0, 1)),
pg_local as ({names_at("pg_constraints", "conkey", "oid", "local_columns").format(attributes="pg_attributes")}),
pg_remote as ({names_at("pg_constraints", "confkey", "confrelid", "ref_columns").format(attributes="pg_attributes")}),
pg_resolved as (
  select c.*, coalesce(local_columns, '') as local_columns, coalesce(ref_columns, '') as ref_columns,
         coalesce(first_ref_columns, '') as first_ref, coalesce(n.nspname, '') as ref_schema,
         coalesce(f.table_name, '') as ref_table, {DELETE_ACTION} as delete_action, {UPDATE_ACTION} as update_action
  from pg_constraints c left join pg_local l on l.oid = c.oid and l.conname = c.conname
  left join pg_remote m on m.oid = c.oid and m.conname = c.conname
  left join fleet_tables f on f.oid = c.confrelid
  left join (select distinct oid, nspname from cat_namespace) n on n.oid = f.oid % 10),
pg_foreign_keys as (
  select {TABLE}, conname as constraint_name, local_columns as constraint_column,
         ref_table || '.' || first_ref as reference, delete_action, update_action
  from pg_resolved c join base_pg t on t.oid = c.oid where contype = 'f'),
d_foreign_keys as (select * from my_foreign_keys union all select * from pg_foreign_keys),
d_views as (
  select {TABLE}, view_query, case dialect when 'mysql' then 'utf8mb4' else '' end as charset,
         case dialect when 'mysql' then 'utf8mb4_general_ci' else '' end as collation
  from cat_views v join located t on t.oid = v.oid where table_type = 'VIEW')"""


def dumped_dictionary() -> str:
    """The same dictionary of dumped relations: with their faults decoded, and numbers that hold inside a server."""
    views, rest = dictionary().split(",\nlocated as", 1)
    for name in ("cat_tables", "fleet_tables", "cat_columns", "cat_indexes", "cat_statistics", "cat_constraints"):
        rest = rest.replace(f"from {name} ", f"from dump_{name} ").replace(f"join {name} ", f"join dump_{name} ")
    rest = rest.replace("from cat_indexes)", "from dump_cat_indexes)")
    # A dump's index is matched with a constraint of its own table.
    backed = ("from dump_cat_indexes i where not exists (select 1 from cat_constraints k where k.contype = 'p'"
              " and k.oid = i.oid and k.conname = i.index_name)) i")
    start = rest.index("from cat_indexes\n        where index_name not in")
    end = rest.index(") i\n  join base_pg", start) + len(") i")
    rest = rest[:start] + backed + rest[end:]
    return f"""{views},
dump_fleet_tables as (
  select * replace (case when source_id = 'src2' then null else table_comment end as table_comment) from fleet_tables),
dump_cat_columns as (
  select * replace (case when oid % 4 in (0, 1) and oid % 13 = 0 then 0 else char_max_length end as char_max_length,
                    case when oid % 4 = 1 then null else numeric_scale end as numeric_scale) from cat_columns),
dump_cat_indexes as (
  select * replace (case when indisprimary then concat('con_', cast(oid as varchar)) else index_name end as index_name)
  from cat_indexes),
dump_cat_statistics as (
  select * replace (case when oid % 11 = 0 then 1 else non_unique end as non_unique) from cat_statistics),
dump_cat_constraints as (select * replace (confrelid * 4 + oid % 4 as confrelid) from cat_constraints),
located as{rest}"""
