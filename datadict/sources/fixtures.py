"""Catalog relations derived from the given tables (`cat_*`), growing with them.

Each view is a list of select expressions over one table, kept as data so that Spark and the SQL
oracle read the same definition. Three views number the rows of a group; Spark does that with
`number_rows`, whose slices keep a hot group from landing in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datadict.operators.ordered import number_rows
from datadict.sources.dumps import Relations
from datadict.storage import store

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Slices of a hot group: rows whose leading sort key falls into the same span of this many values.
SLICE_SPAN = 1 << 20


@dataclass(frozen=True)
class View:
    source: str
    select: tuple[str, ...]
    where: str | None = None
    group: tuple[str, ...] = ()   # numbered views: row number `rn` per group ...
    order: tuple[str, ...] = ()   # ... in this order

    def sql(self) -> str:
        origin = self.source
        if self.group:
            over = f"partition by {', '.join(self.group)} order by {', '.join(self.order)}"
            origin = f"(select *, row_number() over ({over}) as rn from {self.source}) numbered"
        where = f" where {self.where}" if self.where else ""
        return f"select {', '.join(self.select)} from {origin}{where}"


SCHEMA_OF_PART = (
    "case p_partkey % 10 when 0 then 'public' when 1 then 'app' when 2 then 'sales' when 3 then 'ops'"
    " when 4 then 'pg_catalog' when 5 then 'information_schema' when 6 then 'pg_toast'"
    " when 7 then 'pg_temp_3' when 8 then 'mysql' else 'tmp' end")

VIEWS = {
    "cat_tables": View("part", (
        "p_partkey as oid",
        "concat('src', cast(p_partkey % 4 as string)) as source_id",
        f"{SCHEMA_OF_PART} as schema_name",
        "concat(case when p_size % 9 = 0 then 'tmp_' when p_size % 11 = 0 then 'log_' else 't_' end,"
        " cast(p_partkey as string), case when p_partkey % 97 = 0 then ';x' else '' end) as table_name",
        "case when p_partkey % 7 = 0 then 'VIEW' else 'BASE TABLE' end as table_type",
        "case when p_size % 4 <> 0 then p_type end as table_comment",
    )),
    "cat_columns": View("lineitem", (
        "l_partkey as oid",
        "cast(rn as int) as ordinal_position",
        "case l_linenumber when 1 then 'int8' when 2 then 'varchar' when 3 then 'bpchar'"
        " when 4 then 'numeric' when 5 then '_varchar' when 6 then '_numeric' else 'timestamptz' end as udt_name",
        "case when l_linenumber in (2,3,5) and l_tax > 0 then cast(l_quantity as int) end as char_max_length",
        "case when l_linenumber in (4,6) then cast(l_suppkey % 20 + 10 as int) end as numeric_precision",
        "case when l_linenumber in (4,6) and l_tax > 0 then cast(l_suppkey % 5 as int) end as numeric_scale",
        "case when l_returnflag = 'R' then 'YES' else 'NO' end as is_nullable",
        "case when l_linenumber = 1 and l_linestatus = 'O'"
        " then concat('nextval(''s', cast(l_suppkey as string), '''::regclass)')"
        " when l_tax = 0 then '0' end as column_default",
        "case when l_linenumber = 1 and l_returnflag = 'A' then 'a'"
        " when l_linenumber = 1 and l_returnflag = 'N' then 'd' else '' end as attidentity",
        "case when l_linenumber = 7 and l_linestatus = 'F' then 's' else '' end as attgenerated",
    ), group=("l_partkey",),
       order=("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")),
    "cat_indexes": View("orders", (
        "o_custkey as oid",
        "concat('ix_', cast(o_orderkey as string)) as index_name",
        "concat(case when o_orderstatus = 'F' then 'CREATE UNIQUE INDEX ix_' else 'CREATE INDEX ix_' end,"
        " cast(o_orderkey as string), ' ON app.t_', cast(o_custkey as string), ' USING btree (c1',"
        " case substr(o_orderpriority,1,1) when '1' then ' DESC NULLS LAST' when '2' then ', lower(c2)'"
        " when '3' then ' ASC, coalesce(c2, c3), c4 DESC' else '' end, ')',"
        " case when o_orderkey % 3 = 0 then concat(' WHERE (c1 > ', cast(o_custkey as string), ')') else '' end)"
        " as indexdef",
        "(o_orderkey % 5 = 0) as indisprimary",
        "(o_orderstatus = 'F' or o_orderkey % 5 = 0) as indisunique",
        "case substr(o_orderpriority,1,1) when '2' then '1 2' when '3' then '1 0 4' else '1' end as indkey",
        "o_orderkey as indexrelid",
    )),
    "cat_constraints": View("customer", (
        "c_custkey as oid",
        "concat('con_', cast(c_custkey as string), case when c_custkey % 10 = 3 then '_not_null' else '' end)"
        " as conname",
        "case c_custkey % 5 when 0 then 'p' when 1 then 'u' when 2 then 'f' when 3 then 'c' else 'x' end as contype",
        "case when c_custkey % 2 = 0 then '2 1' else '1' end as conkey",
        "case when c_custkey % 5 = 2 then (case when c_custkey % 2 = 0 then '1 3' else '1' end) end as confkey",
        "case when c_custkey % 5 = 2 then c_nationkey end as confrelid",
        "case c_custkey % 5 when 2 then concat('FOREIGN KEY (c1) REFERENCES t(c1)',"
        " case when c_custkey % 3 = 0 then ' ON UPDATE CASCADE' else '' end,"
        " case when c_nationkey % 2 = 0 then ' ON DELETE SET NULL' else '' end)"
        " when 3 then concat('CHECK ((c1 > ', cast(c_nationkey as string), '))') else '' end as condef",
    )),
    "cat_statistics": View("lineitem", (
        "l_partkey as oid",
        "concat('ix_', cast(l_suppkey % 3 as string)) as index_name",
        "cast(l_suppkey % 3 % 2 as int) as non_unique",
        "concat('c', cast(rn as string)) as column_name",
        "cast(rn as int) as seq_in_index",
    ), group=("l_partkey", "l_suppkey % 3"), order=("l_orderkey", "l_linenumber", "l_quantity")),
    "cat_kcu": View("lineitem", (
        "l_orderkey % 1000 as oid",
        "concat('fk_', cast(l_orderkey as string)) as constraint_name",
        "concat('c', cast(rn as string)) as column_name",
        "cast(rn as int) as ordinal_position",
        "concat('t_', cast(l_orderkey % 7 as string)) as referenced_table_name",
        "concat('r', cast(rn as string)) as referenced_column_name",
    ), group=("l_orderkey",), order=("l_partkey", "l_suppkey", "l_quantity")),
    "cat_rc": View("orders", (
        "concat('fk_', cast(o_orderkey as string)) as constraint_name",
        "case substr(o_orderpriority,1,1) when '1' then 'CASCADE' when '2' then 'SET NULL'"
        " when '3' then 'RESTRICT' else 'NO ACTION' end as delete_rule",
        "case o_orderstatus when 'F' then 'CASCADE' else 'NO ACTION' end as update_rule",
    ), where="o_orderkey % 4 <> 0"),
    "cat_class": View("part", (
        "p_partkey as oid",
        "concat('src', cast(p_partkey % 4 as string)) as source_id",
        "p_partkey % 10 as relnamespace",
        "concat('t_', cast(p_partkey % 50 as string)) as relname",
        "case when p_size % 4 <> 0 then p_type end as description",
    )),
    "cat_views": View("documents", (
        "doc_id as oid",
        "concat('select ', case when doc_id % 3 = 0 then '```' when doc_id % 5 = 0 then '`' else '' end,"
        " text, case when doc_id % 2 = 0 then chr(10) else '' end) as view_query",
    )),
    "cat_log": View("events", (
        "event_id", "ts", "event_type as schema_name",
        "concat('t_', cast(user_id % 50 as string)) as table_name",
        "concat('c', cast(event_id % 3 as string)) as column_name",
        "value / 10 as elapsed",
    )),
    # The namespaces and the per-server facts of the fleet.
    "cat_namespace": View("part", (
        "distinct concat('src', cast(p_partkey % 4 as string)) as source_id",
        "p_partkey % 10 as oid",
        f"{SCHEMA_OF_PART} as nspname",
    )),
}

# Two servers of the fleet are PostgreSQL, the others MySQL; added to `cat_tables` by `fleet_tables`.
FLEET_SELECT = (
    "oid", "source_id", "schema_name", "table_name", "table_type", "table_comment",
    "case when source_id in ('src0', 'src1') then 'postgres' else 'mysql' end as dialect",
    "case when source_id in ('src0', 'src1') then null else 'InnoDB' end as engine",
    "case when source_id in ('src0', 'src1') then null else 'Dynamic' end as row_format",
    "case when source_id in ('src0', 'src1') then 'en_US.UTF-8' else 'utf8mb4_general_ci' end as table_collation",
)
ATTRIBUTE_SELECT = (
    "oid", "ordinal_position - 1 as attnum", "concat('c', cast(ordinal_position as string)) as attname",
    "(attgenerated = 's' and is_nullable = 'YES') as attisdropped", "attidentity", "attgenerated",
)
# Column relations as the dictionary reads them; a column is named after its position.
IS_POSTGRES = "oid % 4 in (0, 1)"
COLUMN_NAME = "concat('c', cast(ordinal_position as string)) as column_name"
MYSQL_COLUMN_SELECT = (
    "oid", COLUMN_NAME, "ordinal_position", "column_default", "is_nullable", "udt_name as column_type",
    "cast(null as string) as character_set_name", "cast(null as string) as collation_name",
    "cast(null as string) as column_key", "nullif(attidentity, '') as extra",
    "attgenerated as generation_expression", "cast(null as string) as column_comment",
)
PG_COLUMN_SELECT = (
    "oid", COLUMN_NAME, "ordinal_position", "column_default", "is_nullable", "udt_name", "char_max_length",
    "numeric_precision", "numeric_scale", "cast(null as string) as collation_name",
    "attgenerated as generation_expression", "cast(null as string) as column_comment",
)
# A dump of SHOW CREATE has the text under one of two names, by the kind of the table.
SHOW_CREATE_SELECT = (
    "oid",
    "case when oid % 7 <> 0 then view_query end as create_table",
    "case when oid % 7 = 0 then view_query end as create_view",
    "'utf8mb4' as character_set_client", "'utf8mb4_general_ci' as collation_connection",
)


class Catalog:
    """The given tables of one directory and the catalog views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}
        self._stored: Catalog | None = None
        self._keep = False

    def stored(self) -> "Catalog":
        """The same catalog with `cat_columns` written once, for builds that read it many times.

        A real dump is on disk already; this view numbers rows, which is a shuffle at each use.
        """
        if self._keep:
            return self
        if self._stored is None:
            self._stored = Catalog(self.spark, self.sf_dir)
            self._stored._keep = True
        return self._stored

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Plan a relation once, so that its uses share one plan and Spark can reuse its exchanges."""
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self._once(name, lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def view(self, name: str) -> DataFrame:
        def build() -> DataFrame:
            df = self._build_view(name)
            return store(df, name) if self._keep and name == "cat_columns" else df

        return self._once(f"view {name}", build)

    def _build_view(self, name: str) -> DataFrame:
        spec = VIEWS[name]
        df = self.table(spec.source)
        if spec.where:
            df = df.where(spec.where)
        if spec.group:
            group = []
            for i, text in enumerate(spec.group):
                if text not in df.columns:
                    df, text = df.withColumn(f"_g{i}", F.expr(text)), f"_g{i}"
                group.append(text)
            span = F.floor(F.col(spec.order[0]) / SLICE_SPAN)
            df = number_rows(df, group, list(spec.order), span)
        first = spec.select[0]
        if first.startswith("distinct "):
            return df.selectExpr(first.removeprefix("distinct "), *spec.select[1:]).distinct()
        return df.selectExpr(*spec.select)

    def of_dialect(self, name: str, dialect: str) -> DataFrame:
        """Rows of the servers that speak the dialect; `oid` tells the server."""
        rule = IS_POSTGRES if dialect == "postgres" else f"not ({IS_POSTGRES})"

        def build() -> DataFrame:
            if self._keep and name == "cat_columns":
                # Stored by dialect: a build of one dialect does not number the other's columns.
                return store(self._build_view(name).where(rule), f"{dialect}-{name}")
            return self.view(name).where(rule)

        return self._once(f"{dialect} {name}", build)

    def mysql(self) -> Relations:
        """The dump relations of the MySQL servers, keyed by `oid`."""
        return Relations(
            tables=lambda: self.fleet_tables().where("dialect = 'mysql'"),
            columns=lambda: self.of_dialect("cat_columns", "mysql").selectExpr(*MYSQL_COLUMN_SELECT),
            statistics=lambda: self.of_dialect("cat_statistics", "mysql"),
            key_column_usage=lambda: self.of_dialect("cat_kcu", "mysql"),
            referential_constraints=lambda: self.view("cat_rc"),
            show_create=lambda: self.of_dialect("cat_views", "mysql").selectExpr(*SHOW_CREATE_SELECT),
        )

    def postgres(self) -> Relations:
        """The dump relations of the PostgreSQL servers, keyed by `oid`."""
        return Relations(
            tables=lambda: self.fleet_tables().where("dialect = 'postgres'"),
            columns=lambda: self.of_dialect("cat_columns", "postgres").selectExpr(*PG_COLUMN_SELECT),
            attributes=lambda: self.of_dialect("cat_columns", "postgres").selectExpr(*ATTRIBUTE_SELECT),
            indexes=lambda: self.of_dialect("cat_indexes", "postgres"),
            constraints=lambda: self.of_dialect("cat_constraints", "postgres").selectExpr(
                "*", "replace(conname, 'con_', 'ix_') as index_name"),
            classes=lambda: self.fleet_tables().selectExpr(
                "oid", "oid % 10 as relnamespace", "table_name as relname"),
            namespaces=lambda: self.view("cat_namespace").select("oid", "nspname").distinct(),
            views=lambda: self.of_dialect("cat_views", "postgres"),
        )

    def fleet_tables(self) -> DataFrame:
        return self._once("fleet", lambda: self.view("cat_tables").selectExpr(*FLEET_SELECT))

    def attributes(self) -> DataFrame:
        return self.view("cat_columns").selectExpr(*ATTRIBUTE_SELECT)


def with_clause(*names: str) -> str:
    """`with a as (...), b as (...)` for the named views, in order."""
    derived = {
        "fleet_tables": f"select {', '.join(FLEET_SELECT)} from cat_tables",
        "cat_attributes": f"select {', '.join(ATTRIBUTE_SELECT)} from cat_columns",
    }
    parts = [f"{n} as ({derived.get(n) or VIEWS[n].sql()})" for n in names]
    return "with " + ",\n".join(parts)
