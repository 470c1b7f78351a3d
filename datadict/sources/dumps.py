"""Catalog relations of many servers, from dump files or over JDBC: one read per relation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datadict import schemas
from datadict.sources import decode


@dataclass(frozen=True)
class DumpRun:
    """What one run reads. Credentials are not part of it."""

    dialect: str
    roots: Mapping[str, str]                  # source_id -> directory, or {"*": root of source_id=... dirs}
    fmt: str = "parquet"
    target_schemas: Sequence[str] = ()
    except_patterns: Sequence[str] = ()
    formats: Mapping[str, str] = field(default_factory=dict)  # source_id -> format, where it is not `fmt`

    def format_of(self, source_id: str) -> str:
        return self.formats.get(source_id, self.fmt)


class Relations(Mapping):
    """Relations by name, each planned when it is first used."""

    def __init__(self, **build: Callable[[], DataFrame]):
        self._build = build
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._build[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._build)

    def __len__(self) -> int:
        return len(self._build)


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Give a dump the fields of `schema`: case-insensitive names, tolerant types, nulls for absent ones."""
    have = {c.lower(): c for c in df.columns}
    defaults = defaults or {}

    def pick(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
        raw = F.col(f"`{have[f.name]}`")
        kind = f.dataType.simpleString()
        if kind == "binary":
            return raw.cast("binary").alias(f.name)
        if kind == "string":
            return decode.text_of(raw).alias(f.name)
        if f.name in defaults:
            return decode.required(raw, kind, defaults[f.name]).alias(f.name)
        return decode.decoded(raw, kind).alias(f.name)

    return df.select(*[pick(f) for f in schema.fields])


# An index whose uniqueness cannot be read counts as not unique.
FIELD_DEFAULTS = {"statistics": {"non_unique": 1}}


# Quoted empty text is told from nothing, which is null, by a character that no text may have.
_EMPTY_TEXT = "\ufffe"
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV by the names in its header, all columns text: nothing is null, `""` is empty text.

    A given schema would be laid over the columns by place, whatever the header says. Texts may hold
    line breaks, so a file is one task; write dumps in files of moderate size.
    """
    df = spark.read.options(**CSV_OPTIONS).option("emptyValue", _EMPTY_TEXT).csv(path)
    return df.select(*[
        F.when(F.col(f"`{f.name}`") == _EMPTY_TEXT, F.lit("")).otherwise(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_json(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """JSON lines without an inference pass: the named fields, in lower or upper case, as text."""
    df = spark.read.text(path)
    fields = F.from_json("value", "map<string,string>")
    rest = [F.col(f"`{c}`") for c in df.columns if c != "value"]
    return df.select(*rest, fields.alias("_fields")).select(
        *rest, *[F.coalesce(F.col("_fields")[n], F.col("_fields")[n.upper()]).alias(n) for n in names
                 if n not in df.columns])


def raw_relation(spark: SparkSession, run: DumpRun, relation: str, source_id: str) -> DataFrame:
    """`<root>/<relation>` of one source as it was dumped. With the root `*`, sources are `source_id=` directories."""
    schema = schemas.RELATIONS[schemas.normalise_dialect(run.dialect)][relation]
    path, fmt = f"{run.roots[source_id]}/{relation}", run.format_of(source_id)
    if fmt == "csv":
        df = read_csv(spark, path)
    elif fmt == "json":
        df = read_json(spark, path, schema.fieldNames())
        df = df if source_id == "*" else df.drop("source_id")
    else:
        df = spark.read.format(fmt).load(path)
    return df if source_id == "*" else df.withColumn("source_id", F.lit(source_id))


def read_relation(spark: SparkSession, run: DumpRun, relation: str) -> DataFrame:
    """One relation of all sources, in the fields of its schema."""
    schema = schemas.RELATIONS[schemas.normalise_dialect(run.dialect)][relation]
    parts = [conform(raw_relation(spark, run, relation, s), schema, FIELD_DEFAULTS.get(relation)) for s in run.roots]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_relations(spark: SparkSession, run: DumpRun) -> Relations:
    """All relations of the run's dialect, each read when it is first used."""
    names = schemas.RELATIONS[schemas.normalise_dialect(run.dialect)]
    return Relations(**{n: lambda n=n: read_relation(spark, run, n) for n in names})


def read_faults(spark: SparkSession, run: DumpRun, relation: str) -> DataFrame:
    """`source_id, relation, field, raw`: one row per value of a relation that cannot be read as its type."""
    schema = schemas.RELATIONS[schemas.normalise_dialect(run.dialect)][relation]
    typed = {f.name: f.dataType.simpleString() for f in schema.fields if f.dataType.simpleString() not in ("string", "binary")}

    def part(source_id: str) -> DataFrame:
        raw = raw_relation(spark, run, relation, source_id)
        raw = raw.withColumnsRenamed({c: c.lower() for c in raw.columns if c != c.lower()})
        kinds = {n: k for n, k in typed.items() if n in raw.columns}
        if not kinds:
            return raw.limit(0).select("source_id", F.lit("").alias("field"), F.lit("").alias("raw"))
        return decode.faults(raw, kinds, ["source_id"])

    found = reduce(lambda a, b: a.unionByName(b), [part(s) for s in run.roots])
    return found.select("source_id", F.lit(relation).alias("relation"), "field", "raw")


# The catalog query behind each JDBC relation. `{schemas}` is a list of names.
JDBC_QUERIES = {
    "mysql": {
        "schemata": "select schema_name as schema_name from information_schema.schemata",
        "tables": "select table_schema as schema_name, table_name, table_type, engine, row_format,"
                  " table_collation, table_comment from information_schema.tables",
        "columns": "select table_schema as schema_name, table_name, column_name, ordinal_position,"
                   " column_default, is_nullable, column_type, character_set_name, collation_name,"
                   " column_key, extra, generation_expression, column_comment from information_schema.columns",
        "statistics": "select table_schema as schema_name, table_name, index_name, non_unique,"
                      " column_name, seq_in_index from information_schema.statistics",
        "key_column_usage": "select table_schema as schema_name, table_name, constraint_name, column_name,"
                            " ordinal_position, referenced_table_name, referenced_column_name"
                            " from information_schema.key_column_usage",
        "referential_constraints": "select constraint_schema as schema_name, constraint_name, delete_rule,"
                                   " update_rule from information_schema.referential_constraints",
        # SHOW CREATE cannot stand in a query; the views' texts are kept here too, those of tables are not.
        "show_create": "select table_schema as schema_name, table_name, null as create_table,"
                       " concat('CREATE VIEW `', replace(table_name, '`', '``'), '` AS ', view_definition) as create_view,"
                       " character_set_client, collation_connection from information_schema.views",
    },
    "postgres": {
        "schemata": "select schema_name from information_schema.schemata",
        "tables": "select table_schema as schema_name, table_name, table_type from information_schema.tables",
        "columns": "select table_schema as schema_name, table_name, column_name, ordinal_position,"
                   " column_default, is_nullable, udt_name, character_maximum_length as char_max_length,"
                   " numeric_precision, numeric_scale, collation_name, generation_expression"
                   " from information_schema.columns",
        "pg_namespace": "select oid, nspname from pg_catalog.pg_namespace",
        "pg_class": "select oid, relname, relnamespace,"
                    " relkind::text as relkind, obj_description(oid, 'pg_class') as description"
                    " from pg_catalog.pg_class",
        "pg_attribute": "select attrelid, attnum::int as attnum, attname, attisdropped,"
                        " attidentity::text as attidentity, attgenerated::text as attgenerated,"
                        " col_description(attrelid, attnum) as description from pg_catalog.pg_attribute",
        "pg_index": "select i.indexrelid, i.indrelid,"
                    " i.indkey::text as indkey, i.indisprimary, i.indisunique, c.relname as indexname,"
                    " pg_get_indexdef(i.indexrelid) as indexdef from pg_catalog.pg_index i"
                    " join pg_catalog.pg_class c on c.oid = i.indexrelid",
        "pg_constraint": "select oid, conrelid, conname,"
                         " contype::text as contype, array_to_string(conkey, ' ') as conkey,"
                         " array_to_string(confkey, ' ') as confkey, confrelid,"
                         " conindid, pg_get_constraintdef(oid) as condef"
                         " from pg_catalog.pg_constraint",
        "pg_database": "select datcollate from pg_catalog.pg_database where datname = current_database()",
        "views": "select n.nspname as schema_name, c.relname as table_name, pg_get_viewdef(c.oid, true) as view_query"
                 " from pg_catalog.pg_class c join pg_catalog.pg_namespace n on n.oid = c.relnamespace"
                 " where c.relkind = 'v'",
    },
}

# The object number by which a relation is split, where it has no schema. It is left as the server's own
# type, so that a range of it is a range of the relation's index.
OID_COLUMNS = {"pg_class": "oid", "pg_attribute": "attrelid", "pg_index": "indrelid", "pg_constraint": "conrelid"}
OID_BOUNDS = "select min(oid) as least, max(oid) as most from pg_catalog.pg_class"


@dataclass(frozen=True)
class JdbcRun:
    """One live server. `schema_names` are the schemas to read, from its `schemata`; no list reads each relation as one part."""

    url: str
    dialect: str
    source_id: str
    properties: Mapping[str, str] = field(default_factory=dict)
    schema_names: Sequence[str] = ()
    parts: int = 16


def jdbc_predicates(schema_names: Sequence[str]) -> list[str]:
    """One partition per schema; names are quoted as SQL text."""
    return ["schema_name = '" + name.replace("'", "''") + "'" for name in schema_names]


def oid_predicates(column: str, least: int, most: int, parts: int) -> list[str]:
    """Ranges of object numbers that cover all of them: the first is open below, the last above."""
    count = max(1, min(parts, most - least + 1))
    cuts = [least + (most - least + 1) * i // count for i in range(1, count)]
    above = ["", *[f"{column} >= {c}" for c in cuts]]
    below = [*[f"{column} < {c}" for c in cuts], ""]
    return [" and ".join(p for p in pair if p) or "1 = 1" for pair in zip(above, below)]


def jdbc_split(run: JdbcRun, relation: str, bounds: tuple[int, int] | None) -> list[str]:
    """The partitions of a relation: by schema, by object number (`bounds` are those of pg_class), or none."""
    dialect = schemas.normalise_dialect(run.dialect)
    if "schema_name" in schemas.RELATIONS[dialect][relation].fieldNames() and relation != "schemata":
        return jdbc_predicates(run.schema_names)
    if dialect == "postgres" and relation in OID_COLUMNS and bounds is not None:
        return oid_predicates(OID_COLUMNS[relation], *bounds, run.parts)
    return []


def jdbc_bounds(spark: SparkSession, run: JdbcRun) -> tuple[int, int] | None:
    """The least and largest object number of a PostgreSQL server: one row."""
    if schemas.normalise_dialect(run.dialect) != "postgres":
        return None
    row = spark.read.jdbc(run.url, f"({OID_BOUNDS}) bounds", properties=dict(run.properties)).first()
    return None if row["least"] is None else (int(row["least"]), int(row["most"]))


def jdbc_relation(spark: SparkSession, run: JdbcRun, relation: str, bounds: tuple[int, int] | None = None) -> DataFrame:
    """One relation of one live server, split by schema or object number.

    The query texts and the splits are tested as data; no server was asked for them.
    """
    dialect = schemas.normalise_dialect(run.dialect)
    split = jdbc_split(run, relation, bounds)
    df = spark.read.jdbc(run.url, f"({JDBC_QUERIES[dialect][relation]}) relation", properties=dict(run.properties),
                         **({"predicates": split} if split else {}))
    return conform(df.withColumn("source_id", F.lit(run.source_id)), schemas.RELATIONS[dialect][relation],
                   FIELD_DEFAULTS.get(relation))


def jdbc_relations(spark: SparkSession, run: JdbcRun) -> Relations:
    """All relations of a live server, each read when it is first used; the bounds are asked for once."""
    names = JDBC_QUERIES[schemas.normalise_dialect(run.dialect)]
    known: list[tuple[int, int] | None] = []

    def bounds() -> tuple[int, int] | None:
        if not known:
            known.append(jdbc_bounds(spark, run))
        return known[0]

    return Relations(**{n: lambda n=n: jdbc_relation(spark, run, n, bounds() if n in OID_COLUMNS else None) for n in names})


def postgres_relations(raw: Mapping[str, DataFrame]) -> Relations:
    """Bring dumped PostgreSQL relations to the shape the dictionary reads, keyed by (source_id, oid)."""
    from datadict.operators import relations

    nothing = F.lit(None).cast("string")
    by_name = ["source_id", "schema_name", "table_name"]

    def named() -> DataFrame:
        return relations.with_class(raw["tables"], raw["pg_class"], raw["pg_namespace"]).withColumnsRenamed(
            {"class_oid": "oid", "description": "table_comment"}).drop("classes")

    def tables() -> DataFrame:
        collations = raw["pg_database"].withColumnRenamed("datcollate", "table_collation")
        return named().join(collations, "source_id", "left").withColumns(
            {"dialect": F.lit("postgres"), "engine": nothing, "row_format": nothing})

    def owned(name: str) -> DataFrame:
        return raw[name].join(named().select(*by_name, "oid"), by_name).drop("schema_name", "table_name")

    return Relations(
        tables=tables,
        columns=lambda: owned("columns"),
        attributes=lambda: raw["pg_attribute"].withColumnsRenamed({"attrelid": "oid", "description": "column_comment"}),
        indexes=lambda: raw["pg_index"].withColumnsRenamed({"indrelid": "oid", "indexname": "index_name"}),
        constraints=lambda: raw["pg_constraint"].drop("oid").withColumnRenamed("conrelid", "oid").withColumn(
            "index_name", F.col("conname")),
        classes=lambda: raw["pg_class"].select("source_id", "oid", "relnamespace", "relname"),
        namespaces=lambda: raw["pg_namespace"].select("source_id", "oid", "nspname"),
        views=lambda: owned("views"),
        schemata=lambda: raw["schemata"],
    )


def mysql_relations(raw: Mapping[str, DataFrame]) -> Relations:
    """MySQL relations need only the dialect and the decoded view text."""
    def show_create() -> DataFrame:
        return raw["show_create"].withColumns({
            "create_table": decode.text_of(F.col("create_table")),
            "create_view": decode.text_of(F.col("create_view")),
        })

    same = {n: lambda n=n: raw[n] for n in raw if n not in ("tables", "show_create")}
    return Relations(**same, tables=lambda: raw["tables"].withColumn("dialect", F.lit("mysql")), show_create=show_create)
