"""The dictionary of a fleet: five DataFrames, keyed by (source_id, schema_name, table_name)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datadict.functions import definitions, types
from datadict.operators import filters, relations
from datadict.operators.ordered import named_lists, ordered_lists

TABLE = ("source_id", "schema_name", "table_name")


class Dictionary:
    """Five DataFrames, each planned when it is first used.

    tables        TABLE, dialect, table_type, engine, row_format, collation, comment
    columns       TABLE, ordinal_position, column_name, column_type, nullable, default_value, ...
    indexes       TABLE, index_name, non_unique, index_columns, predicate
    foreign_keys  TABLE, constraint_name, constraint_column, reference, actions
    views         TABLE, view_query, charset, collation
    """

    PARTS = ("tables", "columns", "indexes", "foreign_keys", "views")
    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame
    foreign_keys: DataFrame
    views: DataFrame

    def __init__(self, **parts: DataFrame | Callable[[], DataFrame]):
        self._parts = parts
        self.present = [p for p in self.PARTS if p in parts]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.PARTS:
            raise AttributeError(name)
        part = self._parts[name]
        value = part() if callable(part) else part
        setattr(self, name, value)
        return value


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def locate(child: DataFrame, tables: DataFrame, key: Sequence[str]) -> DataFrame:
    """Give a child relation its table's full name; children of other tables drop out."""
    names = tables.select(*key, *[c for c in TABLE if c not in key])
    return child.join(names, list(key))


def kept_tables(tables: DataFrame, targets: Sequence[str] | DataFrame | None = None,
                except_patterns: Sequence[str] = ()) -> DataFrame:
    """Tables of user schemas, of the target schemas, matching no exclusion pattern."""
    kept = filters.target_schemas(filters.user_schemas(tables), targets)
    return filters.exclude_like(kept, except_patterns)


def _headers(tables: DataFrame) -> DataFrame:
    return tables.select(*TABLE, "dialect", "table_type", "engine", "row_format",
                         F.col("table_collation").alias("collation"), F.col("table_comment").alias("comment"))


def mysql_dictionary(rel: Mapping[str, DataFrame], key: Sequence[str] = TABLE,
                     targets: Sequence[str] | None = None, except_patterns: Sequence[str] = ()) -> Dictionary:
    tables = kept_tables(rel["tables"], targets, except_patterns)
    base, views, _ = filters.by_type(tables)

    def columns() -> DataFrame:
        return locate(rel["columns"], base, key).select(
            *TABLE, "ordinal_position", "column_name", "column_type", F.col("is_nullable").alias("nullable"),
            F.col("column_default").alias("default_value"), F.col("character_set_name").alias("charset"),
            F.col("collation_name").alias("collation"), "column_key",
            types.mysql_extra(F.col("extra"), F.col("generation_expression")).alias("extra"),
            F.col("column_comment").alias("comment"))

    def indexes() -> DataFrame:
        return locate(relations.listed_indexes(rel["statistics"], key), base, key).select(
            *TABLE, "index_name", F.coalesce("non_unique", F.lit(1)).alias("non_unique"),
            "index_columns", _null().alias("predicate"))

    def foreign_keys() -> DataFrame:
        keys = relations.foreign_keys(rel["key_column_usage"], rel["referential_constraints"], key, separator=",")
        return locate(keys, base, key).select(
            *TABLE, "constraint_name", "constraint_column", "reference", "delete_action",
            "update_action")

    def bodies() -> DataFrame:
        return locate(rel["show_create"], views, key).select(
            *TABLE, F.coalesce("create_view", F.lit("")).alias("view_query"),
            F.coalesce("character_set_client", F.lit("")).alias("charset"),
            F.coalesce("collation_connection", F.lit("")).alias("collation"))

    return Dictionary(tables=lambda: _headers(tables), columns=columns, indexes=indexes,
                      foreign_keys=foreign_keys, views=bodies)


def postgres_foreign_keys(rel: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Foreign keys from the constraint catalog: names by position, table by oid, actions by text."""
    foreign = rel["constraints"].where(F.col("contype") == "f")
    named = relations.with_referenced_table(
        relations.with_column_names(foreign, rel["attributes"], key), rel["classes"], rel["namespaces"],
        source=[c for c in key if c != "oid"])
    first = F.element_at("ref_columns", 1)
    return relations.with_fk_actions(named).select(
        *key, F.col("conname").alias("constraint_name"),
        F.array_join("local_columns", ", ").alias("constraint_column"),
        F.concat(F.coalesce("ref_table", F.lit("")), F.lit("."),
                 F.coalesce(F.when(F.size("ref_columns") > 0, first), F.lit(""))).alias("reference"),
        "delete_action", "update_action")


def postgres_columns(rel: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    keys = relations.column_keys(rel["indexes"], rel["attributes"], key)
    described = relations.live_columns(rel["columns"], rel["attributes"], key)
    return described.join(keys.hint("merge"), [*key, "column_name"], "left").select(
        *key, "ordinal_position", "column_name",
        types.pg_type_text(F.col("udt_name"), F.col("char_max_length"), F.col("numeric_precision"),
                           F.col("numeric_scale")).alias("column_type"),
        F.col("is_nullable").alias("nullable"), F.col("column_default").alias("default_value"),
        _null().alias("charset"), F.col("collation_name").alias("collation"), "column_key",
        types.pg_extra(F.col("attidentity"), F.col("attgenerated"), F.col("column_default")).alias("extra"),
        F.col("column_comment").alias("comment"))


def postgres_dictionary(rel: Mapping[str, DataFrame], key: Sequence[str] = ("source_id", "oid"),
                        targets: Sequence[str] | None = None, except_patterns: Sequence[str] = (),
                        backing: Sequence[str] | None = None) -> Dictionary:
    """`backing` names what an index shares with the constraint it backs: table and name by default."""
    tables = kept_tables(rel["tables"], targets, except_patterns)
    base, views, _ = filters.by_type(tables)

    def columns() -> DataFrame:
        return locate(postgres_columns(rel, key), base, key).select(
            *TABLE, "ordinal_position", "column_name", "column_type", "nullable", "default_value", "charset",
            "collation", "column_key", "extra", "comment")

    def indexes() -> DataFrame:
        secondary = relations.without_constraint(rel["indexes"], rel["constraints"], ["p"],
                                                 backing or [*key, "index_name"])
        return definitions.with_index_parts(locate(secondary, base, key)).select(
            *TABLE, "index_name",
            F.when(F.col("is_unique"), 0).otherwise(1).alias("non_unique"), "index_columns", "predicate")

    def foreign_keys() -> DataFrame:
        return locate(postgres_foreign_keys(rel, key), base, key).select(
            *TABLE, "constraint_name", "constraint_column", "reference", "delete_action",
            "update_action")

    def bodies() -> DataFrame:
        return locate(rel["views"], views, key).select(
            *TABLE, "view_query", F.lit("").alias("charset"), F.lit("").alias("collation"))

    return Dictionary(tables=lambda: _headers(tables), columns=columns, indexes=indexes,
                      foreign_keys=foreign_keys, views=bodies)


def combine(*dictionaries: Dictionary) -> Dictionary:
    """One dictionary of several dialects or sources."""

    def part(name: str) -> Callable[[], DataFrame]:
        return lambda: reduce(DataFrame.unionByName, [getattr(d, name) for d in dictionaries])

    return Dictionary(**{name: part(name) for name in Dictionary.PARTS})


# --- records ------------------------------------------------------------------------------------

_COLUMN = ("ordinal_position", "column_name", "column_type", "nullable", "default_value", "charset",
           "collation", "column_key", "extra", "comment")
_INDEX = ("index_name", "non_unique", "index_columns", "predicate")
_FOREIGN = ("constraint_name", "constraint_column", "reference", "delete_action", "update_action")


def nested_children(d: Dictionary) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns, indexes and foreign keys as ordered arrays, one row per table that has any."""
    return (ordered_lists(d.columns, TABLE, _COLUMN[0], _COLUMN[1:], "columns"),
            named_lists(d.indexes, TABLE, _INDEX, "indexes"),
            named_lists(d.foreign_keys, TABLE, _FOREIGN, "foreign_keys"))


def records(d: Dictionary) -> DataFrame:
    """One nested record per table; a table that lacks a part, or all of them, is still there."""
    views = d.views.select(*TABLE, F.struct("view_query", "charset", "collation").alias("view"))
    joined = d.tables.join(views, list(TABLE), "left")
    for children in nested_children(d):
        joined = joined.join(children, list(TABLE), "left")
    return joined


# --- size ---------------------------------------------------------------------------------------

# Fixed overhead per record, in bytes. Sizes of the records in another language's memory have no
# meaning here; these are round figures for the fields of each record.
OVERHEAD = {"tables": 256, "columns": 216, "indexes": 96, "foreign_keys": 120, "views": 0}


def _text_bytes(df: DataFrame, overhead: int) -> Column:
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"
             and f.name not in ("source_id", "schema_name", "dialect")]
    total = F.lit(overhead)
    for name in texts:
        if name != "table_name":
            total = total + F.octet_length(F.coalesce(F.col(name), F.lit("")))
    return total.cast("bigint")


def table_sizes(d: Dictionary) -> DataFrame:
    """Bytes of dictionary text per table: one union of sizes, one aggregation."""
    own = d.tables.select(*TABLE, (_text_bytes(d.tables, OVERHEAD["tables"])
                                   + F.octet_length("table_name")).alias("size_bytes"))
    for name in ("columns", "indexes", "foreign_keys", "views"):
        child = getattr(d, name)
        own = own.unionByName(child.select(*TABLE, _text_bytes(child, OVERHEAD[name]).alias("size_bytes")))
    return own.groupBy(*TABLE).agg(F.sum("size_bytes").cast("bigint").alias("size_bytes"))


def ddl_sizes(created: DataFrame, dumped: DataFrame) -> DataFrame:
    """Bytes of each table's script, without building one.

    `created(TABLE, line)` holds the lines of re-created scripts: a script is its lines and a line break
    between two of them. `dumped(TABLE, ddl_text)` holds texts that came whole.
    """
    of_lines = created.groupBy(*TABLE).agg((F.sum(F.octet_length("line") + 1) - 1).cast("bigint").alias("ddl_bytes"))
    of_texts = dumped.select(*TABLE, F.octet_length(F.coalesce("ddl_text", F.lit(""))).cast("bigint").alias("ddl_bytes"))
    return of_lines.unionByName(of_texts).groupBy(*TABLE).agg(F.sum("ddl_bytes").cast("bigint").alias("ddl_bytes"))


def table_sizes_with_ddl(d: Dictionary, ddl: DataFrame) -> DataFrame:
    """Table sizes with the bytes of the scripts in `ddl(TABLE, ddl_bytes)`; a table without a script adds none."""
    sizes = table_sizes(d).select(*TABLE, "size_bytes", F.lit(0).cast("bigint").alias("ddl_bytes"))
    known = ddl.join(d.tables.select(*TABLE), list(TABLE), "left_semi")
    both = sizes.unionByName(known.select(*TABLE, F.col("ddl_bytes").alias("size_bytes"), "ddl_bytes"))
    return both.groupBy(*TABLE).agg(F.sum("size_bytes").cast("bigint").alias("size_bytes"),
                                    F.sum("ddl_bytes").cast("bigint").alias("ddl_bytes"))


def schema_sizes(d: Dictionary) -> DataFrame:
    return table_sizes(d).groupBy("source_id", "schema_name").agg(
        F.sum("size_bytes").cast("bigint").alias("size_bytes"))
