"""Joins and aggregates that turn catalog relations into dictionary tables.

`key` names the columns that identify a table: `oid` in one PostgreSQL server, `source_id, oid` in
a fleet, `source_id, schema_name, table_name` for MySQL. Every join is an equi-join against a side
that is unique on the join key. No side is broadcast by hint: Spark broadcasts what it has sized,
and adaptive execution splits a partition made large by one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datadict.functions import definitions
from datadict.operators import filters
from datadict.operators.ordered import LIST_SLICE, number_rows, ordered_lists, slice_of

OID = ("oid",)
UNREFERENCED = 1 << 40  # keys below zero for constraints that reference no table


def ordered_values(position: Column, value: Column) -> Column:
    """Aggregate: values in the order of their positions; null values are left out."""
    members = F.collect_list(F.when(value.isNotNull(), F.struct(position.alias("at"), value.alias("value"))))
    return F.transform(F.array_sort(members), lambda m: m["value"])


def positions_of(text: Column) -> Column:
    """`2 1` as an array of numbers; what is no number is null, and meets no column."""
    return F.transform(F.split(text, " "), lambda t: t.try_cast("int"))


# --- classes and namespaces -------------------------------------------------------------------

def resolve_classes(classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """One class per (source, schema, name). A dump that repeats a name keeps the lowest oid."""
    named = classes.join(
        namespaces.select("source_id", F.col("oid").alias("relnamespace"), "nspname"),
        ["source_id", "relnamespace"])
    return (
        named.groupBy("source_id", F.col("nspname").alias("schema_name"), F.col("relname").alias("table_name"))
        .agg(F.min(F.struct("oid", "description")).alias("c"), F.count(F.lit(1)).alias("classes"))
        .select("source_id", "schema_name", "table_name", F.col("c.oid").alias("class_oid"),
                F.col("c.description").alias("description"), "classes")
    )


def with_class(tables: DataFrame, classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Tables with the comment of their own class; the schema is part of the key."""
    resolved = resolve_classes(classes, namespaces)
    return tables.join(resolved, ["source_id", "schema_name", "table_name"], "left")


def with_referenced_table(constraints: DataFrame, classes: DataFrame, namespaces: DataFrame,
                          source: Sequence[str] = ()) -> DataFrame:
    """Constraints with the schema and name of the referenced table, if it is known.

    Most constraints reference nothing: their `confrelid` is null, or 0 in a dump of the server's own
    catalog. One key for all of them would be one task, so each has a number below zero, which no table has.
    """
    references = F.col("confrelid").isNotNull()
    if "contype" in constraints.columns:
        references = references & (F.col("contype") == "f")
    nothing = -1 - F.pmod(F.xxhash64(*constraints.columns), F.lit(UNREFERENCED))
    named = classes.join(
        namespaces.select(*source, F.col("oid").alias("relnamespace"), F.col("nspname").alias("ref_schema")),
        [*source, "relnamespace"], "left",
    ).select(*source, F.col("oid").cast("bigint").alias("_referenced"), "ref_schema", F.col("relname").alias("ref_table"))
    keyed = constraints.withColumn("_referenced", F.when(references, F.col("confrelid").cast("bigint")).otherwise(nothing))
    return keyed.join(named, [*source, "_referenced"], "left").drop("_referenced")


# --- columns ----------------------------------------------------------------------------------

def live_columns(columns: DataFrame, attributes: DataFrame, key: Sequence[str] = OID) -> DataFrame:
    """Columns that are live attributes, with the attribute's number and flags."""
    live = filters.live_attributes(attributes).withColumnRenamed("attname", "column_name")
    fresh = [c for c in live.columns if c in (*key, "column_name") or c not in columns.columns]
    # As many as the columns: never broadcast, however small their file.
    return columns.join(live.select(*fresh).hint("merge"), [*key, "column_name"])


def index_members(indexes: DataFrame, attributes: DataFrame, key: Sequence[str] = OID) -> DataFrame:
    """One row per index and column, joined on the attribute number inside `indkey`."""
    members = indexes.select(*key, "index_name", F.posexplode(positions_of(F.col("indkey"))).alias("at", "attnum"))
    live = filters.live_attributes(attributes).select(*key, "attnum", "attname")
    return members.join(live, [*key, "attnum"])


def column_keys(indexes: DataFrame, attributes: DataFrame, key: Sequence[str] = OID) -> DataFrame:
    """Strongest key a live column takes part in: PRI, UNI, MUL or null.

    The ranks are reduced per (table, attribute number) first, so that a table with very many
    indexes reaches the join as one row per column.
    """
    rank = F.when(F.col("indisprimary"), 3).when(F.col("indisunique"), 2).otherwise(1)
    strongest = (
        indexes.select(*key, rank.alias("rank"), F.explode(positions_of(F.col("indkey"))).alias("attnum"))
        .groupBy(*key, "attnum").agg(F.max("rank").alias("rank"))
    )
    label = F.when(F.col("rank") == 3, "PRI").when(F.col("rank") == 2, "UNI").when(F.col("rank") == 1, "MUL")
    return (
        filters.live_attributes(attributes).select(*key, "attnum", "attname")
        .join(strongest, [*key, "attnum"], "left")
        .select(*key, F.col("attname").alias("column_name"), label.alias("column_key"))
    )


def numbered_columns(columns: DataFrame, key: Sequence[str] = OID) -> DataFrame:
    """Add the 0-based `no` a column has in its table's list, whatever gaps the ordinals have."""
    numbered = number_rows(columns, key, ["ordinal_position"], slice_of(F.col("ordinal_position")), "no")
    return numbered.withColumn("no", F.col("no") - 1)


# --- indexes ----------------------------------------------------------------------------------

def _present(members: str, field: str) -> Column:
    """The field of a list's members, without nulls."""
    return F.filter(F.transform(members, lambda m: m[field]), lambda v: v.isNotNull())


def listed_indexes(statistics: DataFrame, key: Sequence[str] = OID, size: int = LIST_SLICE) -> DataFrame:
    """MySQL indexes with their columns in order, joined by commas: one row per index of any length."""
    key = [*key, "index_name", "non_unique"]
    lists = ordered_lists(filters.without_primary(statistics), key, "seq_in_index", ["column_name"], "members", size)
    return lists.select(*key, F.array_join(_present("members", "column_name"), ",").alias("index_columns"))


def without_constraint(indexes: DataFrame, constraints: DataFrame, kinds: Sequence[str],
                       match: Sequence[str] = ("index_name",)) -> DataFrame:
    """Indexes that back no constraint of the given kinds."""
    backing = constraints.where(F.col("contype").isin(*kinds)).select(*match)
    return indexes.join(backing, list(match), "left_anti")


# --- foreign keys -----------------------------------------------------------------------------

def _rule_key(rules: DataFrame) -> list[str]:
    """The columns that identify a constraint in the rules: all but the rules themselves."""
    return [c for c in rules.columns if c not in ("delete_rule", "update_rule")]


def fk_usage(usage: DataFrame, rules: DataFrame) -> DataFrame:
    """Column usage with the rules of its constraint; usage without rules is not a foreign key."""
    return usage.where(F.col("constraint_name") != "PRIMARY").join(rules, _rule_key(rules))


def fk_usage_paired(constraints: DataFrame, usage: DataFrame, referenced: DataFrame, rules: DataFrame,
                    key: Sequence[str] = OID) -> DataFrame:
    """Constraint, local column, referenced column and rules, paired by position.

    The table is part of the key, so that equal constraint names on two tables do not mix, and the
    position pairs the columns of a composite key one to one.
    """
    declared = constraints.where(F.col("constraint_type") == "FOREIGN KEY").select(*key, "constraint_name")
    return (
        usage.join(referenced, [*key, "constraint_name", "ordinal_position"])
        .join(declared, [*key, "constraint_name"], "left_semi")
        .join(rules, _rule_key(rules))
    )


def foreign_keys(usage: DataFrame, rules: DataFrame, key: Sequence[str] = OID, separator: str = ", ",
                 size: int = LIST_SLICE) -> DataFrame:
    """One row per foreign key: column lists in order, each column once, and the reference of the first pair.

    Lists are built before the rules are joined, so the join sees constraints and not columns.
    """
    pairs = ordered_lists(usage.where(F.col("constraint_name") != "PRIMARY"), [*key, "constraint_name"], "ordinal_position",
                          ["column_name", "referenced_table_name", "referenced_column_name"], "pairs", size)
    first = F.col("pairs")[0]
    listed = (
        pairs.withColumn("columns", F.array_distinct(F.col("pairs.column_name")))
        .withColumn("ref_columns", F.col("pairs.referenced_column_name"))
        .withColumn("constraint_column", F.array_join("columns", separator))
        .withColumn("reference", F.concat(first["referenced_table_name"], F.lit("."), first["referenced_column_name"]))
        .drop("pairs")
    )
    return listed.join(rules, _rule_key(rules)).withColumnsRenamed(
        {"delete_rule": "delete_action", "update_rule": "update_action"})


def foreign_keys_by_reference(usage: DataFrame, rules: DataFrame, key: Sequence[str] = OID,
                              size: int = LIST_SLICE) -> DataFrame:
    """MySQL's own grouping: a constraint gives one row per referenced column."""
    reference = F.concat("referenced_table_name", F.lit("."), "referenced_column_name")
    key = [*key, "constraint_name", "reference"]
    named = usage.where(F.col("constraint_name") != "PRIMARY").withColumn("reference", reference)
    listed = ordered_lists(named, key, "ordinal_position", ["column_name"], "members", size).select(
        *key, F.array_join(_present("members", "column_name"), ",").alias("constraint_column"))
    return listed.join(rules, _rule_key(rules)).withColumnsRenamed(
        {"delete_rule": "delete_action", "update_rule": "update_action"})


def first_references(usage: DataFrame, key: Sequence[str] = OID) -> DataFrame:
    """The referenced table and column in the first row of each constraint."""
    first = F.min(F.struct("ordinal_position", "referenced_table_name", "referenced_column_name")).alias("f")
    return usage.groupBy(*key, "constraint_name").agg(first).select(
        *key, "constraint_name",
        F.concat("f.referenced_table_name", F.lit("."), "f.referenced_column_name").alias("reference"))


# --- constraints ------------------------------------------------------------------------------

def _names_at(constraints: DataFrame, attributes: DataFrame, table: str, numbers: str, name: str,
              key: Sequence[str], source: Sequence[str]) -> DataFrame:
    places = constraints.select(
        *key, "conname", *([] if table in key else [table]),
        F.posexplode(positions_of(F.col(numbers))).alias("at", "attnum"))
    live = filters.live_attributes(attributes).select(
        *source, F.col("oid").alias(table), "attnum", "attname")
    return (
        places.join(live, [*source, table, "attnum"])
        .groupBy(*key, "conname").agg(ordered_values(F.col("at"), F.col("attname")).alias(name))
    )


def with_column_names(constraints: DataFrame, attributes: DataFrame, key: Sequence[str] = OID) -> DataFrame:
    """Resolve `conkey` and `confkey` to arrays of names, order kept; unknown numbers are left out.

    Only constraints with a position list are exploded, and each name list comes back on the
    constraint's own key, which is unique.
    """
    source = [c for c in key if c != "oid"]
    local = _names_at(constraints, attributes, "oid", "conkey", "local_columns", key, source)
    remote = _names_at(constraints.where("confrelid is not null"), attributes, "confrelid", "confkey",
                       "ref_columns", key, source)
    none = F.array().cast("array<string>")
    return (
        constraints.join(local, [*key, "conname"], "left").join(remote, [*key, "conname"], "left")
        .withColumn("local_columns", F.coalesce("local_columns", none))
        .withColumn("ref_columns", F.coalesce("ref_columns", none))
    )


def with_fk_actions(constraints: DataFrame) -> DataFrame:
    return (constraints
            .withColumn("delete_action", definitions.fk_action(F.col("condef"), "DELETE"))
            .withColumn("update_action", definitions.fk_action(F.col("condef"), "UPDATE")))


def constraint_rank(contype: Column) -> Column:
    return (F.when(contype == "p", 1).when(contype == "u", 2).when(contype == "f", 3)
            .when(contype == "c", 4))


# --- counts and warnings ----------------------------------------------------------------------

def table_counts(tables: DataFrame) -> DataFrame:
    return tables.groupBy("source_id", "schema_name").agg(F.count(F.lit(1)).alias("table_count"))


def schema_counts(tables: DataFrame) -> DataFrame:
    """Schemas per source, counted over the already grouped schemas."""
    return table_counts(tables).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("schema_count"), F.sum("table_count").cast("bigint").alias("table_count"))


def first_warnings(log: DataFrame) -> DataFrame:
    """One warning per (schema, table, column): the earliest event, and how many it stands for."""
    return log.groupBy("schema_name", "table_name", "column_name").agg(
        F.min("event_id").alias("first_event_id"), F.count(F.lit(1)).alias("occurrences"))
