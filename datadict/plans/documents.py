"""Documents as DataFrames of lines.

A line carries a composite sort key: section, table, block inside the table, item inside the block,
line inside the item. The key alone puts the lines of a document in order, so no window runs over a
document or a table, and a document of any size is sorted and written by many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datadict.functions import definitions, names, texts, types
from datadict.operators import filters, relations
from datadict.operators.ordered import number_rows_by_range, sum_before
from datadict.plans.dictionary import TABLE, Dictionary, locate
from datadict.storage import store

DOCUMENT = ("source_id", "schema_name")
ORDER = ("section", "table_name", "block", "item", "item_name", "line_no")
LINE = (*DOCUMENT, *ORDER, "line")

HEADER, LIST, LIST_END, TABLES = 0, 1, 2, 3  # sections


def lines(df: DataFrame, section: int, line: Column, block: int = 0, item: Column | None = None,
          item_name: Column | None = None, line_no: Column | None = None, table: bool = True) -> DataFrame:
    """One line per row."""
    return df.select(
        *DOCUMENT, F.lit(section).alias("section"),
        (F.col("table_name") if table else F.lit("")).alias("table_name"), F.lit(block).alias("block"),
        (F.lit(0) if item is None else item).cast("bigint").alias("item"),
        (F.lit("") if item_name is None else item_name).alias("item_name"),
        (F.lit(0) if line_no is None else line_no).alias("line_no"), line.alias("line"))


def block_lines(df: DataFrame, section: int, blocks: Column, table: bool = True) -> DataFrame:
    """Several lines per row from an array of (block, line_no, line)."""
    return df.select(
        *DOCUMENT, F.lit(section).alias("section"),
        (F.col("table_name") if table else F.lit("")).alias("table_name"), F.inline(blocks),
    ).select(*DOCUMENT, "section", "table_name", "block", F.lit(0).cast("bigint").alias("item"),
             F.lit("").alias("item_name"), "line_no", "line")


def _fixed(*pairs: tuple[int, Column | str]) -> Column:
    return F.array(*[_line(block, text) for block, text in pairs])


def _line(block: int, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(block).alias("block"), F.lit(0).alias("line_no"), text.alias("line"))


def _text_block(block: int, text: Column) -> Column:
    """The lines of a text, numbered."""
    return F.transform(texts.body_lines(text), lambda t, i: F.struct(
        F.lit(block).alias("block"), i.alias("line_no"), t.alias("line")))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def positions(document_lines: DataFrame) -> DataFrame:
    """Lines with their 1-based position in the document.

    Stored first: the range bounds are sampled from files, and the joins that made the lines run once.
    """
    return number_rows_by_range(store(document_lines, "lines"), DOCUMENT, ORDER, "position") \
        .select(*DOCUMENT, "position", "line")


def _row(*cells: Column | str) -> Column:
    return F.concat(F.lit("|"), *[part for c in cells for part in
                                  (texts.text_or_empty(F.col(c) if isinstance(c, str) else c), F.lit("|"))])


# --- Markdown -----------------------------------------------------------------------------------

# Blocks of a table, in the order they stand in a document.
(NAME, INFO, INFO_HEAD, INFO_RULE, INFO_ROW, INFO_END, COLUMNS, COLUMNS_HEAD, COLUMNS_RULE, COLUMN_ROW,
 COLUMNS_END, INDEXES, INDEX_ROW, INDEXES_END, FOREIGN, FOREIGN_ROW, FOREIGN_END, BODY_TITLE, BODY_GAP,
 FENCE_OPEN, BODY, FENCE_CLOSE, TABLE_END) = range(1, 24)

# Titles, table heads and rules of the Markdown document.
TITLE_RULE = "============="
BASE_HEAD = "|Table type|Engine|Row format|Collate|Comment|"
BASE_RULE = "|---|---|---|---|---|"
COLUMN_HEAD = "|Name|Type|Nullable|Default|Charset|Collation|Key|Extra|Comment|"
COLUMN_RULE = "|---|---|---|---|---|---|---|---|---|"
VIEW_HEAD = "|Table type|Charset|Collate|"
VIEW_RULE = "|---|---|---|"


def _sections_of(children: DataFrame, title: str, title_block: int, end_block: int) -> DataFrame:
    """Title and closing blank line for each table that has such children."""
    owners = children.select(*TABLE).distinct()
    return block_lines(owners, TABLES, _fixed((title_block, title), (end_block, "")))


def markdown_lines(d: Dictionary, schemas: DataFrame | None = None) -> DataFrame:
    """Lines of one Markdown dictionary per (source, schema).

    `schemas(source_id, schema_name)` adds documents of schemas without tables.
    """
    tables = d.tables
    # Read twice each, for their rows and for the tables that have any; built once.
    indexes, foreign_keys = store(d.indexes, "indexes"), store(d.foreign_keys, "foreign-keys")
    documents = tables.groupBy(*DOCUMENT).agg(F.min("table_name").alias("first_name"))
    if schemas is not None:
        documents = schemas.select(*DOCUMENT).distinct().join(documents, list(DOCUMENT), "left")

    heads = block_lines(documents, HEADER, _fixed(
        (1, F.concat("schema_name", F.lit(" "))), (2, TITLE_RULE), (3, ""), (4, "## Table List")), table=False)
    # Every entry but the first starts with the blank that its predecessor leaves behind.
    link = F.concat(F.lit("- ["), F.col("table_name"), F.lit(" ("), texts.text_or_empty(F.col("comment")),
                    F.lit(")](#"), F.lower("table_name"), F.lit(")"))
    firsts = documents.where("first_name is not null").select(
        *DOCUMENT, F.col("first_name").alias("table_name"), F.lit(True).alias("_first"))
    listed = tables.join(firsts, list(TABLE), "left")
    entries = lines(listed, LIST, F.concat(F.when(F.col("_first"), "").otherwise(" "), link))
    list_end = lines(documents, LIST_END, F.when(F.col("first_name").isNull(), "").otherwise(" "), table=False)

    blocks = tables.join(d.views.select(*TABLE, "view_query", "charset", F.col("collation").alias("view_collation")),
                         list(TABLE), "left")
    kind, has_view = F.col("table_type"), F.col("view_query").isNotNull()
    always = _fixed((NAME, F.concat(F.lit("## "), F.lower("table_name"))), (INFO, "**Information**"),
                    (TABLE_END, " "))
    of_base = _fixed(
        (INFO_HEAD, BASE_HEAD), (INFO_RULE, BASE_RULE),
        (INFO_ROW, _row("table_type", "engine", "row_format", "collation", "comment")), (INFO_END, ""),
        (COLUMNS, "**Columns**"), (COLUMNS_HEAD, COLUMN_HEAD), (COLUMNS_RULE, COLUMN_RULE), (COLUMNS_END, ""))
    of_view = _fixed(
        (INFO_HEAD, VIEW_HEAD), (INFO_RULE, VIEW_RULE),
        (INFO_ROW, F.when(has_view, _row("table_type", "charset", "view_collation"))
         .otherwise(F.concat(F.lit("|"), kind, F.lit("||  |")))),
        (INFO_END, ""), (BODY_TITLE, "**View Create SQL**"))
    mark = texts.fence(F.col("view_query"))
    of_body = F.concat(
        _fixed((BODY_GAP, ""), (FENCE_OPEN, F.concat(mark, F.lit("sql"))), (FENCE_CLOSE, mark)),
        _text_block(BODY, F.col("view_query")))
    none = F.array().cast("array<struct<block:int,line_no:int,line:string>>")
    fixed = block_lines(blocks, TABLES, F.concat(
        always,
        F.when(kind == filters.BASE_TABLE, of_base).when(kind == filters.VIEW, of_view).otherwise(none),
        F.when((kind == filters.VIEW) & has_view, of_body).otherwise(none)))

    column_rows = lines(d.columns, TABLES, _row(
        "column_name", "column_type", "nullable", "default_value", "charset", "collation", "column_key",
        "extra", "comment"), COLUMN_ROW, item=F.col("ordinal_position"))
    index_rows = lines(indexes, TABLES, F.concat(
        F.lit("- ["), texts.index_label(F.col("non_unique")), F.lit("]"), F.col("index_name"), F.lit("("),
        F.col("index_columns"), F.lit(")"),
        F.coalesce(F.concat(F.lit(" WHERE "), F.col("predicate")), F.lit(""))),
        INDEX_ROW, item_name=F.col("index_name"))
    foreign_rows = lines(foreign_keys, TABLES, F.concat(
        F.lit("- "), F.col("constraint_name"), F.lit(" FOREIGN KEY ("), F.col("constraint_column"),
        F.lit(") Reference "), F.col("reference"), F.lit(" ON DELETE "), F.col("delete_action"),
        F.lit(" ON UPDATE "), F.col("update_action")),
        FOREIGN_ROW, item_name=F.col("constraint_name"))
    return _union([
        heads, entries, list_end, fixed, column_rows,
        _sections_of(indexes, "**Index**", INDEXES, INDEXES_END), index_rows,
        _sections_of(foreign_keys, "**Constraint**", FOREIGN, FOREIGN_END),
        foreign_rows,
    ])


# --- CREATE TABLE -------------------------------------------------------------------------------

OPEN, EMPTY, ENTRY_COLUMN, ENTRY_CONSTRAINT, CLOSE, INDEX_TEXT = 10, 11, 20, 30, 90, 95
_ENTRY_KEY = ("block", "item", "item_name")


class DdlInputs(NamedTuple):
    tables: DataFrame       # TABLE
    columns: DataFrame      # TABLE, ordinal_position, column_name, data_type, is_nullable, ...
    constraints: DataFrame  # TABLE, conname, contype, local_columns, ref_*, actions, condef
    indexes: DataFrame      # TABLE, indexrelid, indexdef


def postgres_ddl_inputs(rel: Mapping[str, DataFrame], base: DataFrame, key: Sequence[str],
                        backing: Sequence[str] | None = None) -> DdlInputs:
    """What a CREATE TABLE needs, for the base tables of PostgreSQL relations."""
    extra = [c for c in key if c not in TABLE]
    # Columns of other tables drop out before the wider join.
    columns = relations.live_columns(locate(rel["columns"], base, key), rel["attributes"], key).select(
        *TABLE, "ordinal_position", "column_name",
        types.pg_type_text(F.col("udt_name"), F.col("char_max_length"), F.col("numeric_precision"),
                           F.col("numeric_scale")).alias("data_type"),
        "is_nullable", "column_default",
        F.when(F.col("attgenerated") == "s", F.col("generation_expression")).alias("generated"))
    declared = filters.table_constraints(rel["constraints"])
    constraints = locate(
        relations.with_fk_actions(relations.with_referenced_table(
            relations.with_column_names(declared, rel["attributes"], key), rel["classes"], rel["namespaces"],
            source=[c for c in key if c != "oid"])),
        base, key).drop(*extra)
    indexes = relations.without_constraint(
        filters.without_primary_flag(rel["indexes"]), rel["constraints"], ["p", "u"],
        backing or [*key, "index_name"])
    return DdlInputs(base.select(*TABLE), columns, constraints,
                     locate(indexes, base, key).select(*TABLE, "indexrelid", "indexdef"))


# The words of a CREATE TABLE script.
CREATE_OPEN, CREATE_CLOSE, INDENT = "CREATE TABLE ", ");", "    "
IN_TABLE, IN_ENTRY = "unsafe table name", "unsafe name in a column or constraint"


def _text(name: str) -> Column:
    """A text input; one that is missing is empty, as the reader's default is."""
    return texts.text_or_empty(F.col(name))


def _column_entry() -> Column:
    """Null only where the name is unsafe."""
    tail = F.when(F.col("generated").isNotNull(),
                  F.concat(F.lit(" GENERATED ALWAYS AS ("), F.col("generated"), F.lit(") STORED"))) \
        .otherwise(F.coalesce(F.concat(F.lit(" DEFAULT "), F.col("column_default")), F.lit("")))
    return F.concat(F.lit(INDENT), names.quote(_text("column_name"), "postgres"), F.lit(" "), _text("data_type"),
                    F.when(F.col("is_nullable") == "YES", "").otherwise(" NOT NULL"), tail)


def _constraint_entry() -> Column:
    """Null only where a name in it is unsafe."""
    none = F.array().cast("array<string>")
    local = names.quote_list(F.coalesce("local_columns", none), "postgres")
    target = F.concat(
        names.quote(_text("ref_schema"), "postgres"), F.lit("."), names.quote(_text("ref_table"), "postgres"), F.lit(" ("),
        names.quote_list(F.coalesce("ref_columns", none), "postgres"), F.lit(")"))
    kind = F.col("contype")
    body = (
        F.when(kind == "p", F.concat(F.lit("PRIMARY KEY ("), local, F.lit(")")))
        .when(kind == "u", F.concat(F.lit("UNIQUE ("), local, F.lit(")")))
        .when(kind == "f", F.concat(F.lit("FOREIGN KEY ("), local, F.lit(") REFERENCES "), target,
                                    F.lit(" ON DELETE "), _text("delete_action"),
                                    F.lit(" ON UPDATE "), _text("update_action")))
        .when(kind == "c", F.concat(F.lit("CHECK ("), definitions.check_body(_text("condef")), F.lit(")")))
        .otherwise("")
    )
    return F.concat(F.lit(f"{INDENT}CONSTRAINT "), names.quote(_text("conname"), "postgres"), F.lit(" "), body)


def create_table_lines(inputs: DdlInputs) -> tuple[DataFrame, DataFrame]:
    """(lines of CREATE TABLE scripts, tables that have none with the `reason`).

    One aggregation per table tells its last entry, which takes no comma, and whether an entry holds
    an unsafe name. It is joined to the tables once; entries and indexes meet the tables that are left.
    Entries and marked tables are read by several parts, each with other columns, so both are built once.
    """
    entries = lines(inputs.columns, TABLES, _column_entry(), ENTRY_COLUMN, item=F.col("ordinal_position")) \
        .unionByName(lines(inputs.constraints, TABLES, _constraint_entry(), ENTRY_CONSTRAINT,
                           item=relations.constraint_rank(F.col("contype")), item_name=_text("conname")))
    entries = store(entries, "entries")
    entry_key = F.struct(*_ENTRY_KEY)
    seen = entries.groupBy(*TABLE).agg(F.max(entry_key).alias("last"), F.bool_or(F.col("line").isNull()).alias("bad"))
    title = F.concat(F.lit(CREATE_OPEN), names.quote(F.col("schema_name"), "postgres"), F.lit("."),
                     names.quote(F.col("table_name"), "postgres"), F.lit(" ("))
    reason = F.when(title.isNull(), IN_TABLE).when(F.col("bad"), IN_ENTRY)
    marked = store(inputs.tables.join(seen, list(TABLE), "left").withColumn("reason", reason).drop("bad"), "marked")
    failed = marked.where("reason is not null").select(*TABLE, "reason")
    good = marked.where("reason is null")
    frame = block_lines(good, TABLES, _fixed((OPEN, title), (CLOSE, CREATE_CLOSE)))
    empty = lines(good.where("last is null"), TABLES, F.lit(""), EMPTY)
    separated = entries.join(good.select(*TABLE, "last"), list(TABLE)).withColumn(
        "line", F.concat("line", F.when(entry_key == F.col("last"), "").otherwise(","))).select(*LINE)
    index_texts = lines(inputs.indexes.where("indexdef <> ''").join(good.select(*TABLE), list(TABLE), "left_semi"), TABLES,
                        F.concat("indexdef", F.lit(";")), INDEX_TEXT, item=F.col("indexrelid"))
    return _union([frame, empty, separated, index_texts]).select(*LINE), failed


# --- SQL scripts --------------------------------------------------------------------------------

TABLE_NOTE, DUMPED, GAP = 1, 40, 99


def script_lines(tables: DataFrame, created: DataFrame, failed: DataFrame, dumped: DataFrame,
                 schemas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines of one SQL script per schema, rejected tables with the reason).

    `tables` has TABLE, dialect and table_type. Base tables of PostgreSQL take their text from
    `created`; `dumped(TABLE, ddl_text)` holds the texts of the others. A missing text is `;`.
    """
    accepted, rejected = filters.split_unsafe(tables)
    documents = (tables if schemas is None else schemas).select(*DOCUMENT, "dialect").distinct() \
        .where(~names.is_unsafe(F.col("schema_name"), F.col("dialect")))
    heads = lines(documents, HEADER, F.concat(F.lit("/* Database : "), F.col("schema_name"), F.lit(" */")),
                  table=False)
    notes = block_lines(accepted, TABLES, F.array(
        _line(TABLE_NOTE, F.concat(F.lit("/* Table : "), F.col("table_name"), F.lit(" */"))),
        *[F.struct(F.lit(GAP).alias("block"), F.lit(i).alias("line_no"), F.lit("").alias("line")) for i in (0, 1)]))
    rebuilt = (F.col("dialect") == "postgres") & (F.col("table_type") == filters.BASE_TABLE)
    without_text = accepted.where(rebuilt).join(failed, list(TABLE), "left_semi")
    texts_of = accepted.where(~rebuilt).join(dumped, list(TABLE), "left")
    bodies = block_lines(texts_of, TABLES, _text_block(DUMPED, texts.terminate(F.col("ddl_text"))))
    return _union([heads, notes, created, bodies, lines(without_text, TABLES, F.lit(";"), DUMPED)]), rejected


def view_script(views: DataFrame, dialect: str) -> DataFrame:
    """Script text of a view. PostgreSQL keeps only the query, so the statement is put before it."""
    if dialect == "mysql":
        return views.select(*TABLE, F.col("view_query").alias("ddl_text"))
    title = F.concat(F.lit("CREATE VIEW "), names.quote(F.col("schema_name"), "postgres"), F.lit("."),
                     names.quote(F.col("table_name"), "postgres"), F.lit(" AS\n"))
    return views.select(*TABLE, F.concat(title, "view_query").alias("ddl_text"))


# --- sheet layout -------------------------------------------------------------------------------

# Rows of a table block on a sheet, before and after its body.
ROWS_BEFORE, ROWS_AFTER, SECTION_ROWS, VIEW_ROWS = 4, 5, 2, 2


def sheet_heights(d: Dictionary) -> DataFrame:
    """Rows each table block takes on its schema's sheet, from the counts of its children."""
    counted = None
    for name in ("columns", "indexes", "foreign_keys"):
        child = getattr(d, name)
        part = child.select(*TABLE, *[F.lit(int(name == n)).alias(n) for n in ("columns", "indexes", "foreign_keys")])
        counted = part if counted is None else counted.unionByName(part)
    counts = counted.groupBy(*TABLE).agg(*[F.sum(n).alias(n) for n in ("columns", "indexes", "foreign_keys")])

    def section(n: str) -> Column:
        return F.when(F.col(n) > 0, F.col(n) + SECTION_ROWS).otherwise(0)

    body = (
        F.when(F.col("table_type") == filters.BASE_TABLE, F.col("columns") + 1 + section("indexes") + section("foreign_keys"))
        .when(F.col("table_type") == filters.VIEW, VIEW_ROWS).otherwise(0)
    )
    return (
        d.tables.select(*TABLE, "table_type").join(counts, list(TABLE), "left").fillna(0)
        .select(*TABLE, (F.lit(ROWS_BEFORE + ROWS_AFTER) + body).cast("bigint").alias("height"))
    )


def sheet_starts(d: Dictionary) -> DataFrame:
    """0-based first row of each table block: the heights of the blocks before it."""
    return sum_before(sheet_heights(d), DOCUMENT, ["table_name"], "height", "start_row")
