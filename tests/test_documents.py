"""Documents byte by byte, records in parts, and files on disk."""

import glob

import pytest
from pyspark.sql import functions as F

from datadict.plans import dictionary as dic
from datadict.plans import documents as doc
from datadict.sources import sinks

T = "source_id string, schema_name string, table_name string"
SCHEMAS = {
    "tables": f"{T}, dialect string, table_type string, engine string, row_format string, collation string, comment string",
    "columns": f"{T}, ordinal_position int, column_name string, column_type string, nullable string,"
               " default_value string, charset string, collation string, column_key string, extra string, comment string",
    "indexes": f"{T}, index_name string, non_unique int, index_columns string, predicate string",
    "foreign_keys": f"{T}, constraint_name string, constraint_column string, reference string,"
                    " delete_action string, update_action string",
    "views": f"{T}, view_query string, charset string, collation string",
}


def build(spark, **rows):
    return dic.Dictionary(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()})


def text(lines):
    return "".join(r["line"] + "\n" for r in doc.positions(lines).orderBy("position").collect())


ORDERS = ("e", "depot", "crates")


def crates(spark, predicate=None):
    return build(
        spark,
        tables=[(*ORDERS, "mysql", "BASE TABLE", "MyISAM", "Fixed", "latin1_bin", "what is stored")],
        columns=[(*ORDERS, 1, "shelf", "smallint", "NO", "7", None, None, "MUL", None, None),
                 (*ORDERS, 2, "label", "char(9)", "YES", None, "latin1", "latin1_bin", None, None, "as printed")],
        indexes=[(*ORDERS, "by_label", 0, "label", None), (*ORDERS, "by_shelf", 1, "shelf, label", predicate)],
        foreign_keys=[(*ORDERS, "on_shelf", "shelf", "shelves.no", "RESTRICT", "SET NULL")])


def test_base_table_markdown(spark):
    # Titles, table heads and rules of the layout. The record is this test's own.
    assert text(doc.markdown_lines(crates(spark))) == (
        "depot \n=============\n\n## Table List\n"
        "- [crates (what is stored)](#crates)\n \n"
        "## crates\n**Information**\n|Table type|Engine|Row format|Collate|Comment|\n|---|---|---|---|---|\n"
        "|BASE TABLE|MyISAM|Fixed|latin1_bin|what is stored|\n\n"
        "**Columns**\n|Name|Type|Nullable|Default|Charset|Collation|Key|Extra|Comment|\n|---|---|---|---|---|---|---|---|---|\n"
        "|shelf|smallint|NO|7|||MUL|||\n|label|char(9)|YES||latin1|latin1_bin|||as printed|\n\n"
        "**Index**\n- [Unique]by_label(label)\n- [Normal]by_shelf(shelf, label)\n\n"
        "**Constraint**\n- on_shelf FOREIGN KEY (shelf) Reference shelves.no ON DELETE RESTRICT ON UPDATE SET NULL\n\n \n")


def test_partial_index_shows_its_predicate(spark):
    assert "- [Normal]by_shelf(shelf, label) WHERE (shelf > 3)\n" in text(doc.markdown_lines(crates(spark, "(shelf > 3)")))


def view(spark, query, **kwargs):
    tables = [("e", "s", "B_view", "mysql", "VIEW", None, None, None, None),
              ("e", "s", "A_other", "mysql", "SEQUENCE", None, None, None, "c")]
    views = [("e", "s", "B_view", query, "utf8mb4", "utf8mb4_general_ci")] if query is not None else []
    return build(spark, tables=tables, views=views)


@pytest.mark.parametrize("query, fence, body", [
    ("SELECT 1", "```", "SELECT 1\n"),
    ("SELECT 1\n", "```", "SELECT 1\n"),
    ("SELECT '```'\n AS code\n\n", "````", "SELECT '```'\n AS code\n\n"),
    ("", "```", "\n"),
])
def test_view_markdown(spark, query, fence, body):
    assert text(doc.markdown_lines(view(spark, query))) == (
        "s \n=============\n\n## Table List\n"
        "- [A_other (c)](#a_other)\n - [B_view ()](#b_view)\n \n"
        "## a_other\n**Information**\n \n"
        "## b_view\n**Information**\n|Table type|Charset|Collate|\n|---|---|---|\n"
        "|VIEW|utf8mb4|utf8mb4_general_ci|\n\n**View Create SQL**\n"
        f"\n{fence}sql\n{body}{fence}\n \n")


def test_view_without_definition(spark):
    assert text(doc.markdown_lines(view(spark, None))).endswith("|VIEW||  |\n\n**View Create SQL**\n \n")


def test_schema_without_tables_still_has_a_document(spark):
    schemas = spark.createDataFrame([("e", "empty")], "source_id string, schema_name string")
    assert text(doc.markdown_lines(build(spark), schemas)) == "empty \n=============\n\n## Table List\n\n"


# --- CREATE TABLE -------------------------------------------------------------------------------

DDL_SCHEMAS = {
    "tables": T,
    "columns": f"{T}, ordinal_position int, column_name string, data_type string, is_nullable string,"
               " column_default string, generated string",
    "constraints": f"{T}, conname string, contype string, local_columns array<string>, ref_schema string,"
                   " ref_table string, ref_columns array<string>, delete_action string, update_action string, condef string",
    "indexes": f"{T}, indexrelid long, indexdef string",
}
USERS = ("e", "public", "users")


def ddl(spark, **rows):
    inputs = doc.DdlInputs(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in DDL_SCHEMAS.items()})
    return doc.create_table_lines(inputs)


def test_create_table(spark):
    lines, failed = ddl(
        spark, tables=[USERS],
        columns=[(*USERS, 1, "id", "int8", "NO", "nextval('s')", None), (*USERS, 2, "we\"ird", "text", "YES", None, None),
                 (*USERS, 3, "total", "numeric(10,2)", "YES", "0", "a + b")],
        constraints=[(*USERS, "ck", "c", [], None, None, [], None, None, "CHECK ((age > 0))"),
                     (*USERS, "fk", "f", ["a", "b"], "public", "orgs", ["x", "y"], "CASCADE", "NO ACTION", ""),
                     (*USERS, "uq", "u", ["b"], None, None, [], None, None, ""),
                     (*USERS, "pk", "p", ["id"], None, None, [], None, None, "")],
        indexes=[(*USERS, 9, "CREATE INDEX z ON users (b)"), (*USERS, 10, "CREATE INDEX a ON users (a)"), (*USERS, 11, "")])
    assert text(lines) == (
        'CREATE TABLE "public"."users" (\n'
        '    "id" int8 NOT NULL DEFAULT nextval(\'s\'),\n'
        '    "we""ird" text,\n'
        '    "total" numeric(10,2) GENERATED ALWAYS AS (a + b) STORED,\n'
        '    CONSTRAINT "pk" PRIMARY KEY ("id"),\n'
        '    CONSTRAINT "uq" UNIQUE ("b"),\n'
        '    CONSTRAINT "fk" FOREIGN KEY ("a", "b") REFERENCES "public"."orgs" ("x", "y")'
        ' ON DELETE CASCADE ON UPDATE NO ACTION,\n'
        '    CONSTRAINT "ck" CHECK ((age > 0))\n'
        ');\n'
        'CREATE INDEX z ON users (b);\n'
        'CREATE INDEX a ON users (a);\n')
    assert failed.count() == 0


def test_table_without_entries(spark):
    assert text(ddl(spark, tables=[USERS])[0]) == 'CREATE TABLE "public"."users" (\n\n);\n'


def test_unsafe_name_fails_one_table(spark):
    other = ("e", "public", "other")
    lines, failed = ddl(spark, tables=[USERS, other],
                        columns=[(*USERS, 1, "a;b", "text", "YES", None, None), (*other, 1, "a", "text", "YES", None, None)])
    assert text(lines) == 'CREATE TABLE "public"."other" (\n    "a" text\n);\n'
    assert [r["table_name"] for r in failed.collect()] == ["users"]


def test_missing_inputs_keep_the_table(spark):
    """A null type or a null CHECK text is empty text; only an unsafe name fails a table."""
    lines, failed = ddl(spark, tables=[USERS], columns=[(*USERS, 1, "id", None, "YES", None, None)],
                        constraints=[(*USERS, "ck", "c", None, None, None, None, None, None, None)])
    assert failed.count() == 0
    assert text(lines) == 'CREATE TABLE "public"."users" (\n    "id" ,\n    CONSTRAINT "ck" CHECK ()\n);\n'


def test_reason_of_a_failed_table(spark):
    bad = ("e", "public", "a;b")
    _, failed = ddl(spark, tables=[USERS, bad], columns=[(*USERS, 1, "x/*", "int4", "YES", None, None)])
    assert {(r["table_name"], r["reason"]) for r in failed.collect()} == {("users", doc.IN_ENTRY), ("a;b", doc.IN_TABLE)}


def test_script(spark):
    tables = spark.createDataFrame(
        [("e", "s", "a", "mysql", "BASE TABLE"), ("e", "s", "b;", "mysql", "BASE TABLE"), ("e", "s", "c", "mysql", "VIEW"),
         ("p", "s", "d", "postgres", "BASE TABLE"), ("p", "s", "f", "postgres", "BASE TABLE"), ("e", "s*/", "x", "mysql", "VIEW")],
        f"{T}, dialect string, table_type string")
    dumped = spark.createDataFrame([("e", "s", "a", "CREATE TABLE `a` (\n id int\n) ;; \n")], f"{T}, ddl_text string")
    made, _ = ddl(spark, tables=[("p", "s", "d")], columns=[("p", "s", "d", 1, "k", "int4", "NO", None, None)])
    failed = spark.createDataFrame([("p", "s", "f")], T)
    lines, rejected = doc.script_lines(tables, made, failed, dumped)
    assert text(lines.where("source_id = 'e'")) == (
        "/* Database : s */\n/* Table : a */\nCREATE TABLE `a` (\n id int\n);\n\n\n/* Table : c */\n;\n\n\n")
    assert text(lines.where("source_id = 'p'")) == (
        '/* Database : s */\n/* Table : d */\nCREATE TABLE "s"."d" (\n    "k" int4 NOT NULL\n);\n\n\n'
        "/* Table : f */\n;\n\n\n")
    assert {r["table_name"] for r in rejected.collect()} == {"b;", "x"}


# --- records, sizes, heights --------------------------------------------------------------------

def wide(spark, n_columns, n_indexes):
    return build(
        spark, tables=[(*ORDERS, "mysql", "BASE TABLE", None, None, None, None), ("e", "depot", "bare", "mysql", "VIEW", None, None, None, None)],
        columns=[(*ORDERS, i, f"c{i}", "int", "NO", None, None, None, None, None, None) for i in range(1, n_columns + 1)],
        indexes=[(*ORDERS, f"i{i}", 1, f"c{i}", None) for i in range(n_indexes)])


def test_records_are_whole(spark):
    got = {r["table_name"]: r for r in dic.records(wide(spark, 5, 2)).collect()}
    assert [c["column_name"] for c in got["crates"]["columns"]] == [f"c{i}" for i in range(1, 6)]
    assert len(got["crates"]["indexes"]) == 2 and got["crates"]["foreign_keys"] is None
    assert got["bare"]["columns"] is None and got["bare"]["view"] is None


def test_large_record_is_one_row(spark):
    (row,) = [r for r in dic.records(wide(spark, 9001, 33)).collect() if r["table_name"] == "crates"]
    assert [c["column_name"] for c in row["columns"]] == [f"c{i}" for i in range(1, 9002)]
    assert [i["index_name"] for i in row["indexes"]] == sorted(f"i{i}" for i in range(33))


def test_sheet_rows(spark):
    got = {r["table_name"]: (r["start_row"], r["height"]) for r in doc.sheet_starts(wide(spark, 3, 2)).collect()}
    assert got == {"bare": (0, 4 + 2 + 5), "crates": (11, 4 + (1 + 3) + (2 + 2) + 5)}
    full = doc.sheet_starts(crates(spark)).first()
    assert full["height"] == 4 + (2 + 1) + (2 + 2) + (1 + 2) + 5


def test_size_counts_the_predicate(spark):
    plain, partial = [dic.table_sizes(crates(spark, p)).first()["size_bytes"] for p in (None, "(id > 0)")]
    assert partial - plain == len("(id > 0)")


# --- files --------------------------------------------------------------------------------------

def test_document_files_in_name_order_are_the_document(spark, tmp_path):
    tables = [("e", s, f"t{i:05d}", "mysql", "SEQUENCE", None, None, None, f"{i}") for s, n in (("hot", 3000), ("small", 2))
              for i in range(n)]
    lines = doc.markdown_lines(build(spark, tables=tables))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_documents(lines, str(tmp_path / "md"))
        sinks.write_documents(lines, str(tmp_path / "md"))  # overwritten, not appended
        for schema in ("hot", "small"):
            files = sorted(glob.glob(f"{tmp_path}/md/source_id=e/schema_name={schema}/part-*"))
            assert len(files) > 2 if schema == "hot" else files
            written = "".join(open(f, encoding="utf-8").read() for f in files)
            assert written == text(lines.where(F.col("schema_name") == schema))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def written_plan(spark):
    """Physical plan of the last write."""
    executions = spark._jsparkSession.sharedState().statusStore().executionsList()
    return executions.apply(executions.size() - 1).physicalPlanDescription()


@pytest.mark.parametrize("source", [F.lit, lambda s: F.concat(F.lit(s), F.substring("table_name", 1, 0))])
def test_one_constant_source_keeps_its_order(spark, tmp_path, source):
    tables = spark.range(5000).selectExpr(
        "'s' as schema_name", "concat('t', lpad(id * 7919 % 5000, 5, '0')) as table_name", "'mysql' as dialect",
        "'SEQUENCE' as table_type", "cast(null as string) as engine", "cast(null as string) as row_format",
        "cast(null as string) as collation", "cast(null as string) as comment").repartition(7)
    empty = build(spark)
    d = dic.Dictionary(tables=tables.withColumn("source_id", source("e")), columns=empty.columns, indexes=empty.indexes,
                       foreign_keys=empty.foreign_keys, views=empty.views)
    lines = doc.markdown_lines(d)
    sinks.write_documents(lines, str(tmp_path / "md"))
    sorts = [part for part in written_plan(spark).split("\n\n") if "Sort [" in part]
    assert all("item_name" in part for part in sorts) and sorts
    files = sorted(glob.glob(f"{tmp_path}/md/source_id=e/schema_name=s/part-*"))
    assert "".join(open(f, encoding="utf-8").read() for f in files) == text(lines)


def test_record_and_sheet_files(spark, tmp_path):
    d = crates(spark)
    sinks.write_records(d, str(tmp_path / "records"))
    back = spark.read.parquet(str(tmp_path / "records")).first()
    assert back["columns"][0]["column_name"] == "shelf" and back["source_id"] == "e"
    sinks.write_sheets(d, str(tmp_path / "sheets"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheets/foreign_keys")).first()["reference"] == "shelves.no"


def test_same_lines_under_any_number_of_partitions(spark, sf_dir):
    import __spark_entry__ as contract

    seen = []
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = contract.queries()["doc_2_markdown"](spark, sf_dir).collect()
        seen.append(sorted(map(tuple, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1] and seen[0]


def test_file_order_of_a_large_document(spark, tmp_path):
    """A document over many files and one that shares them come back in order; blank lines count."""
    n = 20000
    rows = spark.range(n).selectExpr(
        "if(id % 3 = 0, 'a', 'b') as source_id", "'7' as schema_name", "3 as section", "concat('t', id % 100) as table_name",
        "1 as block", "id as item", "'' as item_name", "0 as line_no", "if(id % 5 = 0, '', concat('line ', id)) as line").repartition(7)
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_documents(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "out" / "source_id=b").rglob("part-*"))) > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # files are read in several blocks
    try:
        got = sinks.read_documents(spark, path)
        want = doc.positions(rows)
        assert got.count() == n and got.exceptAll(want).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_script_bytes_equal_the_scripts(spark):
    t = ("s", "a", "t")
    made = spark.createDataFrame([(*t, "CREATE é ("), (*t, ""), (*t, ");"), ("s", "a", "u", "")],
                                 "source_id string, schema_name string, table_name string, line string")
    whole = spark.createDataFrame([("s", "a", "v", "x\ny"), ("s", "a", "w", None)],
                                  "source_id string, schema_name string, table_name string, ddl_text string")
    got = {r["table_name"]: r["ddl_bytes"] for r in dic.ddl_sizes(made, whole).collect()}
    assert got == {"t": len("CREATE é (\n\n);".encode()), "u": 0, "v": 3, "w": 0}


def test_read_documents_sorts_no_line(spark, tmp_path):
    """A line's position comes from the sizes of the blocks before its own."""
    want = [("s", f"d{i % 2}", 0, "", 0, i, "", 0, f"line {i}") for i in range(300)]
    df = spark.createDataFrame(want, "source_id string, schema_name string, section int, table_name string, block int, item bigint,"
                                     " item_name string, line_no int, line string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_documents(df, f"{tmp_path}/docs")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    read = sinks.read_documents(spark, f"{tmp_path}/docs")
    assert "rangepartitioning" not in read._jdf.queryExecution().executedPlan().toString() and "Sort" not in \
        read._jdf.queryExecution().executedPlan().toString()
    got = {(r["schema_name"], r["position"]): r["line"] for r in read.collect()}
    assert got == {(f"d{i % 2}", i // 2 + 1): f"line {i}" for i in range(300)}


def test_markdown_builds_children_once(spark, monkeypatch):
    """Their rows and the titles of their tables are read from one build."""
    kept = []
    monkeypatch.setattr(doc, "store", lambda df, name, own=doc.store: kept.append(name) or own(df, name))
    from checks.catalog import fleet
    from datadict.sources.fixtures import Catalog

    made = doc.markdown_lines(fleet(Catalog(spark, "/root/testdata/sf0.001")))
    assert sorted(kept) == ["foreign-keys", "indexes"]
    assert "foreign-keys-" in "".join(made.inputFiles()) and "indexes-" in "".join(made.inputFiles())


def test_entries_are_built_once(spark):
    """The parts of a script read stored entries and marked tables: they neither join the inputs nor aggregate them again."""
    lines, failed = ddl(spark, tables=[USERS, ("e", "public", "other")],
                        columns=[(*USERS, 1, "a;b", "text", "YES", None, None),
                                 ("e", "public", "other", 1, "a", "text", "YES", None, None)])
    for part in (lines, failed):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan
    assert "Join" not in failed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["line"] for r in lines.collect()) == sorted(['CREATE TABLE "public"."other" (', '    "a" text', ");"])
    assert [(r["table_name"], r["reason"]) for r in failed.collect()] == [("users", doc.IN_ENTRY)]


def test_positions_build_each_line_once(spark):
    """Range bounds are sampled from stored lines, so what makes a line runs once."""
    made = spark.sparkContext.accumulator(0)

    def count(line):
        made.add(1)
        return line

    rows = [("e", "s", doc.TABLES, f"t{i % 7}", 1, i, "", 0, f"line {i}") for i in range(500)]
    lines = spark.createDataFrame(rows, "source_id string, schema_name string, section int, table_name string, block int,"
                                        " item bigint, item_name string, line_no int, line string").repartition(3)
    placed = doc.positions(lines.withColumn("line", F.udf(count, "string").asNondeterministic()("line")))
    want = [r[8] for r in sorted(rows, key=lambda r: (r[3], r[5]))]
    assert [r["line"] for r in placed.orderBy("position").collect()] == want
    assert made.value == len(rows)
