"""Dumps of several servers, read to one dictionary; tolerant decoding."""

import pytest
from pyspark.sql import functions as F

from datadict import schemas
from datadict.plans import dictionary as dic
from datadict.sources import decode, dumps


def test_decode(evaluate):
    rows = [("1", 1), ("x", 0), (None, None), (" 7 ", 7), ("", 0)]
    assert evaluate([r[:1] for r in rows], "c string", decode.decoded(F.col("c"), "int")) == [r[1] for r in rows]
    assert evaluate([(None,), ("x",), ("0",)], "c string", decode.required(F.col("c"), "int", 1)) == [1, 1, 0]


def test_faults_name_field_and_value(spark):
    df = spark.createDataFrame([(1, "x", "2"), (2, "3", None), (3, "", "z")], "id int, a string, b string")
    got = {tuple(r) for r in decode.faults(df, {"a": "int", "b": "int"}, ["id"]).collect()}
    assert got == {(1, "a", "x"), (3, "a", ""), (3, "b", "z")}


def test_bad_bytes_become_replacement_characters(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok\xff\xfe!"), None), (2, None, bytearray("뷰".encode())), (3, None, None)],
                               "id int, t binary, v binary")
    got = {r["id"]: r["ddl"] for r in df.select("id", decode.ddl_text(F.col("t"), F.col("v")).alias("ddl")).collect()}
    assert got == {1: "ok��!", 2: "뷰", 3: None}


def save(spark, root, relation, rows, schema, fmt="parquet"):
    spark.createDataFrame(rows, schema).write.format(fmt).mode("overwrite").save(f"{root}/{relation}")


@pytest.fixture()
def mysql_roots(spark, tmp_path):
    roots = {}
    for source in ("m1", "m2"):
        root = roots[source] = str(tmp_path / source)
        save(spark, root, "tables", [("shop", "orders", "BASE TABLE", "InnoDB", "Dynamic", "utf8mb4_general_ci", source),
                                     ("shop", "v", "VIEW", None, None, None, None),
                                     ("shop", "tmp_x", "BASE TABLE", "InnoDB", None, None, None),
                                     ("mysql", "user", "BASE TABLE", "InnoDB", None, None, None)],
             "SCHEMA_NAME string, TABLE_NAME string, table_type string, engine string, row_format string,"
             " table_collation string, table_comment string")
        save(spark, root, "columns", [("shop", "orders", "id", "1", "int", "NO", "PRI", bytearray(b"auto_increment"), ""),
                                      ("shop", "orders", "total", "2", "int", "YES", "", bytearray(b"STORED GENERATED"), "a + b")],
             "schema_name string, table_name string, column_name string, ordinal_position string, column_type string,"
             " is_nullable string, column_key string, extra binary, generation_expression string")
        save(spark, root, "statistics", [("shop", "orders", "PRIMARY", "0", "id", 1), ("shop", "orders", "ix", "?", "b", 2),
                                         ("shop", "orders", "ix", "?", "a", 1)],
             "schema_name string, table_name string, index_name string, non_unique string, column_name string, seq_in_index int")
        save(spark, root, "key_column_usage", [("shop", "orders", "fk", "u", 1, "users", "id"), ("shop", "orders", "PRIMARY", "id", 1, None, None)],
             "schema_name string, table_name string, constraint_name string, column_name string, ordinal_position int,"
             " referenced_table_name string, referenced_column_name string")
        save(spark, root, "referential_constraints", [("shop", "fk", "CASCADE" if source == "m1" else "RESTRICT", "NO ACTION")],
             "schema_name string, constraint_name string, delete_rule string, update_rule string")
        save(spark, root, "show_create", [("shop", "v", None, bytearray(b"CREATE VIEW v AS select 1"), "utf8mb4", "utf8mb4_general_ci")],
             "schema_name string, table_name string, create_table binary, create_view binary,"
             " character_set_client string, collation_connection string")
    return roots


def test_mysql_dump(spark, mysql_roots):
    run = dumps.DumpRun("MySQL", mysql_roots, except_patterns=["TMP_%"])
    raw = {n: dumps.read_relation(spark, run, n) for n in
           ("tables", "columns", "statistics", "key_column_usage", "referential_constraints", "show_create")}
    assert raw["columns"].schema == schemas.MYSQL["columns"]
    d = dic.mysql_dictionary(dumps.mysql_relations(raw), except_patterns=run.except_patterns)
    assert {(r["source_id"], r["table_name"]) for r in d.tables.collect()} == {
        (s, t) for s in ("m1", "m2") for t in ("orders", "v")}
    assert {(r["source_id"], r["column_name"], r["column_key"], r["extra"]) for r in d.columns.collect()} == {
        (s, *c) for s in ("m1", "m2") for c in (("id", "PRI", "auto_increment"), ("total", "", "STORED GENERATED a + b"))}
    # A uniqueness flag that cannot be read counts as not unique.
    assert {(r["source_id"], r["index_name"], r["index_columns"], r["non_unique"]) for r in d.indexes.collect()} == {
        (s, "ix", "a,b", 1) for s in ("m1", "m2")}
    assert {(r["source_id"], r["reference"], r["delete_action"]) for r in d.foreign_keys.collect()} == {
        ("m1", "users.id", "CASCADE"), ("m2", "users.id", "RESTRICT")}
    assert {r["view_query"] for r in d.views.collect()} == {"CREATE VIEW v AS select 1"}


def postgres_dump(spark, root, fmt):
    def put(relation, rows, schema):
        save(spark, root, relation, rows, schema, fmt)

    put("tables", [("public", "users", "BASE TABLE"), ("public", "orders", "BASE TABLE"), ("public", "v", "VIEW"),
                   ("audit", "users", "BASE TABLE"), ("pg_catalog", "pg_class", "BASE TABLE")],
        "schema_name string, table_name string, table_type string")
    put("columns", [("public", "users", "id", 1, "nextval('s'::regclass)", "NO", "int8", None, None, None, None),
                    ("public", "users", "name", 2, None, "YES", "varchar", 20, None, None, "C"),
                    ("public", "orders", "uid", 1, None, "YES", "int8", None, None, None, None),
                    ("audit", "users", "id", 1, None, "YES", "numeric", None, 10, 2, None)],
        "schema_name string, table_name string, column_name string, ordinal_position int, column_default string,"
        " is_nullable string, udt_name string, char_max_length int, numeric_precision int, numeric_scale int,"
        " collation_name string")
    put("pg_class", [(1, "users", 10, "r", "people"), (2, "users", 20, "r", "trail"), (3, "orders", 10, "r", None),
                     (4, "v", 10, "v", None)],
        "oid long, relname string, relnamespace long, relkind string, description string")
    put("pg_namespace", [(10, "public"), (20, "audit")], "oid long, nspname string")
    put("pg_attribute", [(1, 1, "id", False, "d", "", "key"), (1, 2, "name", False, "", "", None), (1, 3, "old", True, "", "", None),
                         (2, 1, "id", False, "", "", None), (3, 1, "uid", False, "", "", None)],
        "attrelid long, attnum int, attname string, attisdropped boolean, attidentity string, attgenerated string,"
        " description string")
    put("pg_index", [(101, 1, "1", True, True, "users_pkey", "CREATE UNIQUE INDEX users_pkey ON public.users USING btree (id)"),
                     (102, 1, "2", False, False, "users_name", "CREATE INDEX users_name ON public.users USING btree (name) WHERE (id > 0)")],
        "indexrelid long, indrelid long, indkey string, indisprimary boolean, indisunique boolean, indexname string, indexdef string")
    put("pg_constraint", [(201, 1, "users_pkey", "p", "1", None, None, 101, "PRIMARY KEY (id)"),
                          (202, 3, "orders_fk", "f", "1", "1", 1, 0, "FOREIGN KEY (uid) REFERENCES users(id) ON DELETE CASCADE")],
        "oid long, conrelid long, conname string, contype string, conkey string, confkey string, confrelid long,"
        " conindid long, condef string")
    put("pg_database", [("en_US.UTF-8",)], "datcollate string")
    put("views", [("public", "v", " SELECT 1;")], "schema_name string, table_name string, view_query string")


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_postgres_dump(spark, tmp_path, fmt):
    root = str(tmp_path / "pg")
    postgres_dump(spark, root, fmt)
    run = dumps.DumpRun("postgresql", {"p1": root, "p2": root}, fmt)
    raw = {n: dumps.read_relation(spark, run, n) for n in schemas.POSTGRES if n != "schemata"}
    d = dic.postgres_dictionary(dumps.postgres_relations(raw))
    sources = ("p1", "p2")

    def rows(df, *columns):
        return {tuple(r[c] for c in ("source_id", *columns)) for r in df.collect()}

    def both(*expected):
        return {(s, *e) for s in sources for e in expected}

    assert rows(d.tables, "schema_name", "table_name", "comment", "collation") == both(
        ("public", "users", "people", "en_US.UTF-8"), ("audit", "users", "trail", "en_US.UTF-8"),
        ("public", "orders", None, "en_US.UTF-8"), ("public", "v", None, "en_US.UTF-8"))
    assert rows(d.columns, "schema_name", "table_name", "column_name", "column_type", "column_key", "extra", "comment") == both(
        ("public", "users", "id", "int8", "PRI", "auto_increment", "key"),
        ("public", "users", "name", "varchar(20)", "MUL", None, None),
        ("public", "orders", "uid", "int8", None, None, None), ("audit", "users", "id", "numeric(10,2)", None, None, None))
    assert rows(d.indexes, "index_name", "index_columns", "predicate", "non_unique") == both(("users_name", "name", "(id > 0)", 1))
    assert rows(d.foreign_keys, "table_name", "constraint_column", "reference", "delete_action", "update_action") == both(
        ("orders", "uid", "users.id", "CASCADE", "NO ACTION"))
    assert rows(d.views, "view_query", "charset") == both((" SELECT 1;", ""))


def test_partitioned_root_names_its_sources(spark, tmp_path):
    rows = [("s1", "public"), ("s2", "app")]
    spark.createDataFrame(rows, "source_id string, schema_name string").write.partitionBy("source_id").parquet(
        f"{tmp_path}/schemata")
    run = dumps.DumpRun("mysql", {"*": str(tmp_path)})
    assert {tuple(r) for r in dumps.read_relation(spark, run, "schemata").collect()} == set(rows)


def test_jdbc_partitions_are_quoted():
    assert dumps.jdbc_predicates(["a", "o'b"]) == ["schema_name = 'a'", "schema_name = 'o''b'"]


def test_jdbc_has_every_relation_of_a_dialect():
    for dialect, relations in schemas.RELATIONS.items():
        assert set(dumps.JDBC_QUERIES[dialect]) == set(relations)
        for name, text in dumps.JDBC_QUERIES[dialect].items():
            for f in relations[name].fieldNames():
                assert f == "source_id" or f in text, (name, f)


@pytest.mark.parametrize("least, most, parts", [(1, 1, 16), (10, 25, 4), (16384, 99999, 16), (5, 7, 16)])
def test_oid_ranges_cover_each_number_once(spark, least, most, parts):
    split = dumps.oid_predicates("oid", least, most, parts)
    assert len(split) == min(parts, most - least + 1)
    numbers = sorted({0, least - 1, least, least + 1, (least + most) // 2, most, most + 1, 1 << 40})
    df = spark.createDataFrame([(n,) for n in numbers], "oid long")
    hits = df.select("oid", sum(F.expr(p).cast("int") for p in split).alias("hits"))
    assert {r["oid"]: r["hits"] for r in hits.collect()} == dict.fromkeys(numbers, 1)
    inside = [p for p in split for n in range(least, min(most, least + 200) + 1) if eval(p.replace("oid", str(n)).replace("1 = 1", "True"))]
    assert len(inside) == min(most, least + 200) - least + 1


def test_jdbc_splits():
    run = dumps.JdbcRun("jdbc:postgresql://none", "PostgreSQL", "p", schema_names=("public",), parts=2)
    assert dumps.jdbc_split(run, "tables", None) == ["schema_name = 'public'"]
    assert dumps.jdbc_split(run, "views", (1, 4)) == ["schema_name = 'public'"]
    assert dumps.jdbc_split(run, "pg_attribute", (1, 4)) == ["attrelid < 3", "attrelid >= 3"]
    assert dumps.jdbc_split(run, "pg_constraint", (1, 4)) == ["conrelid < 3", "conrelid >= 3"]
    assert dumps.jdbc_split(run, "pg_database", (1, 4)) == dumps.jdbc_split(run, "schemata", (1, 4)) == []
    assert dumps.jdbc_split(dumps.JdbcRun("u", "mysql", "m"), "columns", None) == []


def test_csv_tells_null_from_empty_text(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", None), (3, " a ", ""), (4, 'q"\\"', "line\nbreak, \\N"), (5, "\\", "''")]
    df = spark.createDataFrame(rows, "id int, A string, b string")
    df.select("b", "id", "A").write.options(**dumps.CSV_OPTIONS).csv(str(tmp_path / "c"))
    got = dumps.read_csv(spark, str(tmp_path / "c"))
    assert got.columns == ["b", "id", "A"]
    assert sorted(tuple(r) for r in got.select("id", "A", "b").collect()) == [(str(i), a, b) for i, a, b in rows]


def test_json_names_in_any_case(spark, tmp_path):
    (tmp_path / "schemata").mkdir()
    (tmp_path / "schemata" / "a.json").write_text('{"SCHEMA_NAME": "x", "other": [1]}\n{"schema_name": "y"}\n{}\n')
    run = dumps.DumpRun("mysql", {"s": str(tmp_path)}, "json")
    assert sorted((tuple(r) for r in dumps.read_relation(spark, run, "schemata").collect()), key=str) == [
        ("s", "x"), ("s", "y"), ("s", None)]


def test_a_dump_builds_each_relation_once(spark, sf_dir, monkeypatch):
    from checks import dumps as dumped
    from datadict.sources.fixtures import Catalog

    kept = []
    monkeypatch.setattr(dumped, "store", lambda df, name, own=dumped.store: kept.append(name) or own(df, name))
    dump = dumped.Dump(Catalog(spark, sf_dir), "mysql")
    dump.write("tables")
    assert kept == ["mysql-tables"]
    assert set(dump.formats) == {"src2", "src3"} and all(spark.read.format(f).load(f"{dump.run.roots[s]}/tables").count()
                                                        for s, f in dump.formats.items())
