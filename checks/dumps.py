"""Dictionaries built through the dump readers: files of several servers and formats, with faults in them.

The fixture's relations are written to the shared folder as a server's dump has them: names and local
object numbers, which repeat from server to server, so every join needs (source_id, oid). One server of
each dialect lacks columns, numbers are unreadable here and there, and columns stand in another order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import check, sql
from datadict.plans import dictionary as dic
from datadict.sources import dumps
from datadict.sources.fixtures import Catalog
from datadict.storage import place, store

FORMATS = {"postgres": {"src0": "parquet", "src1": "json"}, "mysql": {"src2": "csv", "src3": "parquet"}}
# Columns that a server's dump does not have.
ABSENT = {("src1", "columns"): ("numeric_scale", "generation_expression"), ("src1", "pg_class"): ("relkind",),
          ("src2", "tables"): ("table_comment",), ("src2", "columns"): ("character_set_name", "column_key")}
BY_NAME = ["source_id", "schema_name", "table_name"]
LOCAL = "oid div 4 as {}"


def _unreadable(rule: str, name: str, text: str = "'n/a'") -> Column:
    """The column as text, unreadable where the rule holds."""
    return F.expr(f"case when {rule} then {text} else cast({name} as string) end")


class Dump:
    """The dump of one dialect's servers; a relation is written when it is first asked for."""

    def __init__(self, c: Catalog, dialect: str):
        self.c, self.dialect = c.stored(), dialect
        self.formats = FORMATS[dialect]
        root = place(c.spark, f"dump-{dialect}")
        self.run = dumps.DumpRun(dialect, {s: f"{root}/{s}" for s in self.formats}, formats=self.formats)
        names = [n.removeprefix(f"{dialect}_") for n in dir(self) if n.startswith(f"{dialect}_")]
        self.relations = dumps.Relations(**{n: lambda n=n: self._read(n) for n in names})

    def write(self, name: str) -> None:
        """One directory per server and relation. The relation is built once and stored, then dealt to the servers."""
        df = store(getattr(self, f"{self.dialect}_{name}")(), f"{self.dialect}-{name}")
        for source, fmt in self.formats.items():
            own = df.where(F.col("source_id") == source).drop("source_id", *ABSENT.get((source, name), ()))
            own = own.select(*reversed(own.columns))
            if fmt in ("csv", "json"):
                own = own.select(*[F.col(c).cast("string").alias(c) for c in own.columns])
            options = dumps.CSV_OPTIONS if fmt == "csv" else {}
            own.write.format(fmt).options(**options).save(f"{self.run.roots[source]}/{name}")

    def _read(self, name: str) -> DataFrame:
        self.write(name)
        return dumps.read_relation(self.c.spark, self.run, name)

    def fleet(self) -> DataFrame:
        return self.c.fleet_tables().where(F.col("dialect") == self.dialect)

    def named(self, df: DataFrame) -> DataFrame:
        return df.join(self.fleet().select("oid", *BY_NAME), "oid")

    def sourced(self, df: DataFrame) -> DataFrame:
        return df.withColumn("source_id", F.expr("concat('src', cast(oid % 4 as string))"))

    # --- PostgreSQL

    def postgres_schemata(self) -> DataFrame:
        return self.fleet().select("source_id", "schema_name").distinct()

    def postgres_tables(self) -> DataFrame:
        return self.fleet().select(*BY_NAME, "table_type")

    def postgres_columns(self) -> DataFrame:
        length = _unreadable("oid % 13 = 0", "char_max_length")
        return self.named(self.c.postgres()["columns"]).withColumn("char_max_length", length).drop("oid", "column_comment")

    def postgres_pg_class(self) -> DataFrame:
        return self.fleet().selectExpr(
            "source_id", LOCAL.format("oid"), "table_name as relname", "oid % 10 as relnamespace",
            "case table_type when 'VIEW' then 'v' else 'r' end as relkind", "table_comment as description")

    def postgres_pg_namespace(self) -> DataFrame:
        return self.c.view("cat_namespace").where(F.col("source_id").isin(*self.formats))

    def postgres_pg_attribute(self) -> DataFrame:
        return self.sourced(self.c.postgres()["attributes"]).selectExpr(
            "source_id", LOCAL.format("attrelid"), "attnum", "attname", "attisdropped", "attidentity", "attgenerated")

    def postgres_pg_index(self) -> DataFrame:
        return self.sourced(self.c.postgres()["indexes"]).selectExpr(
            "source_id", "indexrelid", LOCAL.format("indrelid"), "indkey", "indisprimary", "indisunique",
            "case when indisprimary then concat('con_', cast(oid as string)) else index_name end as indexname", "indexdef")

    def postgres_pg_constraint(self) -> DataFrame:
        return self.sourced(self.c.postgres()["constraints"]).selectExpr(
            "source_id", "oid", LOCAL.format("conrelid"), "conname", "contype", "conkey", "confkey", "confrelid", "condef")

    def postgres_pg_database(self) -> DataFrame:
        return self.fleet().selectExpr("source_id", "table_collation as datcollate").distinct()

    def postgres_views(self) -> DataFrame:
        return self.named(self.c.postgres()["views"]).select(*BY_NAME, "view_query")

    # --- MySQL

    def mysql_schemata(self) -> DataFrame:
        return self.fleet().select("source_id", "schema_name").distinct()

    def mysql_tables(self) -> DataFrame:
        return self.fleet().drop("oid", "dialect")

    def mysql_columns(self) -> DataFrame:
        # The server gives some texts as bytes.
        columns = self.named(self.c.mysql()["columns"]).withColumn("column_type", F.col("column_type").cast("binary"))
        return columns.drop("oid")

    def mysql_statistics(self) -> DataFrame:
        flag = _unreadable("oid % 11 = 0", "non_unique", "'?'")
        return self.named(self.c.mysql()["statistics"]).withColumn("non_unique", flag).drop("oid")

    def mysql_key_column_usage(self) -> DataFrame:
        return self.named(self.c.mysql()["key_column_usage"]).drop("oid")

    def mysql_referential_constraints(self) -> DataFrame:
        owners = self.mysql_key_column_usage().select("source_id", "schema_name", "constraint_name").distinct()
        return owners.join(self.c.view("cat_rc"), "constraint_name")

    def mysql_show_create(self) -> DataFrame:
        texts = self.named(self.c.mysql()["show_create"]).drop("oid")
        return texts.withColumns({n: F.col(n).cast("binary") for n in ("create_table", "create_view")})


def postgres_of(c: Catalog) -> dic.Dictionary:
    return dic.postgres_dictionary(dumps.postgres_relations(Dump(c, "postgres").relations))


def mysql_of(c: Catalog) -> dic.Dictionary:
    return dic.mysql_dictionary(dumps.mysql_relations(Dump(c, "mysql").relations))


def _register() -> None:
    dialects = {"mysql": ("src_1", mysql_of, "my"), "postgres": ("src_2", postgres_of, "pg")}
    for dialect, (key, build, short) in dialects.items():
        for part in dic.Dictionary.PARTS:
            where = ""
            if part == "tables":
                where = f" where dialect = '{dialect}'"
            elif part == "views":
                where = f" where charset {'<>' if dialect == 'mysql' else '='} ''"
            origin = f"d_{part}" if where else f"{short}_{part}"
            check(f"{key}_dump_{part}", f"{sql.dumped_dictionary()}\nselect * from {origin}{where}")(
                lambda c, build=build, part=part: getattr(build(c), part))


_register()


@check("src_5_dump_faults", sql.dumped_dictionary() + """
select source_id, 'columns' as relation, 'char_max_length' as field, 'n/a' as raw, count(*) as n
from cat_columns c join fleet_tables t on t.oid = c.oid where c.oid % 13 = 0 and dialect = 'postgres' group by 1
union all
select source_id, 'statistics', 'non_unique', '?', count(*)
from cat_statistics c join fleet_tables t on t.oid = c.oid where c.oid % 11 = 0 and dialect = 'mysql' group by 1""")
def dump_faults(c: Catalog) -> DataFrame:
    found = []
    for dialect in FORMATS:
        dump = Dump(c, dialect)
        for name in dump.relations:
            dump.write(name)
            found.append(dumps.read_faults(c.spark, dump.run, name))
    return reduce(DataFrame.unionByName, found).groupBy("source_id", "relation", "field", "raw").agg(
        F.count(F.lit(1)).alias("n"))
