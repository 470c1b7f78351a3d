"""Contract audit: test declared properties against the rows.

Contracts are a short list made on the driver; their number does not depend on the data. Contracts
about single rows (not null, checks, generated columns, type limits) are fused into one aggregation
per table. Each key is one shuffle of *counts per key*, and each foreign key sends its distinct key
values with counts to the parent, never its rows, so a key value that fills a third of a table
travels as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datadict.functions import texts, types
from datadict.sources import lake

NOT_NULL, CHECK, GENERATED, TYPE_LIMIT = "NOT NULL", "CHECK", "GENERATED", "TYPE LIMIT"
PRIMARY_KEY, UNIQUE, PARTIAL_UNIQUE, FOREIGN_KEY = "PRIMARY KEY", "UNIQUE", "PARTIAL UNIQUE", "FOREIGN KEY"
_ROW_KINDS = (NOT_NULL, CHECK, GENERATED, TYPE_LIMIT)
_KEY_KINDS = (PRIMARY_KEY, UNIQUE, PARTIAL_UNIQUE)

SKETCH_ERROR, SKETCH_MARGIN = 0.02, 7  # one standard deviation, and how many of them a verdict takes
REPORT = ("contract", "kind", "table_name", "columns", "checked_rows", "violations")


@dataclass(frozen=True)
class Contract:
    kind: str
    table: str
    columns: tuple[str, ...]
    expression: str | None = None          # check, generated expression, predicate, or type text
    parent: str | None = None              # foreign key: parent table ...
    parent_columns: tuple[str, ...] = ()   # ... its key ...
    parent_filter: str | None = None       # ... and the rows of it that count
    name: str = ""

    @property
    def label(self) -> str:
        return self.name or f"{self.table}({', '.join(self.columns)}) {self.kind}"


def _null_any(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


# Types of limited length, and bits of the whole-number types.
_SIZED = ("varchar", "char", "bpchar", "character", "character varying")
_WHOLE = {"int2": 16, "smallint": 16, "int4": 32, "int": 32, "integer": 32, "int8": 64, "bigint": 64}


def _value_violation(value: Column, kind: types.TypeText) -> Column | None:
    """True where a value does not fit; None for a type that limits nothing."""
    if kind.name in _SIZED and kind.first is not None:
        return F.char_length(value) > kind.first
    if kind.name == "numeric" and kind.first is not None:
        scale = kind.second or 0
        # It must keep within the digits left of the point after rounding to the scale.
        whole = F.lit(10 ** (kind.first - scale)).cast("decimal(38,0)")
        return F.abs(F.round(value, scale)) >= whole
    if kind.name in _WHOLE:
        beyond = F.lit(str(2 ** (_WHOLE[kind.name] - 1))).cast("decimal(38,0)")
        rounded = F.round(value, 0)
        return (rounded >= beyond) | (rounded < -beyond)
    return None


def type_violation(column: str, type_text: str) -> Column:
    """True where the value, or a value inside the array, does not fit the described type.

    Lengths, digits and ranges of whole numbers are limits; other types hold every value. Null fits.
    The column has the type's Spark type or a wider one.
    """
    kind = types.parse_type(type_text)
    if _value_violation(F.lit(None), kind) is None:
        return F.lit(False)

    def broken(value: Column, arrays: int) -> Column:
        hit = F.exists(value, lambda v: broken(v, arrays - 1)) if arrays else _value_violation(value, kind)
        return F.coalesce(hit, F.lit(False))

    return broken(F.col(column), kind.arrays)


def row_violation(c: Contract) -> Column:
    """True on the rows that break a single-row contract."""
    if c.kind == NOT_NULL:
        return F.col(c.columns[0]).isNull()
    if c.kind == CHECK:
        return F.coalesce(~F.expr(c.expression), F.lit(False))  # violated only when false
    if c.kind == GENERATED:
        return ~F.col(c.columns[0]).eqNullSafe(F.expr(c.expression))
    if c.kind == TYPE_LIMIT:
        return type_violation(c.columns[0], c.expression)
    raise ValueError(c.kind)


def _described(c: Contract) -> list[Column]:
    return [F.lit(c.label).alias("contract"), F.lit(c.kind).alias("kind"), F.lit(c.table).alias("table_name"),
            F.lit(", ".join(c.columns)).alias("columns")]


def row_report(df: DataFrame, contracts: Sequence[Contract]) -> DataFrame:
    """All single-row contracts of one table in one pass, one result row each."""
    counts = [F.count_if(row_violation(c)).alias(f"v{i}") for i, c in enumerate(contracts)]
    totals = df.agg(F.count(F.lit(1)).alias("n"), *counts)
    rows = F.array(*[F.struct(*_described(c), F.col("n").alias("checked_rows"), F.col(f"v{i}").alias("violations"))
                     for i, c in enumerate(contracts)])
    return totals.select(F.inline(rows))


def _key_rows(df: DataFrame, c: Contract) -> DataFrame:
    rows = df.where(F.expr(c.expression)) if c.kind == PARTIAL_UNIQUE else df
    return rows.select(*c.columns)


def _hashed(df: DataFrame, c: Contract) -> list[Column]:
    """The key columns with long texts replaced by their hashes; other values are as they are."""
    return [lake.value_key(df.schema[n]).alias(n) if isinstance(df.schema[n].dataType, T.StringType) else F.col(n)
            for n in c.columns]


def key_counts(df: DataFrame, c: Contract) -> DataFrame:
    """Key values, long texts as hashes, with the number of rows that hold them."""
    return _key_rows(df, c).select(*_hashed(df, c)).groupBy(*c.columns).agg(F.count(F.lit(1)).alias("row_count"))


def _breaks_key(c: Contract) -> Column:
    null_key = _null_any(c.columns)
    repeated = ~null_key & (F.col("row_count") > 1)
    return (null_key | repeated) if c.kind == PRIMARY_KEY else repeated


def key_report(df: DataFrame, c: Contract) -> DataFrame:
    """Violations are key groups that are repeated or, for a primary key, null."""
    return key_counts(df, c).agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("checked_rows"),
        F.count_if(_breaks_key(c)).alias("violations"),
    ).select(*_described(c), "checked_rows", "violations")


def broken_keys(df: DataFrame, c: Contract) -> DataFrame:
    """Offending key values. Whole texts are looked up for the offenders alone."""
    bad = key_counts(df, c).where(_breaks_key(c))
    if not any(isinstance(df.schema[n].dataType, T.StringType) for n in c.columns):
        return bad
    bad = bad.select(*[F.col(n).alias(f"_{n}") for n in c.columns], "row_count")
    rows = _key_rows(df, c)
    met = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"_{n}")) for n, k in zip(c.columns, _hashed(df, c))])
    return rows.join(bad, met).select(*c.columns, "row_count").distinct()


def _parent_keys(parent: DataFrame, c: Contract) -> DataFrame:
    kept = parent.where(c.parent_filter) if c.parent_filter else parent
    return kept.select(*[F.col(p).alias(k) for p, k in zip(c.parent_columns, c.columns)])


def _child_keys(child: DataFrame, c: Contract) -> DataFrame:
    return child.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("row_count"))


def foreign_key_report(child: DataFrame, parent: DataFrame, c: Contract) -> DataFrame:
    """Checked rows include those exempt for a null; violations are orphan rows."""
    known = _parent_keys(parent, c).distinct().withColumn("_known", F.lit(True))
    marked = _child_keys(child, c).join(known, list(c.columns), "left")
    orphan = F.col("_known").isNull() & ~_null_any(c.columns)
    return marked.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).cast("bigint").alias("checked_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("row_count"))), F.lit(0)).cast("bigint").alias("violations"),
    ).select(*_described(c), "checked_rows", "violations")


def orphan_keys(child: DataFrame, parent: DataFrame, c: Contract) -> DataFrame:
    """Key values that no parent has, with the number of child rows."""
    complete = _child_keys(child, c).where(~_null_any(c.columns))
    return complete.join(_parent_keys(parent, c), list(c.columns), "left_anti")


def failing_rows(df: DataFrame, c: Contract, keep: Sequence[str]) -> DataFrame:
    """Identifying columns of the rows that break a single-row contract."""
    return df.where(row_violation(c)).select(*keep)


def audit(tables: Mapping[str, DataFrame], contracts: Iterable[Contract]) -> DataFrame:
    """The report over all contracts."""
    contracts = list(contracts)
    parts = []
    for table in dict.fromkeys(c.table for c in contracts):
        single = [c for c in contracts if c.table == table and c.kind in _ROW_KINDS]
        if single:
            parts.append(row_report(tables[table], single))
    for c in contracts:
        if c.kind in _KEY_KINDS:
            parts.append(key_report(tables[c.table], c))
        elif c.kind == FOREIGN_KEY:
            parts.append(foreign_key_report(tables[c.table], tables[c.parent], c))
    return reduce(lambda a, b: a.unionByName(b), parts).select(*REPORT)


def not_null_contracts(tables: Mapping[str, DataFrame]) -> list[Contract]:
    """One NOT NULL contract per column of every table."""
    return [Contract(NOT_NULL, name, (column,)) for name, df in tables.items() for column in df.columns]


# --- profiles -----------------------------------------------------------------------------------

def key_classes(tables: Mapping[str, DataFrame], declared: Mapping[tuple[str, str], str]) -> DataFrame:
    """Observed key class of every column beside the declared one.

    A column whose values are all present and all different is a key candidate. It contradicts the
    declaration if PRI or UNI is declared and the column is not one (nulls are allowed in UNI).
    """
    spark = next(iter(tables.values())).sparkSession
    profile = lake.dictionary(tables)
    said = spark.createDataFrame([(t, c, k) for (t, c), k in declared.items()],
                                 "table_name string, column_name string, declared string")
    values = F.col("row_count") - F.col("null_count")
    distinct = F.col("distinct_count") == values
    observed = F.when(distinct & (F.col("null_count") == 0) & (F.col("row_count") > 0), "KEY").otherwise("PLAIN")
    holds = F.when(F.col("declared") == "PRI", observed == "KEY").when(F.col("declared") == "UNI", distinct)
    return (
        profile.join(said, ["table_name", "column_name"], "left")
        .select("table_name", "column_name", "row_count", "distinct_count", observed.alias("observed"),
                F.coalesce("declared", F.lit("")).alias("declared"),
                F.coalesce(holds, F.lit(True)).alias("holds"))
    )


def key_candidates(tables: Mapping[str, DataFrame], rsd: float = SKETCH_ERROR) -> DataFrame:
    """Which columns have no value twice: a sketch of every column first, exact counts where it may be one.

    One scan per table counts rows, values and, by sketch, different values of all its columns; nothing
    is shuffled but the sketches. A column with clearly fewer different values than values is no key. The
    sketch errs by `rsd`, one standard deviation; a column is ruled out only beyond `SKETCH_MARGIN` of
    them, which a key meets less than once in 10^12 columns. The others are counted exactly.

    `is_unique` is about the values that are there; a key (`observed` KEY) has no null and a row.
    """
    spark = next(iter(tables.values())).sparkSession
    rows, left = [], {}
    for name, df in tables.items():
        fields = df.schema.fields
        keys = [lake.value_key(f) for f in fields]
        counted = df.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{f.name}`")) for f in fields],
                         *[F.approx_count_distinct(k, rsd) for k in keys]).first()
        total, values, sketched = counted[0], counted[1:len(fields) + 1], counted[len(fields) + 1:]
        for f, n, about in zip(fields, values, sketched):
            out = about * (1 + SKETCH_MARGIN * rsd) < n
            rows.append((name, f.name, total, total - n, out))
            if not out:
                left.setdefault(name, []).append(f.name)
    known = spark.createDataFrame(rows, "table_name string, column_name string, row_count bigint, null_count bigint, ruled_out boolean")
    exact = known.select("table_name", "column_name", F.lit(True).alias("is_unique")).limit(0)
    if left:
        slim = {name: tables[name].select(*[f"`{c}`" for c in columns]) for name, columns in left.items()}
        profile = lake.dictionary(slim)
        exact = profile.select("table_name", "column_name",
                               (F.col("distinct_count") == F.col("row_count") - F.col("null_count")).alias("is_unique"))
    told = known.join(exact, ["table_name", "column_name"], "left").withColumn(
        "is_unique", ~F.col("ruled_out") & F.coalesce("is_unique", F.lit(True)))
    key = F.col("is_unique") & (F.col("null_count") == 0) & (F.col("row_count") > 0)
    return told.select("table_name", "column_name", "row_count", "null_count", "is_unique",
                       F.when(key, "KEY").otherwise("PLAIN").alias("observed"), "ruled_out")


def sequence_report(df: DataFrame, table: str, column: str) -> DataFrame:
    """Range, distinct values and gaps of an auto-increment column."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("bigint").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    return values.agg(
        F.min("v").alias("min_value"), F.max("v").alias("max_value"),
        F.count("v").alias("distinct_count"),
        (F.max("v") - F.min("v") + 1 - F.count("v")).cast("bigint").alias("gaps"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("repeats"),
    ).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "*")


def text_bytes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Stored text bytes per column and, with an empty column name, per table."""
    parts = []
    for name, df in tables.items():
        texts_of = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        totals = df.agg(*[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("bigint").alias(c) for c in texts_of])
        whole = reduce(lambda a, b: a + b, [F.col(c) for c in texts_of])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("byte_count")) for c in texts_of],
                       F.struct(F.lit("").alias("column_name"), whole.alias("byte_count")))
        parts.append(totals.select(F.lit(name).alias("table_name"), F.inline(rows)))
    report = reduce(lambda a, b: a.unionByName(b), parts)
    return report.withColumn("size_text", texts.bytes_text(F.col("byte_count")))


def type_widths(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Longest text of each column, to choose or check a `varchar(n)`."""
    totals = df.agg(*[F.max(F.char_length(c)).cast("bigint").alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("max_length")) for c in columns])
    return totals.select(F.lit(table).alias("table_name"), F.inline(rows))
