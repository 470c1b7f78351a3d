"""Filters over catalog relations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datadict.functions import names

BASE_TABLE, VIEW = "BASE TABLE", "VIEW"
SLOW_SECONDS = 1.0


def _dialect(dialect: str | Column | None) -> Column:
    """A given dialect, a given column, or the column `dialect`."""
    if dialect is None:
        return F.col("dialect")
    return F.lit(dialect) if isinstance(dialect, str) else dialect


def user_schemas(df: DataFrame, dialect: str | Column | None = None) -> DataFrame:
    return df.where(~names.is_system_schema(F.col("schema_name"), _dialect(dialect)))


def target_schemas(df: DataFrame, targets: Sequence[str] | DataFrame | None) -> DataFrame:
    """Rows of the named schemas. No list, or an empty one, keeps all."""
    if isinstance(targets, DataFrame):
        return df.join(targets.select("schema_name"), "schema_name", "left_semi")
    return df.where(F.col("schema_name").isin(*targets)) if targets else df


def _folded(text: Column) -> Column:
    """Lower case letter by letter: the final form of sigma is the plain one, wherever it stands."""
    return F.translate(F.lower(text), "ς", "σ")


def _like(name: Column, pattern: Column | str, dialect: str | Column | None) -> Column:
    """LIKE of the server: MySQL compares without case. A null name matches nothing."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hit = F.when(_dialect(dialect) == "mysql", F.like(_folded(name), _folded(pattern))).otherwise(F.like(name, pattern))
    return F.coalesce(hit, F.lit(False))


def exclude_like(df: DataFrame, patterns: Sequence[str], dialect: str | Column | None = None) -> DataFrame:
    """Drop tables whose name matches any pattern; `%` and `_` are wildcards unless escaped, `*` is not."""
    hits = [_like(F.col("table_name"), p, dialect) for p in patterns]
    return df.where(~reduce(lambda a, b: a | b, hits)) if hits else df


# Most characters of an index gram, and the names that one task takes of a gram that many names have.
# Grams must grow with the patterns: of three characters, a thousand would stand for any number of numbered names.
GRAM = 8
GRAM_NAMES = 50_000


def exclude_by_pattern_table(df: DataFrame, patterns: DataFrame, key: Sequence[str],
                             gram_names: int = GRAM_NAMES) -> DataFrame:
    """Drop tables matching any row of `patterns(pattern)`, by equi-joins for any number of patterns.

    Names offer their grams, runs of up to `GRAM` characters, so their rows grow with their length. A
    pattern asks for the one gram of its literal text that the fewest names have; grams as long as its
    text allows are taken, so a literal of one letter is exact too; names offer only lengths that some
    pattern asks for. A gram that no name has drops its pattern. LIKE decides on the names that meet a pattern. A gram of very many names is split by the
    names' hashes, and its patterns go to each part. A pattern without literal text asks only for a
    number of characters, or a least number; those are two values for the whole table, and no join.

    All joins are merge joins: Spark does not know how many rows an explode gives, takes exploded names for
    as small as their table, and would gather them on the driver for a broadcast.
    """
    literal, wild = _asked(patterns.select("pattern").where("pattern is not null").distinct())
    name, kind = F.col("table_name"), F.col("dialect")
    folded = _folded(name)
    size = F.length(F.when(kind == "mysql", folded).otherwise(name))
    least = wild.where("open").agg(F.min("size")).scalar()
    exact = wild.where("not open").agg(F.collect_set("size")).scalar()
    kept = df.where(~F.coalesce((size >= least) | F.array_contains(exact, size), size >= least, F.array_contains(exact, size), F.lit(False)))

    lengths = literal.agg(F.collect_set(F.length("gram"))).scalar()
    # A name becomes many rows: the names of a small file are dealt to all tasks first.
    names = kept.select(*key, "table_name", "dialect").where("table_name is not null").repartition(*key, "table_name")
    grams = F.array_distinct(F.concat(*[
        F.when(F.array_contains(lengths, F.lit(n)), _grams(folded, n)).otherwise(_no_grams()) for n in range(1, GRAM + 1)]))
    offered = names.select(*key, "table_name", "dialect", F.explode(grams).alias("gram"))
    wanted = literal.select("gram").distinct().hint("merge")
    counts = offered.select("gram").join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    rarest = literal.join(counts.hint("merge"), "gram").groupBy("pattern", "offers").agg(
        F.min(F.struct("names", "gram")).alias("best"), F.count(F.lit(1)).alias("found")).where("found = offers")
    parts = F.ceil(F.col("best.names") / gram_names).cast("int")
    asked = rarest.select("pattern", F.col("best.gram").alias("gram"), parts.alias("parts"))
    # One row per gram that is asked for, so the names keep only those.
    met = offered.join(asked.select("gram", "parts").distinct().hint("merge"), "gram").withColumn(
        "part", F.pmod(F.xxhash64("table_name", *key), F.col("parts")).cast("int")).drop("parts")
    dealt = asked.select("pattern", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    matched = (met.join(dealt.hint("merge"), ["gram", "part"]).where(_like(name, F.col("pattern"), kind))
               .select(*[F.col(k).alias(f"_{k}") for k in key]).distinct())
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return kept.join(matched.hint("merge"), same, "left_anti")


_ESCAPED = "\uffff"


def _no_grams() -> Column:
    return F.array().cast("array<string>")


def _grams(text: Column, n: int) -> Column:
    """All runs of `n` characters."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, n))
    return F.when(F.length(text) >= n, runs).otherwise(_no_grams())


def _asked(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, gram, offers: the number of its grams; wildcards alone as size, open). Escaped characters are literal text."""
    marked = F.regexp_replace("pattern", r"(?s)\\(.)", _ESCAPED + "$1")
    literal = F.split(marked, f"(?<!{_ESCAPED})[%_]")
    runs = F.transform(literal, lambda r: _folded(F.replace(r, F.lit(_ESCAPED), F.lit(""))))
    places = F.regexp_replace(marked, f"{_ESCAPED}.", "")
    size = F.length(F.replace(places, F.lit("%"), F.lit("")))
    split = patterns.select("pattern", runs.alias("runs"), size.alias("size"), places.contains("%").alias("open")) \
        .withColumn("longest", F.least(F.lit(GRAM), F.array_max(F.transform("runs", F.length))))

    def of_length(n: int) -> Column:
        return F.array_distinct(F.flatten(F.transform("runs", lambda r: _grams(r, n))))

    chosen = reduce(lambda other, n: F.when(F.col("longest") == n, of_length(n)).otherwise(other), range(2, GRAM + 1), of_length(1))
    text = split.where("longest > 0").withColumn("grams", chosen)
    return (text.select("pattern", F.size("grams").alias("offers"), F.explode("grams").alias("gram")),
            split.where("longest = 0").select("size", "open"))


def by_type(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base tables, views, and the rest (of which only the header is known)."""
    kind = F.col("table_type")
    rest = kind.isNull() | ~kind.isin(BASE_TABLE, VIEW)
    return df.where(kind == BASE_TABLE), df.where(kind == VIEW), df.where(rest)


def without_primary(df: DataFrame) -> DataFrame:
    """MySQL names the index of a primary key `PRIMARY`."""
    return df.where(F.col("index_name") != "PRIMARY")


def without_primary_flag(df: DataFrame) -> DataFrame:
    return df.where(~F.col("indisprimary"))


def live_attributes(df: DataFrame) -> DataFrame:
    return df.where((F.col("attnum") > 0) & ~F.col("attisdropped"))


def table_constraints(df: DataFrame) -> DataFrame:
    """Keys, foreign keys and checks, without the checks that only repeat NOT NULL."""
    repeats_not_null = (F.col("contype") == "c") & F.col("conname").endswith("_not_null")
    return df.where(F.col("contype").isin("p", "u", "f", "c") & ~repeats_not_null)


def split_unsafe(df: DataFrame, dialect: str | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects with `reason`); the schema is checked as well as the table."""
    bad_schema = names.is_unsafe(F.col("schema_name"), _dialect(dialect))
    bad_table = names.is_unsafe(F.col("table_name"), _dialect(dialect))
    reason = F.when(bad_schema, F.lit("unsafe schema name")).when(bad_table, F.lit("unsafe table name"))
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def slow_extracts(log: DataFrame, seconds: float = SLOW_SECONDS) -> DataFrame:
    """Works on a batch or a stream."""
    return log.where(F.col("elapsed") >= seconds)
