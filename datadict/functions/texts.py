"""Small text rules used by the documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"(?U)^\s+|\s+$"
END_SPACE = r"(?U)\s+$"


def trim_all(c: Column) -> Column:
    """Trim every Unicode white space, not blanks only."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def terminate(ddl: Column) -> Column:
    """Right-trimmed script text that ends with exactly one semicolon."""
    return F.concat(F.regexp_replace(F.coalesce(ddl, F.lit("")), r"(?U)[;\s]*$", ""), F.lit(";"))


def longest_backtick_run(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def fence(c: Column) -> Column:
    """A code fence longer than any run of backticks in the text, three at least."""
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backtick_run(c) + 1))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def index_label(non_unique: Column) -> Column:
    return F.when(non_unique == 1, F.lit("Normal")).otherwise(F.lit("Unique"))


def body_lines(c: Column) -> Column:
    """Lines of a text as they appear in a file; a final newline does not open another line."""
    return F.split(F.regexp_replace(c, r"\n\z", ""), "\n")


KIB, MIB = 1024, 1024 * 1024


def bytes_text(n: Column) -> Column:
    """`12B`, `1.5KiB` or `2.0MiB`. Integer arithmetic, ties to even, so no double is involved."""

    def tenths(unit: int) -> Column:
        scaled = n.cast("decimal(38,0)") * 10
        whole = F.floor(scaled / unit).cast("decimal(38,0)")
        rest = scaled - whole * unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
        return (whole + F.when(up, 1).otherwise(0)).cast("bigint")

    def shown(unit: int, suffix: str) -> Column:
        t = tenths(unit)
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(suffix))

    return (
        F.when(n >= MIB, shown(MIB, "MiB")).when(n >= KIB, shown(KIB, "KiB"))
        .otherwise(F.concat(n.cast("string"), F.lit("B")))
    )
