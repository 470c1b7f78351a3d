"""Tolerant decoding: a value that cannot be read becomes a default and leaves a fault record."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an unreadable field becomes, by Spark type.
DEFAULTS = {"string": "", "int": 0, "bigint": 0, "boolean": False}


def decoded(raw: Column, kind: str, default: Any = None) -> Column:
    """The value as `kind`; null stays null, an unreadable value becomes the default."""
    fallback = DEFAULTS[kind] if default is None else default
    return F.when(raw.isNotNull(), F.coalesce(raw.try_cast(kind), F.lit(fallback).cast(kind)))


def required(raw: Column, kind: str, default: Any = None) -> Column:
    """As `decoded`, with the default for a missing value too."""
    fallback = DEFAULTS[kind] if default is None else default
    return F.coalesce(raw.try_cast(kind), F.lit(fallback).cast(kind))


def faults(df: DataFrame, kinds: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per unreadable value: the kept columns, the field and the raw text."""
    bad = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull(),
                  F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("raw")))
           for c, k in kinds.items()]
    found = F.filter(F.array(*bad), lambda f: f.isNotNull())
    return df.select(*keep, F.explode(found).alias("fault")).select(*keep, "fault.field", "fault.raw")


def text_of(raw: Column) -> Column:
    """Bytes or text as valid text; bad byte sequences become the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def ddl_text(create_table: Column, create_view: Column) -> Column:
    """The first present of the two texts."""
    return text_of(F.coalesce(create_table, create_view))
