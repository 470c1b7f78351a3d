"""Type text and the "extra" flag of a column."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    return c.cast("string")


def pg_type_text(udt: Column, length: Column, precision: Column, scale: Column) -> Column:
    """Readable PostgreSQL type; an element type is an underscore followed by the base name."""
    is_array = udt.startswith("_")
    base = F.substring(udt, F.lit(2), F.length(udt))
    has_digits = precision.isNotNull() & scale.isNotNull()
    digits = F.concat(F.lit("numeric("), _number(precision), F.lit(","), _number(scale), F.lit(")"))
    sized = F.concat(F.lit("("), _number(length), F.lit(")"))
    suffix = F.lit("[]")
    return (
        F.when(udt.isin("_varchar", "_bpchar") & length.isNotNull(), F.concat(base, sized, suffix))
        .when((udt == "_numeric") & has_digits, F.concat(digits, suffix))
        .when(is_array, F.concat(base, suffix))
        .when(length.isNotNull(), F.concat(F.when(udt == "bpchar", F.lit("char")).otherwise(udt), sized))
        .when((udt == "numeric") & has_digits, digits)
        .otherwise(udt)
    )


def pg_extra(identity: Column, generated: Column, default: Column) -> Column:
    """Identity beats a sequence default, which beats a stored generated column."""
    return (
        F.when(identity.isin("a", "d") | F.coalesce(default.contains("nextval("), F.lit(False)),
               F.lit("auto_increment"))
        .when(generated == "s", F.lit("STORED GENERATED"))
    )


def mysql_extra(extra: Column, generation: Column) -> Column:
    """Extra and generation expression with one blank between; an empty expression counts as none."""
    expression = F.nullif(generation, F.lit(""))
    return (
        F.when(extra.isNotNull() & expression.isNotNull(), F.concat(extra, F.lit(" "), expression))
        .otherwise(F.coalesce(extra, expression))
    )


# Spark types of the described types.
_SPARK_TYPES = {
    "bool": "boolean",
    "int2": "smallint",
    "int4": "int",
    "int8": "bigint",
    "float4": "float",
    "float8": "double",
    "text": "string",
    "varchar": "string",
    "char": "string",
    "bpchar": "string",
    "uuid": "string",
    "jsonb": "string",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
}


class TypeText(NamedTuple):
    """A described type: its name, the numbers in brackets, and how many arrays are around it."""

    name: str
    first: int | None = None   # length or precision
    second: int | None = None  # scale
    arrays: int = 0


def parse_type(described: str) -> TypeText:
    """`varchar(20)`, `numeric(10,2)`, `numeric(6)`, `int4[]`, `double precision` and the like."""
    match = re.fullmatch(r"(\w+(?: \w+)*)(?:\((\d+)(?:, ?(\d+))?\))?((?:\[\])*)", described.strip())
    if match is None:
        raise ValueError(f"not a type text: {described!r}")
    name, first, second, arrays = match.groups()
    return TypeText(name, first and int(first), second and int(second), len(arrays) // 2)


def spark_type(described: str) -> str:
    """Spark DDL type for a described type such as `varchar(20)`, `numeric(10,2)` or `int4[]`."""
    name, first, second, arrays = parse_type(described)
    if name == "numeric":
        precision, scale = first or 38, second or 0
        if precision > 38:
            raise ValueError(f"precision above 38: {described!r}")
        kind = f"decimal({precision},{scale})"
    else:
        kind = _SPARK_TYPES[name]
    return "array<" * arrays + kind + ">" * arrays
