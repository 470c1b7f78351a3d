"""Identifier rules: system schemas, unsafe names, quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemas that belong to the server.
MYSQL_SYSTEM_SCHEMAS = ("information_schema", "mysql", "sys", "performance_schema", "tmp")
PG_SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
PG_SYSTEM_PREFIXES = ("pg_temp_", "pg_toast_temp_")

# Character sequences that may not stand in an identifier.
UNSAFE_ANY = r";|/\*|\*/|\n|\r"
UNSAFE_PG = UNSAFE_ANY + r"|\x00"


def _dialect(dialect: str | Column) -> Column:
    return F.lit(dialect) if isinstance(dialect, str) else dialect


def is_system_schema(schema: Column, dialect: str | Column) -> Column:
    mysql = schema.isin(*MYSQL_SYSTEM_SCHEMAS)
    postgres = schema.isin(*PG_SYSTEM_SCHEMAS)
    for prefix in PG_SYSTEM_PREFIXES:
        postgres = postgres | schema.startswith(prefix)
    return F.when(_dialect(dialect) == "mysql", mysql).otherwise(postgres)


def is_unsafe(name: Column, dialect: str | Column) -> Column:
    """True where the name could break out of the script it is written to."""
    return F.when(_dialect(dialect) == "mysql", name.rlike(UNSAFE_ANY)).otherwise(name.rlike(UNSAFE_PG))


def quote_mark(dialect: str | Column) -> Column:
    return F.when(_dialect(dialect) == "mysql", F.lit("`")).otherwise(F.lit('"'))


def quote(name: Column, dialect: str | Column) -> Column:
    """Quoted identifier, inner quotes doubled; null where the name is unsafe."""
    mark = quote_mark(dialect)
    text = F.concat(mark, F.replace(name, mark, F.concat(mark, mark)), mark)
    return F.when(~is_unsafe(name, dialect), text)


def unquote(quoted: Column, dialect: str | Column) -> Column:
    """The identifier inside the quotes; null where the text is not quoted."""
    mark = quote_mark(dialect)
    inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    wrapped = F.startswith(quoted, mark) & F.endswith(quoted, mark) & (F.length(quoted) >= 2)
    return F.when(wrapped, F.replace(inner, F.concat(mark, mark), mark))


def quote_list(names: Column, dialect: str | Column) -> Column:
    """`"a", "b"` from an array of names; null if one of them is unsafe."""
    unsafe = F.exists(names, lambda n: is_unsafe(n, dialect))
    return F.when(~unsafe, F.array_join(F.transform(names, lambda n: quote(n, dialect)), ", "))
