"""Facts read from definition texts: CREATE INDEX, FOREIGN KEY and CHECK.

Parentheses are followed by folding over the *parenthesis tokens* of a text (a handful per
definition) instead of over its characters; everything stays inside Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from datadict.functions.texts import trim_all

# Actions of a foreign key.
FK_ACTIONS = r"(NO ACTION|RESTRICT|CASCADE|SET NULL|SET DEFAULT)"
NO_ACTION = "NO ACTION"
_MARK = "\x01"


def _by_depth(text: Column, top: Callable[[Column], Column], nested: Callable[[Column], Column]) -> Column:
    """Rewrite the stretches outside parentheses with `top` and those inside with `nested`.

    The outermost parentheses themselves are kept; inner ones go through `nested`.
    """
    tokens = F.regexp_extract_all(F.concat(text, F.lit("(")), F.lit(r"([^()]*[()])"), F.lit(1))

    def step(acc: Column, token: Column) -> Column:
        size = F.length(token)
        body, paren = F.substring(token, F.lit(1), size - 1), F.substring(token, size, F.lit(1))
        after = acc["depth"] + F.when(paren == "(", 1).otherwise(-1)
        outside = acc["depth"] <= 0
        return F.struct(
            after.cast("int").alias("depth"),
            F.concat(
                acc["out"],
                F.when(outside, top(body)).otherwise(nested(body)),
                F.when(outside | (after <= 0), paren).otherwise(nested(paren)),
            ).alias("out"),
        )

    start = F.struct(F.lit(0).cast("int").alias("depth"), F.lit("").alias("out"))
    # Without the parenthesis that closed the last token.
    return F.aggregate(tokens, start, step, lambda acc: F.substring(acc["out"], F.lit(1), F.length(acc["out"]) - 1))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def _blank(c: Column) -> Column:
    return F.repeat(F.lit("."), F.length(c))


def mask_nested(text: Column) -> Column:
    """Same length, with everything inside the outermost parentheses dotted out."""
    return _by_depth(text, lambda c: c, _blank)


def split_top_level(text: Column) -> Column:
    """Parts between commas that stand outside parentheses; an empty last part is dropped."""
    marked = _by_depth(text, lambda c: F.replace(c, F.lit(","), F.lit(_MARK)), lambda c: c)

    def kept(parts: Column) -> Column:
        return F.slice(parts, F.lit(1), F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))

    return _let(F.when(text.contains("("), F.split(marked, _MARK)).otherwise(F.split(text, ",")), kept)


def _key_part(part: Column) -> Column:
    """A column without its sort words; an expression as it stands."""
    return F.when(part.contains("("), trim_all(part)).otherwise(F.regexp_extract(part, r"(?U)^\s*(\S*)", 1))


def index_block(indexdef: Column) -> Column:
    """The text from the opening parenthesis of the key list on; null if there is none."""
    before = F.length(F.regexp_extract(indexdef, r"(?is)^.*?USING", 0))
    tail = F.substring(indexdef, before + 1, F.length(indexdef))
    return F.nullif(F.regexp_extract(tail, r"(?s)^[^(]*(\(.*)$", 1), F.lit(""))


def _block_end(block: Column) -> Column:
    """Place of the parenthesis that closes the key list; 0 if none does."""
    flat = block.rlike(r"^\([^()]*\)")
    return F.coalesce(F.when(flat, F.instr(block, ")")).otherwise(F.instr(mask_nested(block), ")")), F.lit(0))


def _predicate_start(tail: Column) -> Column:
    """Length of the text up to and with `WHERE `; 0 if the tail has none outside parentheses."""
    direct = F.length(F.regexp_extract(tail, r"(?i)^(?U:\s*)WHERE ", 0))
    later = F.length(F.regexp_extract(mask_nested(tail), r"(?is)^.*?(?<!\S)WHERE ", 0))
    return F.when(~tail.rlike("(?i)WHERE "), 0).when(direct > 0, direct).otherwise(later)


def with_index_parts(df, indexdef: str = "indexdef"):
    """Add `is_unique`, `index_columns` and `predicate` read from a CREATE INDEX text.

    Done in steps of named columns, so that each is evaluated once per row; the folds run only on
    texts with nested parentheses.
    """
    c = F.col
    return (
        df.withColumn("_block", index_block(c(indexdef)))
        .withColumn("_close", _block_end(c("_block")))
        .withColumn("_tail", F.substring(c("_block"), c("_close") + 1, F.length("_block")))
        .withColumn("_where", F.when(c("_close") > 0, _predicate_start(c("_tail"))))
        .select(
            *[c(f"`{n}`") for n in df.columns],
            F.coalesce(c(indexdef).rlike(r"^(?i)CREATE UNIQUE INDEX"), F.lit(False)).alias("is_unique"),
            F.when(c("_close") > 0, F.array_join(F.transform(
                split_top_level(F.substring("_block", F.lit(2), c("_close") - 2)), _key_part), ", "))
            .otherwise(F.lit("")).alias("index_columns"),
            F.when(c("_where") > 0, F.nullif(
                trim_all(F.substring("_tail", c("_where") + 1, F.length("_tail"))), F.lit("")))
            .alias("predicate"),
        )
    )


def fk_action(condef: Column, event: str) -> Column:
    """Action of `ON DELETE` / `ON UPDATE`, whatever the order of the two clauses."""
    found = F.upper(F.regexp_extract(condef, rf"(?i)ON {event} {FK_ACTIONS}", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(NO_ACTION))


def check_body(condef: Column) -> Column:
    """`(a > 0)` from `CHECK ((a > 0))`; other text as it stands."""
    rest = F.regexp_extract(condef, r"(?is)CHECK \((.*)$", 1)
    body = F.regexp_replace(rest, r"\)\z", "")
    return F.when(condef.rlike(r"(?i)CHECK \("), body).otherwise(condef)
