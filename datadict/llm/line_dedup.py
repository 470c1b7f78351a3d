"""Boilerplate lines by their frequency within one site.

A line goes where the share of a host's pages that contain it exceeds a ratio. Pages of equal text
count once, on both sides of the division: copies of a page do not make its text boilerplate.

Defined results: blank lines are never counted or dropped; a null text stays null and counts as no
page; a null host is a host of its own; repeated rows are cleaned one by one; a text that loses all
its lines becomes empty, and its row stays; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datadict.llm.registry import free_name
from datadict.storage import store

RATIO = 0.1
MIN_PAGES = 3
BLANK = r"^[\x20\x09-\x0D]*$"


def _line_key(line: Column) -> Column:
    """Equal for lines that differ in outer blanks only; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host with such lines: `line_host` and `drop`, the hashes of its boilerplate lines.

    A page of L lines can hold at most L lines that are boilerplate, so `drop` has at most (mean
    lines of a page) / ratio members, however many pages the host has.
    """
    page = pages.where(F.col(text).isNotNull()).select(
        F.col(host).cast("string").alias("line_host"), F.xxhash64(F.col(text)).alias("page"),
        F.array_distinct(F.array_compact(F.transform(F.split(F.col(text), "\n"), _line_key))).alias("lines"))
    # Distinct before counting: partial results shrink copies and common lines before the shuffle.
    totals = page.select("line_host", "page").distinct().groupBy("line_host").agg(F.count(F.lit(1)).alias("pages"))
    with_line = page.select("line_host", "page", F.explode("lines").alias("line")).distinct()
    counts = with_line.groupBy("line_host", "line").agg(F.count(F.lit(1)).alias("with_line")).where(
        F.col("with_line") >= min_pages)
    totals = totals.withColumnRenamed("line_host", "total_host")
    return (
        counts.join(totals, F.col("line_host").eqNullSafe(F.col("total_host")))
        .where(F.col("with_line") > F.lit(ratio) * F.col("pages"))
        .groupBy("line_host").agg(F.sort_array(F.collect_list("line")).alias("drop")))


def line_dedup(documents: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
               min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """`documents` with boilerplate lines taken out of `text`; an `n_chars` column follows the text.

    `counts` names two more columns: lines before, and lines dropped. The hosts' lists are written
    first, so their size is known when the join with the texts is planned: Spark broadcasts them
    below its own limit, and shuffles (with splits of hot hosts) above it.
    """
    drops = store(boilerplate(documents, host, text, ratio, min_pages), "boilerplate")
    lines, kept = free_name(documents, "lines"), free_name(documents, "kept_lines")
    df = documents.join(drops, documents[host].cast("string").eqNullSafe(drops["line_host"]), "left")
    own = [documents[c] for c in documents.columns]
    df = df.select(*own, drops["drop"].alias(kept), F.split(documents[text], "\n").alias(lines))
    names = [F.col(f"`{c}`") for c in documents.columns]
    df = df.select(*names, lines, F.when(F.col(kept).isNull(), F.col(lines)).otherwise(F.filter(
        lines, lambda x: ~F.coalesce(F.array_contains(F.col(kept), _line_key(x)), F.lit(False)))).alias(kept))
    cleaned = F.when(F.col(f"`{text}`").isNotNull(), F.array_join(kept, "\n"))
    out = []
    for c in documents.columns:
        if c == text:
            out.append(cleaned.alias(c))
        elif c == "n_chars":
            out.append(F.char_length(cleaned).cast(documents.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    if counts:
        before = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(lines)).cast("long")
        after = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(kept)).cast("long")
        out += [before.alias(counts[0]), (before - after).alias(counts[1])]
    return df.select(*out)


def sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    return rf"""
with page as (
  select distinct source, text from documents where text is not null),
totals as (select source, count(*) as pages from page group by source),
lines as (
  select distinct source, text, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line
  from (select source, text, unnest(string_split(text, chr(10))) as line from page)),
counts as (select source, line, count(*) as c from lines where line <> '' group by source, line),
dropped as (
  select counts.source, list(line) as drop_lines
  from counts join totals on counts.source is not distinct from totals.source
  where c >= {min_pages} and c > {ratio} * pages group by counts.source),
kept as (
  select doc_id, d.source, text, string_split(text, chr(10)) as lines,
    list_filter(string_split(text, chr(10)), lambda x: not list_contains(coalesce(drop_lines, []),
      trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) as kept_lines
  from documents d left join dropped on d.source is not distinct from dropped.source)
select doc_id, source, case when text is not null then array_to_string(kept_lines, chr(10)) end as text,
  coalesce(len(lines), 0)::bigint as n_lines, (coalesce(len(lines), 0) - coalesce(len(kept_lines), 0))::bigint as n_dropped
from kept"""
