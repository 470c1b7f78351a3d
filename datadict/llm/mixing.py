"""Mixing sources to target weights by Poisson replication.

A source of n documents that shall give m rows has the mean repetition rate m / n. Each document
draws its own count from the Poisson distribution of that mean, by inverting its cumulative
distribution at a number hashed from the seed and the document's id. Nothing is coordinated between
documents, so sources of any size need no split. Copies are spread by a second hash.

Defined results: a null id draws by the hash of its text; rows of equal id draw the same count; a null
source is a source of its own; sources missing from given weights get none; an empty table gives
an empty one; other texts are never looked at; columns named as the new ones keep their values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datadict.llm.registry import free_name
from datadict.storage import store

SEED = "mix"


def _hashed(parts: list[Column], digits: int) -> Column:
    """The first hexadecimal digits of an MD5 as a number."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def rates(documents: DataFrame, source: str, weights: dict[str, float] | None, size: float) -> DataFrame:
    """`mix_source`, `rate`: mean copies of a document. Weights are equal where none are given.

    `size` is the expected number of rows, as a multiple of the input's.
    """
    counts = store(documents.groupBy(F.col(source).cast("string").alias("mix_source")).agg(
        F.count(F.lit(1)).alias("n")), "source_counts")
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    totals = counts.agg(F.sum("n").alias("n"), F.sum(weight).alias("weight")).first()
    rows, whole = (totals["n"] or 0) * size, totals["weight"] or 1.0
    return counts.select("mix_source", (F.lit(float(rows)) * (weight / F.lit(float(whole))) / F.col("n")).alias("rate"))


# Copies that one row is exploded into at once.
COPIES = 4096


def _log_factorial(k: Column) -> Column:
    """Stirling's series, for the numbers from which the probabilities of large means are taken."""
    return (k * F.ln(k) - k + F.ln(2 * F.lit(math.pi) * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k)
            + 1 / (1260 * F.pow(k, F.lit(5))))


def cumulative(rates_: DataFrame) -> DataFrame:
    """`mix_source`, `first`, `steps`: the cumulative Poisson probabilities of `first`, `first` + 1, ... copies.

    The list spans twelve deviations around the mean, outside of which less than 1e-16 is left, beyond what
    a drawn number can tell apart; so it grows with the root of the mean. A draw above its end gets the
    count after the last.
    """
    span = 12 * F.sqrt("rate") + 20
    first = F.greatest(F.floor(F.col("rate") - span), F.lit(0)).cast("bigint")
    last = F.ceil(F.col("rate") + span).cast("bigint")
    steps = rates_.where(F.col("rate") > 0).withColumn("first", first).withColumn("k", F.explode(F.sequence("first", last)))
    upto = Window.partitionBy("mix_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    more = F.when(F.col("k") > F.greatest("first", F.lit(1)), F.ln(F.col("k").cast("double"))).otherwise(0.0)
    start = F.when(F.col("first") > 0, _log_factorial(F.col("first").cast("double"))).otherwise(0.0)
    steps = steps.withColumn("log_factorial", start + F.sum(more).over(upto))
    mass = F.exp(-F.col("rate") + F.col("k") * F.ln("rate") - F.col("log_factorial"))
    steps = steps.withColumn("p", F.sum(mass).over(upto))
    return steps.groupBy("mix_source", "first").agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("steps")).select(
        "mix_source", "first", F.transform("steps", lambda s: s["p"]).alias("steps"))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: str = SEED,
        doc_id: str = "doc_id", source: str = "source", copy: str = "copy", key: str = "mix_key",
        text: str = "text") -> DataFrame:
    """`documents`, each as often as it drew, with its `copy` number and its random `key`.

    Where the input has a column of such a name, the new one gets an underscore before it. Rows are
    dealt to partitions by the key and sorted by it, which is one shuffle of the texts. The table of
    steps is written first: Spark broadcasts it where its known size allows.
    """
    table = store(cumulative(rates(documents, source, weights, size)), "poisson_steps")
    copy, key = free_name(documents, copy), free_name(documents, key)
    drawn, steps, first, block, of, name = (free_name(documents, n) for n in (
        "drawn", "steps", "first", "block", "mix_source", "drawn_name"))
    table = table.withColumnsRenamed({"steps": steps, "first": first, "mix_source": of})
    own = [F.col(f"`{c}`") for c in documents.columns]
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))) \
        if text in documents.columns else F.lit("null")
    df = documents.withColumn(name, F.coalesce(F.col(f"`{doc_id}`").cast("string"), unnamed))
    u = _hashed([F.lit(seed), F.col(name)], 13) / F.lit(float(1 << 52))
    df = df.join(table, F.col(f"`{source}`").cast("string").eqNullSafe(F.col(of))).withColumn(drawn, u)
    df = df.withColumn(drawn, F.col(first) + F.size(F.filter(F.col(steps), lambda p: p <= F.col(drawn))))
    # Two explosions, so that no row holds an array of all its copies.
    df = df.where(F.col(drawn) > 0).select(*own, name, drawn, F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(drawn) - 1) / COPIES))).alias(block))
    numbers = F.sequence(F.col(block) * COPIES + 1, F.least(F.col(drawn), (F.col(block) + 1) * COPIES))
    df = df.select(*own, name, F.explode(numbers.cast("array<int>")).alias(copy))
    df = df.withColumn(key, _hashed([F.lit(f"{seed}-order"), F.col(name), F.col(copy)], 15)).drop(name)
    return df.repartition(F.col(key)).sortWithinPartitions(key, F.col(f"`{doc_id}`"), copy)


def sql(seed: str = SEED) -> str:
    return rf"""
with counts as (select source, count(*) as n from documents group by source),
rates as (select source, (select count(*) from documents) * 1.0::double * (1.0::double / (select count(*) from counts)) / n as rate from counts),
steps as (
  select source, rate, k, sum(ln(greatest(k, 1)::double)) over (partition by source order by k) as log_factorial
  from (select source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 20)::int)) as k from rates)),
probabilities as (
  select source, k, sum(exp(-rate + k * ln(rate) - log_factorial)) over (partition by source order by k) as p from steps),
listed as (select source, list(p order by k) as p from probabilities group by source),
drawn as (
  select d.*, len(list_filter(p, lambda x: x <= ('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, ''))))), 1, 13))::bigint / (1::bigint << 52)::double)) as c
  from documents d join listed on d.source is not distinct from listed.source)
select doc_id, text, lang, source, n_chars, copy::int as copy,
  ('0x' || substr(md5(concat_ws('|', '{seed}-order', coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, ''))), copy::varchar)), 1, 15))::bigint as mix_key
from (select *, unnest(generate_series(1, c)) as copy from drawn where c > 0)"""
