"""Quality rules with verdicts about whole hosts.

Every document is measured with column functions only. Failures are summed per host, each host's
failure rates are shrunk towards the corpus by a beta prior fitted to all hosts, and the hosts'
verdicts are joined back to the documents.

Defined results: a null text has no words, so it fails the word count; a null host is a host of
its own; repeated rows are measured, counted and judged one by one; an empty table gives an empty
one; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datadict.llm.registry import free_name
from datadict.storage import store

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("few_words", "repeats", "symbols", "word_length", "line_copies", "shouting")


@dataclass(frozen=True)
class Limits:
    """What a document may have, and what a host's shrunken failure rates mean.

    A document that breaks a rule goes where the rate of that rule at its host is `confirm` or more:
    where a failure is that rare, it is taken for an oddity of a sound document. A host goes as a
    whole only where a rule's rate is `reject` or more.
    """

    min_words: int = 10
    repeat_percent: int = 20
    symbols_per_100_words: int = 10
    min_word_chars: int = 2
    max_word_chars: int = 12
    dup_line_percent: int = 30
    shouts_per_100_words: int = 30
    confirm: float = 0.01
    reject: float = 0.9


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows that are found twice or more; windows are (hash, position), sorted."""
    twice = F.filter(windows, lambda x, i: (
        (x["h"] == F.get(windows, i - 1)["h"]) | (x["h"] == F.get(windows, i + 1)["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total"), p.alias("last")))
    return covered["total"]


def measured(documents: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """`documents` with a struct `name`: the base measures, lines with a word, and exclamation marks.

    Each step is a projection of its own, so that no array is computed twice.
    """
    kept = [documents[c].alias(f"d{i}") for i, c in enumerate(documents.columns)]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = documents.select(*kept, body.alias("body"))
    kept = [f"d{i}" for i in range(len(kept))]
    df = df.select(
        *kept, "body", F.array_remove(F.split("body", f"{SPACE}+"), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"))
    df = df.select(
        *kept, "words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.octet_length("body") - F.octet_length(F.replace("body", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    counts = ["word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines"]
    df = df.select(*kept, *counts, F.size("words").cast("long").alias("n_words"),
                   F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    counts.append("n_words")
    starts = F.when(F.size("h") >= WINDOW, F.sequence(F.lit(0), F.size("h") - WINDOW)).otherwise(
        F.array().cast("array<int>"))
    df = df.select(*kept, *counts, F.transform(
        starts, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])).alias("w"))
    # Only texts with a repeated window are sorted.
    df = df.select(*kept, *counts, F.when(
        F.size(F.array_distinct("w")) < F.size("w"),
        F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("w"))
    df = df.select(*kept, *counts, F.coalesce(_repeat_words(F.col("w")), F.lit(0)).cast("long").alias("n_repeat_words"))
    out = F.struct(*BASE_COLUMNS, "n_lines", "n_shouts").alias(name)
    return df.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(documents.columns)], out)


def failures(m: Column, limits: Limits) -> dict[str, Column]:
    n = m["n_words"]
    return {
        "few_words": n < limits.min_words,
        "repeats": 100 * m["n_repeat_words"] > limits.repeat_percent * n,
        "symbols": 100 * m["n_symbols"] > limits.symbols_per_100_words * n,
        "word_length": (m["word_chars"] < limits.min_word_chars * n) | (m["word_chars"] > limits.max_word_chars * n),
        "line_copies": 100 * m["n_dup_lines"] > limits.dup_line_percent * m["n_lines"],
        "shouting": 100 * m["n_shouts"] > limits.shouts_per_100_words * n,
    }


def base_failed(m: Column, limits: Limits = Limits()) -> Column:
    failed = failures(m, limits)
    return failed["few_words"] | failed["repeats"]


def host_verdicts(rows: DataFrame, measures: str, host: str, limits: Limits = Limits()) -> DataFrame:
    """Per host: `verdict_host`, `confirmed` (one boolean per rule) and `rejected`.

    The prior of a rule is the beta distribution with the corpus rate as its mean and the variance
    between hosts, sampling noise taken off, as its variance. Where hosts do not differ, it has the
    weight `1e6`. The prior is one row of numbers, whatever the number of hosts.
    """
    failed = failures(F.col(measures), limits)
    hosts = store(rows.groupBy(F.col(host).cast("string").alias("verdict_host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(failed[r]).alias(r) for r in RULES]), "hosts")
    moments = []
    for r in RULES:
        rate = F.col(r) / F.col("n")
        moments += [(F.sum(r) / F.sum("n")).alias(f"{r}_mean"), F.var_pop(rate).alias(f"{r}_var"),
                    F.avg(1 / F.col("n")).alias(f"{r}_inverse")]
    found = hosts.agg(*moments).first()
    shrunk = {}
    for r in RULES:
        mean, spread = found[f"{r}_mean"] or 0.0, found[f"{r}_var"] or 0.0
        noise = mean * (1 - mean) * (found[f"{r}_inverse"] or 0.0)
        between = spread - noise
        weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
        shrunk[r] = (F.col(r) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    rejected = F.greatest(*shrunk.values()) >= limits.reject
    return hosts.select("verdict_host", F.struct(*[(shrunk[r] >= limits.confirm).alias(r) for r in RULES]).alias("confirmed"),
                        rejected.alias("rejected"))


def judged(rows: DataFrame, measures: str, host: str, limits: Limits = Limits()) -> DataFrame:
    """`rows` with a boolean `kept`. `rows` must be stored: it is read for the hosts and for the result."""
    kept = free_name(rows, "kept")
    verdicts = host_verdicts(rows, measures, host, limits)
    failed = failures(F.col(measures), limits)
    confirmed = [failed[r] & verdicts["confirmed"][r] for r in RULES if r not in ("few_words", "repeats")]
    bad = base_failed(F.col(measures), limits) | verdicts["rejected"]
    for c in confirmed:
        bad = bad | c
    joined = rows.alias("r").join(verdicts, rows[host].cast("string").eqNullSafe(verdicts["verdict_host"]))
    return joined.select("r.*", (~bad).alias(kept))


def quality_rules(documents: DataFrame, host: str = "source", text: str = "text",
                  limits: Limits = Limits()) -> DataFrame:
    """The documents that are kept, with the columns of `documents`.

    Documents are stored once with their measures, so texts are measured once and never shuffled.
    """
    name = free_name(documents, "measures")
    rows = store(measured(documents, text, name), "measured")
    out = judged(rows, name, host, limits)
    return out.where(F.col(out.columns[-1])).select(*[F.col(f"`{c}`") for c in documents.columns])


def verdict_rows(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per document its base measures, `base_failed` and `kept`."""
    slim = documents.select("doc_id", F.col("source").alias("host"), F.col("text"))
    rows = measured(slim, "text", "measures").select("doc_id", "host", "measures")
    out = judged(store(rows, "measured"), "measures", "host", limits)
    return out.select("doc_id", *[F.col(f"measures.{c}").alias(c) for c in BASE_COLUMNS],
                      base_failed(F.col("measures"), limits).alias("base_failed"), "kept")


def sql(limits: Limits = Limits()) -> str:
    """The same rows by DuckDB: windows as lists of words, counted per document."""
    rules = {
        "few_words": f"n_words < {limits.min_words}",
        "repeats": f"100 * n_repeat_words > {limits.repeat_percent} * n_words",
        "symbols": f"100 * n_symbols > {limits.symbols_per_100_words} * n_words",
        "word_length": f"word_chars < {limits.min_word_chars} * n_words or word_chars > {limits.max_word_chars} * n_words",
        "line_copies": f"100 * n_dup_lines > {limits.dup_line_percent} * n_lines",
        "shouting": f"100 * n_shouts > {limits.shouts_per_100_words} * n_words",
    }
    counts = ", ".join(f"count(*) filter (where {c}) as {r}" for r, c in rules.items())
    moments = ", ".join(
        f"sum({r}) / sum(n) as {r}_mean, var_pop({r} / n) - sum({r}) / sum(n) * (1 - sum({r}) / sum(n)) * avg(1 / n) as {r}_between"
        for r in RULES)
    weights = ", ".join(
        f"{r}_mean, case when {r}_between > 0 then least(greatest({r}_mean * (1 - {r}_mean) / {r}_between - 1, 1), 1e6) else 1e6 end as {r}_weight"
        for r in RULES)
    rates = ", ".join(f"({r} + {r}_mean * {r}_weight) / (n + {r}_weight) as {r}_rate" for r in RULES)
    confirmed = " or ".join(f"(({rules[r]}) and {r}_rate >= {limits.confirm})" for r in RULES[2:])
    rejected = f"greatest({', '.join(f'{r}_rate' for r in RULES)}) >= {limits.reject}"
    return rf"""
with split_up as (
  select doc_id, source, text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) as lines
  from documents),
windows as (
  select doc_id, i, list_slice(words, i, i + {WINDOW - 1}) as w
  from (select doc_id, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) as i from split_up)),
marked as (
  select doc_id, i, count(*) over (partition by doc_id, w) as c from windows),
covered as (
  select doc_id, count(distinct j) as n from (
    select doc_id, unnest(generate_series(i, i + {WINDOW - 1})) as j from marked where c > 1) group by doc_id),
m as (
  select doc_id, source, len(words)::bigint as n_words,
    length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words,
    len(lines) as n_lines, length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) as n_shouts
  from split_up left join covered using (doc_id)),
hosts as (select source, count(*) as n, {counts} from m group by source),
moments as (select {moments} from hosts),
weights as (select {weights} from moments),
rates as (select source, {rates} from hosts, weights)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({rules['few_words']} or {rules['repeats']}) as base_failed,
  not ({rules['few_words']} or {rules['repeats']} or {rejected} or {confirmed}) as kept
from m join rates on m.source is not distinct from rates.source"""
