"""Order MinHash: fingerprints whose likeness follows the edit distance of texts.

A text's k-mers are runs of three words. Each is numbered by its occurrence, so repeats are members
of their own, and hashed. The first bits of the hash deal the members to bins; in each bin the two of
smallest hash are chosen, put in the order in which they stand in the text, and the tuple of their
k-mers is hashed. Two texts agree in a bin if they chose equal k-mers in equal order.

Defined results: a null text is empty; an empty text has no filled bin and is like an empty one only;
a text of fewer than three words is one k-mer; a word longer than 32 bytes counts as several, so that
texts without blanks can be compared too; rows of equal id are rows of their own, ordered by text; a
null id comes after all others; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datadict.llm.tokens import text_groups
from datadict.llm.words import mix64, text_slices, windows, words_of

KMER = 3
BIN_BITS = 6
LONGEST_WORD = 32


def bins_of(column: pa.Array) -> np.ndarray:
    """One row of 32-bit bins per text; 0 is an empty bin."""
    parts, size = [], 1 << BIN_BITS
    for _, data, offsets in text_slices(column):
        words = words_of(data, offsets, False, LONGEST_WORD)
        texts = len(offsets) - 1
        count = np.diff(words.bounds)
        runs = windows(words.hash, KMER)
        long = np.flatnonzero(count >= KMER)
        at = np.arange(len(runs))
        text = words.text[:len(runs)]
        at = at[(at + KMER <= words.bounds[text + 1]) & (count[text] >= KMER)] if len(runs) else at
        kmer, text = runs[at], text[at]
        short = np.flatnonzero((count > 0) & (count < KMER))
        if len(short):
            first = words.bounds[short]
            one = np.concatenate([windows(words.hash[a:a + n], int(n)) for a, n in zip(first, count[short])])
            kmer, text, at = np.concatenate([kmer, one]), np.concatenate([text, short]), np.concatenate([at, first])
        parts.append(_bins(kmer, text, at, texts) if len(long) or len(short) else np.zeros((texts, size), np.uint32))
    return np.concatenate(parts) if parts else np.zeros((0, size), np.uint32)


def _bins(kmer: np.ndarray, text: np.ndarray, at: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((at, kmer, text))
    kmer, text, at = kmer[order], text[order], at[order]
    fresh = np.ones(len(kmer), bool)
    fresh[1:] = (kmer[1:] != kmer[:-1]) | (text[1:] != text[:-1])
    place = np.arange(len(kmer))
    occurrence = place - np.maximum.accumulate(np.where(fresh, place, 0))
    member = mix64(kmer * np.uint64(0xD6E8FEB86659FD93) + occurrence.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.lexsort((member, text))
    kmer, text, at, member = kmer[order], text[order], at[order], member[order]
    cell = (text << BIN_BITS) + (member >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    opens = np.ones(len(cell), bool)
    opens[1:] = cell[1:] != cell[:-1]
    one = np.flatnonzero(opens)
    two = one + 1
    paired = two < len(cell)
    paired[paired] = cell[two[paired]] == cell[one[paired]]
    two = np.where(paired, two, one)
    swap = at[two] < at[one]
    first, second = np.where(swap, two, one), np.where(swap, one, two)
    tail = np.where(paired, kmer[second], np.uint64(0))
    code = (mix64(mix64(kmer[first]) * np.uint64(0xE7037ED1A0B428DB) + tail) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros(texts << BIN_BITS, np.uint32)
    out[cell[one]] = np.maximum(code, 1)
    return out.reshape(texts, 1 << BIN_BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either text fills; 1 for two empty texts."""
    filled = ((a > 0) | (b > 0)).sum(1)
    equal = ((a == b) & (a > 0)).sum(1)
    return np.where(filled == 0, 1.0, equal / np.maximum(filled, 1))


def as_text(bins: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in bins]


def fingerprinted(documents: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """`documents` with the fingerprint of a text column as hexadecimal digits, eight per bin."""
    own = documents.columns
    at = own.index(text)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            made = as_text(bins_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*own, name])

    schema = documents.select("*", F.lit("").alias(name)).schema
    return documents.mapInArrow(run, schema)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending `bounds` exceed the value: larger values come first. Two short searches."""
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[::-1][i:i + wide] for i in range(0, len(bounds), wide)]  # descending
    if not groups:
        return F.lit(0)
    whole = F.size(F.filter(F.array(*[F.lit(g[-1]).cast("long") for g in groups]), lambda x: x > value))
    inner = F.get(F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups]), whole)
    rest = F.coalesce(F.size(F.filter(inner, lambda x: x > value)), F.lit(0))
    return whole * wide + F.greatest(rest, F.lit(0))


def with_next(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text) sorted within parts by descending id, each part followed by the rows that open the next.

    Parts are id ranges between quantiles; the last is followed by the first. Columns: part, ahead
    (true for the rows of the next part), doc_id, text. One shuffle of the texts.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    found = documents.select(F.col("doc_id").cast("double").alias("v")).approxQuantile("v", shares, 0.25 / parts) if shares else []
    bounds = sorted({int(b) for b in found})
    part = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(_bucket(F.col("doc_id").cast("long"), bounds))
    rows = documents.withColumn("part", part.cast("int"))
    opening = {r["part"]: r["first"] for r in rows.groupBy("part").agg(F.max("doc_id").alias("first")).collect()}  # one per part
    there = sorted(opening)
    if not there:
        return rows.select("part", F.lit(False).alias("ahead"), "doc_id", "text")
    before = {p: there[i - 1] for i, p in enumerate(there)}
    previous = F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(there[-1] + 1)]), F.col("part"))
    ids = [v for v in opening.values() if v is not None]
    opens = F.col("doc_id").isNull() | F.col("doc_id").isin(ids) if None in opening.values() else F.col("doc_id").isin(ids)
    here = F.struct(F.col("part"), F.lit(False).alias("ahead"))
    ahead = F.struct(previous.alias("part"), F.lit(True).alias("ahead"))
    dealt = rows.select(F.explode(F.when(opens, F.array(here, ahead)).otherwise(F.array(here))).alias("to"), "doc_id", "text")
    return dealt.select("to.part", "to.ahead", "doc_id", "text").repartition(parts, "part").sortWithinPartitions(
        "part", "ahead", F.col("doc_id").desc_nulls_last(), "text")


def edited_pairs(documents: DataFrame) -> DataFrame:
    """Per document the fingerprints of its text and of the text whose second half is taken from the next one."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    slim = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import hashlib

        held = None
        for batch in batches:
            if held is not None:
                batch = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([h, c]) for h, c in zip(held.columns, batch.columns)], batch.schema.names)
            if not batch.num_rows:
                continue
            held = batch.slice(batch.num_rows - 1)
            part, ahead = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(3).to_pylist()
            whole = bins_of(batch.column(3))
            last = np.ones(len(part), bool)
            last[:-1] = part[1:] != part[:-1]
            rows = np.flatnonzero(~ahead & ~last)  # a part ends with a row of the next one, so each row has a successor
            for first, end in text_groups([texts[i] for i in rows]):
                here = rows[first:end]
                edited = []
                for i in here:
                    half = len(texts[i]) // 2
                    edited.append(texts[i][:len(texts[i]) - half] + texts[i + 1][:half])
                column = pa.array(edited, pa.string())
                changed = bins_of(column)
                yield pa.RecordBatch.from_arrays([
                    batch.column(2).take(pa.array(here)), pa.array([len(texts[i]) for i in here], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array(as_text(whole[here])), pa.array(as_text(changed)),
                    pa.array(likeness(whole[here], changed)), pa.array(likeness(whole[here], whole[here + 1])),
                ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(slim).mapInArrow(run, f"""doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string,
        edited_fingerprint string, near_edited double, near_next double""")
