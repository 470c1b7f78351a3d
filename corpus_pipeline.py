"""From raw documents to packed training sequences.

Each stage works on all rows of the one before and returns the columns of `documents`; the last one
returns the pieces with their places in the sequences. Quality rules reject documents, line
deduplication shortens texts (and sets `n_chars`), the n-gram join keeps one document of each group
of near copies (five words, similarity 0.8), mixing repeats or leaves out documents by source, and
packing places the rest.

Nulls, empty texts, repeated rows, empty tables and further columns are taken as each operator
defines; see the modules in `datadict.llm`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from datadict.llm.line_dedup import line_dedup
from datadict.llm.mixing import mix
from datadict.llm.ngram_join import Bound, one_of_each
from datadict.llm.packing import packed_documents
from datadict.llm.quality import quality_rules
from datadict.llm.registry import free_name
from datadict.storage import place

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, Bound(words=5, percent=80))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix(docs, copy=free_name(docs, "copy"), key=free_name(docs, "mix_key"))
    return mixed.select(*[f"`{c}`" for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("ngram_jaccard", near_copies),
    ("mixing", mixture),
    ("best_fit_packing", packing),
]

# Set hashes, components and tokenizer ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = place(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
