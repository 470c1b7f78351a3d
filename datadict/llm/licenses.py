"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Terms are lower-case words and pairs of neighbouring words. How many documents have a term is counted over
the whole corpus for the terms of the templates, which are few; every other term has the weight of a term
that no document has. A line (a header) or a whole licence file gets the template of the largest cosine,
if it reaches the limit. A cosine can reach it only if the text has a term beyond the lightest ones of the
template, so other lines are passed by without a vector. A file without a licence of its own takes that
of the nearest directory above it that has a licence file, found by joins on directory paths: distinct
directories first, files after.

Defined results: a null text has no terms; a null path is in no directory and inherits nothing; ties of
cosine go to the template of smaller name, then to the earlier line; rows of equal path are scanned one by
one; two licence files in a directory: the larger cosine, then the smaller path; an empty table gives an
empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datadict.llm.tables import Scratch
from datadict.storage import store

LIMIT = 0.6
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
TERM = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")

# Notices as their licences word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def terms_of(text: str) -> Counter:
    words = TERM.findall(text.lower())
    return Counter(words) + Counter(map(" ".join, zip(words, words[1:])))


class Scanner:
    """Templates as unit vectors, and the terms of which a text must have one."""

    def __init__(self, templates: dict[str, str], documents: int, having: dict[str, int], limit: float) -> None:
        self.limit = limit
        self.rare = math.log(1 + documents) + 1
        self.weight = {t: math.log((1 + documents) / (1 + n)) + 1 for t, n in having.items()}
        self.templates: dict[str, dict[str, float]] = {}
        self.needed: set[str] = set()
        for name, text in sorted(templates.items()):
            vector = {t: c * self.weight.get(t, self.rare) for t, c in terms_of(text).items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            self.templates[name] = {t: v / norm for t, v in vector.items()}
            light, left = 0.0, []
            for t, v in sorted(self.templates[name].items(), key=lambda x: (x[1], x[0])):
                light += v * v
                if math.sqrt(light) >= limit - 1e-9:
                    left.append(t)
            self.needed.update(left)
        words = {w for t in self.needed for w in t.split(" ")[:1]}
        self.hint = re.compile("|".join(sorted(map(re.escape, words), key=len, reverse=True)) or "(?!)")

    def best(self, text: str) -> tuple[str, float] | None:
        found = terms_of(text)
        if self.needed.isdisjoint(found):
            return None
        vector = {t: c * self.weight.get(t, self.rare) for t, c in found.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        best, name = 0.0, ""
        for n, template in self.templates.items():
            cosine = sum(v * vector[t] for t, v in template.items() if t in vector) / norm
            if cosine > best + 1e-12:
                best, name = cosine, n
        return (name, min(best, 1.0)) if best >= self.limit else None

    def scan(self, text: str, whole: bool) -> tuple[str, float, int] | None:
        """Licence, cosine and line (from 0; -1 for a whole file) of the best header."""
        best = None
        if whole and (found := self.best(text)):
            best = (*found, -1)
        if self.hint.search(text.lower()):
            for i, line in enumerate(text.split("\n")):
                found = self.best(line)
                if found and (best is None or (found[1], best[0]) > (best[1], found[0])):
                    best = (*found, i)
        return best


def document_counts(files: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that have each term of the templates: one number per term."""
    words = {w for t in vocabulary for w in t.split(" ")}

    def run(batches: Iterator) -> Iterator:
        total, having = 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += 1
                found = TERM.findall((text or "").lower())
                seen = words.intersection(found)
                if len(seen) > 1:
                    seen |= vocabulary.intersection(
                        f"{a} {b}" for a, b in zip(found, found[1:]) if a in words and b in words)
                having.update(seen & vocabulary)
        terms = [""] + list(having)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([total, *(having[t] for t in terms[1:])], pa.int64())], ["term", "n"])

    found = files.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in found.collect()}  # the terms of the templates
    return counts.pop("", 0), counts


def scanned(files: DataFrame, templates: dict[str, str] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """Per row of `files` (doc_id, path, text): `license`, `cosine`, `line` of its own best header; null without one."""
    vocabulary = {t for text in templates.values() for t in terms_of(text)}
    total, having = document_counts(files, vocabulary)
    scanner = Scanner(templates, total, having, limit)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = [scanner.scan(t or "", w or False) or (None, None, None)
                    for t, w in zip(batch.column("text").to_pylist(), batch.column("is_license").to_pylist())]
            license_, cosine, line = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("doc_id", "path", "is_license")), pa.array(list(license_), pa.string()),
                pa.array(list(cosine), pa.float64()), pa.array(list(line), pa.int32())],
                ["doc_id", "path", "is_license", "license", "cosine", "line"])

    kind = files.schema["doc_id"].dataType.simpleString()
    named = files.select("doc_id", "path", F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)).alias("is_license"), "text")
    return named.mapInArrow(run, f"doc_id {kind}, path string, is_license boolean, license string, cosine double, line int")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherited(scans: DataFrame) -> DataFrame:
    """`scans` (stored) with `scope` (own, inherited or none) and `from_path`, the licence file inherited from."""
    placed = scans.withColumn("directory", _directory(F.col("path")))
    order = F.struct((-F.col("cosine")).alias("less"), "path", "license")
    sources = placed.where("is_license and license is not null and path is not null").groupBy("directory").agg(
        F.min(order).alias("best")).select(F.col("directory").alias("holder"), "best")
    folders = placed.where("license is null and path is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    above = folders.select("directory", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = above.select("directory", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("holder")).where(
        "directory <> '' or depth = 0")
    nearest = above.join(sources, "holder").groupBy("directory").agg(F.max_by("best", "depth").alias("best")).select(
        F.col("directory").alias("at"), F.col("best.license").alias("given"), F.col("best.path").alias("giver"))
    own = F.col("license").isNotNull()
    rows = placed.join(nearest, (F.col("directory") == F.col("at")) & ~own, "left")
    return rows.select(
        "doc_id", "path", F.coalesce("license", "given").alias("license"),
        F.when(own, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("scope"),
        "cosine", "line", F.when(~own, F.col("giver")).alias("from_path"))


def license_scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """The licence of every file: its own header's, or its directory's. Texts are read twice and never shuffled."""
    scratch = Scratch(files.sparkSession)
    slim = files.select("doc_id", "path", F.col("text").cast("string").alias("text"))
    out = store(inherited(scratch.store(scanned(slim, templates, limit), "scans")), "licenses")
    scratch.clear()
    return out


def with_paths(documents: DataFrame) -> DataFrame:
    """Documents as files of repositories: a source is a root with a folder per language, and shelves of 64 ids.

    Texts that speak of a licence, of any length, are licence files: of the root, the language or the shelf.
    """
    shelf = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")),
                        F.floor(F.coalesce("doc_id", F.lit(0)) / 64).cast("string"))
    notice = F.lower("text").contains("licens")
    level = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int") + 1
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    path = F.when(notice, F.concat(F.array_join(F.slice(F.split(shelf, "/"), F.lit(1), level), "/"), F.lit("/LICENSE-"), name)).otherwise(
        F.concat(shelf, F.lit("/"), name, F.lit(".txt")))
    return documents.select("doc_id", path.alias("path"), "text")
