"""Main text of web pages: page differencing between nearest URLs, over lines marked by the markup.

Pages of a host are sorted by URL path, and each is paired with the neighbour that shares the longer
start of the path. All lines of the two pages, menus and footers too, are aligned by a longest common
subsequence, and shared lines are deleted: they belong to the site. The markup breaks the tie where both
have a say:

* Inside the part that a page marks best as its article (`article`, `main`, a content name) a shared line
  stays, since articles quote one another.
* Outside it, and inside menus, headers, footers, sidebars, notices, adverts, forms, comments and scripts,
  a line that is not shared goes as well.
* Differencing alone decides for pages without such marks, and for containers inside an article whose
  name has a frame's word beside others (`related-work`).

A neighbour that has all lines of the page's own text is a copy and says nothing; where one has `COPY_SHARE`
of them, only lines that the other neighbour shares too are the site's. Where a neighbour deletes nothing,
the other is asked.

Defined results: null html is an empty text; a page without a URL, or alone on its host, loses only what
the markup drops; neighbours of equal nearness: the one before is asked first; pages of equal path lie in
the order of a hash of their row; repeated rows each get their text and are one page; a page of any length
is aligned whole, in memory of its lines to the power 1.5 bits; prose inside a form is text if the page has no
other; broken, nested or unclosed tags are read as browsers mostly do; an empty table gives an empty one.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datadict.llm.html_lines import DROPPED, FORM, OTHER, page_lines, shared_lines
from datadict.llm.tables import Scratch
from datadict.llm.tokens import text_groups
from datadict.operators.ordered import number_rows_by_range
from datadict.storage import store

COPY_SHARE = 0.8

# What the markup says of a line: outside the text, the text, or nothing.
FRAME, TEXT, OPEN = range(3)


def verdicts(parts: list[int], doubts: list[bool]) -> list[int]:
    """The markup's verdict on each line: the lines of the surest part that the page has are its text."""
    best = min((p for p in parts if p != DROPPED), default=OTHER)
    return [FRAME if p != best else OPEN if d or best in (OTHER, FORM) else TEXT for p, d in zip(parts, doubts)]


def deleted_lines(hashes: list[int], said: list[int], neighbours: list[list[int]]) -> list[int]:
    """Positions of the lines that are the site's, by the nearest neighbour that tells."""
    own = {i for i, v in enumerate(said) if v != FRAME}
    shared = [s for s in (set(shared_lines(hashes, other)) for other in neighbours) if not own or not s >= own]
    for at, both in enumerate(shared):
        if own and len(own & both) >= COPY_SHARE * len(own) and at + 1 < len(shared):
            both = both & shared[at + 1]
        gone = sorted(i for i in both if said[i] != TEXT)
        if gone:
            return gone
    return []


def _frames(pages: DataFrame) -> DataFrame:
    """Per page the hashes of its lines, and what the markup says of each."""

    def run(batches: Iterator) -> Iterator:
        import xxhash

        for batch in batches:
            html = [h or "" for h in batch.column("html").to_pylist()]
            for first, last in text_groups(html):
                hashes, said = [], []
                for page in html[first:last]:
                    lines, parts, doubts = page_lines(page)
                    hashes.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t in lines])
                    said.append(verdicts(parts, doubts))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(first, last - first) for c in ("key", "host", "path")),
                    pa.array(hashes, pa.list_(pa.int64())), pa.array(said, pa.list_(pa.int8()))],
                    ["key", "host", "path", "hashes", "said"])

    slim = pages.select("key", "host", "path", "html")
    return slim.mapInArrow(run, "key bigint, host string, path string, hashes array<bigint>, said array<tinyint>")


def _deleted(pairs: DataFrame) -> DataFrame:
    """Per page the positions of the lines it shares with its nearest page; pages without any are left out.

    `pairs`: key, path, hashes, said, and path and hashes of the page before and the page after.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            keys, dropped = [], []
            for row in batch.to_pylist():
                near = [(len(os.path.commonprefix([row["path"], row[f"{s}_path"]])), row[f"{s}_hashes"])
                        for s in ("before", "after") if row[f"{s}_path"] is not None]
                near.sort(key=lambda x: -x[0])
                gone = deleted_lines(row["hashes"], row["said"], [other for _, other in near])
                if gone:
                    keys.append(row["key"])
                    dropped.append(gone)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(dropped, pa.list_(pa.int32()))], ["key", "dropped"])

    return pairs.mapInArrow(run, "key bigint, dropped array<int>")


def _texts(pages: DataFrame) -> DataFrame:
    """`text`, `n_chars` and `n_deleted` of pages (page_id, url, html, dropped)."""
    fields = pages.schema

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            html = [h or "" for h in batch.column("html").to_pylist()]
            dropped = batch.column("dropped").to_pylist()
            for first, last in text_groups(html):
                texts = []
                for page, gone in zip(html[first:last], dropped[first:last]):
                    lines, parts, doubts = page_lines(page)
                    gone = set(gone or ())
                    texts.append("\n".join(t for i, (t, v) in enumerate(zip(lines, verdicts(parts, doubts))) if v != FRAME and i not in gone))
                yield pa.RecordBatch.from_arrays([
                    batch.column("page_id").slice(first, last - first), batch.column("url").slice(first, last - first),
                    pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(gone or ()) for gone in dropped[first:last]], pa.int64()),
                ], ["page_id", "url", "text", "n_chars", "n_deleted"])

    kind = fields["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html", "dropped").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars bigint, n_deleted bigint")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars` per row of `pages`, and `n_deleted`, the lines that differencing found to be the site's.

    Only hashes of lines are sorted and joined. The pages meet the list of deleted lines by a key;
    this list is written first, and Spark broadcasts it where its known size allows.
    """
    scratch = Scratch(pages.sparkSession)
    bare = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.col(f"`{html}`").cast("string").alias("html"))
    rows = bare.withColumn("key", F.xxhash64("page_id", "url", "html"))
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    frames = _frames(rows.withColumns({"host": host, "path": path})).dropDuplicates(["key"])
    frames = scratch.store(frames, "frames")
    numbered = scratch.store(number_rows_by_range(frames.select("host", "path", "key").where("host <> ''"), ["host"], ["path", "key"], "n"), "numbered")
    placed = numbered.join(frames.select("key", "hashes", "said"), "key")
    known = scratch.store(placed, "placed")
    before = known.select("host", (F.col("n") + 1).alias("n"), F.col("path").alias("before_path"), F.col("hashes").alias("before_hashes"))
    after = known.select("host", (F.col("n") - 1).alias("n"), F.col("path").alias("after_path"), F.col("hashes").alias("after_hashes"))
    pairs = known.join(before, ["host", "n"], "left").join(after, ["host", "n"], "left")
    dropped = store(_deleted(pairs).withColumnRenamed("key", "of"), "dropped")
    scratch.clear()
    return _texts(rows.join(dropped, F.col("key") == F.col("of"), "left"))
