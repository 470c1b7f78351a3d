"""Connected components of links between 64-bit node keys, without gathering any neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datadict.llm.tables import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `root`: every linked node with the smallest node it can reach.

    Alternates two steps until nothing changes. In the first every node passes its smallest neighbour
    to its larger neighbours, in the second to its smaller ones. Both are a minimum per node, combined
    before the shuffle, and an equi-join; the number of links never grows. Each round is written, so
    a lost executor costs one round at most.
    """
    edges = links.select(F.least(a, b).alias("root"), F.greatest(a, b).alias("node")).where("root <> node").distinct()
    edges = scratch.store(edges, "edges")
    seen = None
    while True:
        both = edges.select("node", F.col("root").alias("near")).union(edges.select(F.col("root"), F.col("node")))
        least = both.groupBy("node").agg(F.min("near").alias("least"))
        least = least.select(F.col("node").alias("at"), F.least("node", "least").alias("least"))
        large = both.join(least, both["node"] == least["at"]).where("near > at").select(
            F.col("least").alias("root"), F.col("near").alias("node")).where("root <> node").distinct()
        small_least = large.groupBy("node").agg(F.min("root").alias("least")).withColumnRenamed("node", "at")
        joined = large.join(small_least, large["node"] == small_least["at"])
        small = joined.select(F.explode(F.array(
            F.struct(F.col("least").alias("root"), F.col("root").alias("node")),
            F.struct(F.col("least").alias("root"), F.col("node").alias("node")))).alias("e")).select("e.root", "e.node")
        edges = scratch.store(small.where("root <> node").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("root", "node"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return edges.select("node", "root").union(edges.select(F.col("root").alias("node"), "root").distinct())
