"""Connected components of an edge table by alternating star steps.

Each round is two joins against per-node minima (map-side combined), whose
results are written to the shared folder; the number of rounds grows with the logarithm of the
longest path.  Nodes and edges never reach the driver, only two sums do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptforge.llm.common import materialise


def stars(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> (node, root): every node that is not the smallest of
    its component, with that smallest node.  Loops, repeats and both directions
    of an edge are allowed."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = materialise(now, "star-edges"), None
    while True:
        # large star: neighbours above a node point to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are read from a table: both sides of each join are plain shuffles, so a hub's rows can be split
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-minima")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        large = materialise(large, "star-edges")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star-edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
