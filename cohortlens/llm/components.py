"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and joins over the edges; nothing but two
numbers per round reaches the driver, and every round is written to the
shared folder, so a lost executor costs one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    pairs = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return pairs.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint) to (node, root): the smallest node of each node's component.

    Nodes without an edge do not appear; self loops and repeated edges are
    harmless; an empty table gives an empty result.
    """
    edges = edges.where("a <> b")
    seen = None
    while True:
        edges = staged(_small_star(_large_star(edges)), "star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
