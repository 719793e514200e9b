"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges`` (a long, b long); root is the smallest reachable node.

    Large-star hangs each node's larger neighbours on its smallest neighbour, small-star its smaller ones. Minima are
    aggregations with partial sums and joined back, so no neighbourhood is ever gathered. Self edges, repeated edges
    and edges with a null are ignored; no edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = written(now, "links"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = low.select("u", F.col("m").alias("v"))
        after = written(small.unionByName(hung).distinct(), "links")
        discard(now)
        now = after
    roots = now.select(F.col("v").alias("node")).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after adding ``edges`` to the graph that ``roots``, a result of ``components``, describes.

    Only the components that the new edges touch are worked on.
    """
    def at(side: str) -> DataFrame:
        return roots.select(F.col("node").alias(side), F.col("root").alias("root_" + side))

    ends = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = written(components(ends), "moved")
    kept = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select(
        "node", F.coalesce("to", "root").alias("root"))
    return kept.unionByName(moved.join(roots.select("node"), "node", "left_anti"))
