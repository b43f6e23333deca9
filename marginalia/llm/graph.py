"""Connected components over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import checkpointed, dropped


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the component's smallest node.

    Alternating large-star and small-star steps: each hangs a node's neighbours
    on the smallest node near it, until every component is a star. What is least
    near each node is written before edges meet it, so that the join of a hub's
    edges with its one row can be split at run time. The driver sees counts only.

    Defined results: loops (a = b) and null ends are ignored, repeated edges count
    once, nodes without edges are not listed, no edges give no rows.
    """
    stars = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.where("a <> b").distinct())
        small = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        hung = large.join(small, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = checkpointed(hung.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        dropped(stars, least, large, small)
        stars = now
        # A step that changes nothing has stars before it.
        row = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        seen = (row["n"], row["sum"])
        if seen == mark or not row["n"]:
            break
        mark = seen
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = checkpointed(stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots))
    dropped(stars)
    return out
