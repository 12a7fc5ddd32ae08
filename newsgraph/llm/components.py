"""Connected components of an edge table, by pointing at ever smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b``: the smallest node reachable.

    Large-star and small-star rounds: nodes hand their larger neighbours, then
    their smaller ones, to the smallest neighbour they know, until nothing
    changes; the rounds grow with the logarithm of the number of edges. A node's
    minimum is an aggregate with partial results and comes back by a join, so no
    task gathers the neighbours of a node. Each round is written to the shared
    folder. Loops and repeated edges do not matter.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: each larger neighbour v of u now points at the smallest m.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        # Small star: u and its smaller neighbours point at the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
        links = stored(small.filter("u > v").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
