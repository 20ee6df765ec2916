"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, release, staged


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): the least neighbour of every u, and the number of its edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v (long). (node, root) of every node with an edge, the root being the least node of its component.

    A large star links a node's larger neighbours to its least one, a small
    star its smaller ones; the number of edges never grows, and the rounds
    needed grow with the logarithm of the longest path. The centre of a star
    that holds a large share of the edges meets them by broadcast.
    """
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        n, check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, check) == mark or not n:
            break
        mark = (n, check)
        back = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = _least(now.unionByName(back)).select("u", F.least("u", "m").alias("m"), "n")
        # Of the two directions of an edge only that to the larger node is moved.
        least = staged(least, "least")
        large = join_counted(back, least, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large, "large-star")
        release(now, least)
        least = staged(_least(large), "least")
        small = join_counted(large, least, ["u"], "n", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        release(large, least)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
