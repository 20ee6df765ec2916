"""Joins between records, metadata and counts.

Small sides (splits, vocabularies, action lists) are left to the planner,
which broadcasts by measured size and else merges; nothing is broadcast by
decree but tables whose size a definition fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered


def with_split(records: DataFrame, splits: DataFrame) -> DataFrame:
    """Records of the three known splits; others are dropped."""
    return records.join(splits.select("episode_id", "split"), "episode_id").filter(F.col("split").isin("train", "val", "test"))


def orphans(executed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Executed actions without a candidate of their agent."""
    return executed.join(candidates, ["episode_id", "tick", "agent_id"], "left_anti")


def same_keys(a: Column, b: Column) -> Column:
    """Whether two maps have the same keys; null maps have none."""
    keys = lambda m: F.coalesce(F.array_sort(F.map_keys(m)), F.array().cast("array<string>"))
    return keys(a) == keys(b)


def undeclared(episodes: DataFrame, declared: DataFrame) -> DataFrame:
    return episodes.join(declared, "episode_id", "left_anti")


def matched_utilities(baseline: DataFrame, candidate: DataFrame, scalar: str = "scalar") -> DataFrame:
    """Each candidate outcome against the baseline's at the same seed and tick; matched if it started from the same state."""
    b = baseline.select("seed", "tick", F.col("state_before_hash").alias("__hash"), F.col(scalar).alias("baseline_utility"))
    c = candidate.select("seed", "tick", "episode_id", "state_before_hash", F.col(scalar).alias("candidate_utility"))
    both = b.join(c, ["seed", "tick"])
    return both.select("seed", "tick", "episode_id", "baseline_utility", "candidate_utility", (F.col("candidate_utility") - F.col("baseline_utility")).alias("delta"), F.col("__hash").eqNullSafe(F.col("state_before_hash")).alias("matched"))


def in_vocabulary(rows: DataFrame, vocabulary: DataFrame, column: str) -> DataFrame:
    """Rows whose value has a number in the vocabulary (columns: the value, index)."""
    return rows.join(vocabulary.select(column, F.col("index").alias(f"{column}_idx")), column)


def vocabulary(rows: DataFrame, column: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values in text order with their number; extra values are put before them."""
    found = rows.select(column).filter(F.col(column).isNotNull()).distinct().filter(~F.col(column).isin(list(extra)) if extra else F.lit(True))
    out = numbered(found, [column], "index").withColumn("index", F.col("index") + len(extra))
    if extra:
        first = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(extra)], f"{column} string, index long")
        out = first.unionByName(out)
    return out


def hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of nodes over undirected edges."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return nodes.join(both, nodes.node == both.src).select("node", F.col("dst").alias("neighbour"))


def distances(edges: DataFrame, start: str, most: int = 50) -> DataFrame:
    """Breadth-first distances from a node; one join for each ring, ended by an empty one."""
    spark = edges.sparkSession
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = spark.createDataFrame([(start, 0)], "node string, distance int")
    ring = seen
    for d in range(1, most + 1):
        ring = ring.join(both, ring.node == both.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(d)).checkpoint()
        if ring.isEmpty():
            break
        seen = seen.unionByName(ring)
    return seen
