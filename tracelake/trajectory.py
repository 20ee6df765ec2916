"""Transition tables derived from the event table.

An episode is a user's events in time order; the state is the running sum of
the events' values in cents, so every figure is an integer. The state hash is
the canonical hash of the tuple (seed, tick, energy), which makes each
episode a closed chain: the state after a tick is the state before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.canonical import hash_of, int_tuple
from .operators.ordering import running
from .registry import table

BRANCHES, BRANCH_EVERY = 3, 5


def transitions(spark: SparkSession, sf_dir: str, long_episodes: bool = False) -> DataFrame:
    """One row per (episode, tick). One shuffle on the episode serves both windows.

    long_episodes: an episode may hold a large share of all rows, so ticks
    and energies are carried over ranges instead of computed in one task.
    """
    order = Window.partitionBy("seed").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("seed"), "event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("d")
    )
    if long_episodes:
        rows = running(rows, ["seed"], ["ts", "event_id"], {"d": "energy_after"}, "tick")
    else:
        rows = rows.withColumn("tick", (F.row_number().over(order) - 1).cast("long")).withColumn("energy_after", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(
        "seed",
        F.concat(F.lit("seed"), F.col("seed").cast("string"), F.lit("_run0")).alias("episode_id"),
        "event_id",
        "ts",
        "tick",
        F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")).alias("agent_id"),
        F.col("event_type").alias("action_type"),
        F.when(F.col("tick") % 3 == 0, "random").when(F.col("tick") % 3 == 1, "scripted:first").otherwise("adversarial").alias("policy_id"),
        F.when(F.col("event_type") == "error", "illegal_action").otherwise("ok").alias("outcome_code"),
        "d",
        (F.col("energy_after") - F.col("d")).alias("energy_before"),
        "energy_after",
        hash_of(int_tuple(F.col("seed"), F.col("tick"), F.col("energy_after") - F.col("d"))).alias("state_before_hash"),
        hash_of(int_tuple(F.col("seed"), F.col("tick") + 1, F.col("energy_after"))).alias("state_after_hash"),
    )


def branches(rows: DataFrame, count: int = BRANCHES, every: int = BRANCH_EVERY) -> DataFrame:
    """Counterfactual rows: alternatives at every so many ticks but the first, from the same state."""
    fork = rows.filter((F.col("tick") > 0) & (F.col("tick") % every == 0))
    out = fork.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return out.select(
        "seed",
        F.concat("episode_id", F.lit("_cf_t"), F.col("tick").cast("string"), F.lit("_b"), F.col("branch").cast("string")).alias("episode_id"),
        "event_id",
        "ts",
        "tick",
        F.concat(F.lit("e"), ((F.col("event_id") + F.col("branch") + 1) % 4).cast("string")).alias("agent_id"),
        F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "signup"))), ((F.col("event_id") + F.col("branch")) % 4 + 1).cast("int")).alias("action_type"),
        F.lit("counterfactual_branch").alias("policy_id"),
        F.lit("ok").alias("outcome_code"),
        ((F.col("event_id") * 31 + (F.col("branch") + 1) * 977) % 30000).alias("d"),
        "energy_before",
        (F.col("energy_before") + (F.col("event_id") * 31 + (F.col("branch") + 1) * 977) % 30000).alias("energy_after"),
        "state_before_hash",
        F.lit(None).cast("string").alias("state_after_hash"),
    )


def with_branches(rows: DataFrame) -> DataFrame:
    """Factual rows and their branches, which keep their parent's seed."""
    return rows.unionByName(branches(rows))


def episodes(rows: DataFrame) -> DataFrame:
    """One row per episode, with the keys that splits must not share."""
    return (
        rows.groupBy("episode_id", "seed")
        .agg(F.count("*").alias("records"))
        .select(
            "episode_id",
            "seed",
            "records",
            F.concat(F.lit("scenario"), (F.col("seed") % 7).cast("string")).alias("scenario_id"),
            F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("params"), (F.col("seed") % 11).cast("string")), 256)).alias("world_parameters_hash"),
            F.when(F.col("seed") % 4 != 0, F.concat(F.lit("group"), F.floor(F.col("seed") / 5).cast("string"))).alias("branch_group_id"),
        )
    )


def split_of(seed) -> F.Column:
    """A split by seed: one in ten for test and one for validation."""
    return F.when(seed % 10 == 0, "test").when(seed % 10 == 1, "val").otherwise("train")


#: The same views for DuckDB.
TR = """
tr0 AS (
  SELECT CAST(user_id AS BIGINT) AS seed, event_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS d,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick
  FROM events),
tr1 AS (SELECT *, CAST(sum(d) OVER (PARTITION BY seed ORDER BY tick) AS BIGINT) AS energy_after FROM tr0),
tr AS (
  SELECT seed, concat('seed', seed, '_run0') AS episode_id, event_id, ts, tick, concat('e', event_id % 4) AS agent_id, event_type AS action_type,
         CASE tick % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'scripted:first' ELSE 'adversarial' END AS policy_id,
         CASE event_type WHEN 'error' THEN 'illegal_action' ELSE 'ok' END AS outcome_code,
         d, energy_after - d AS energy_before, energy_after,
         concat('sha256:', sha256(concat('(3:i', seed, 'i', tick, 'i', energy_after - d))) AS state_before_hash,
         concat('sha256:', sha256(concat('(3:i', seed, 'i', tick + 1, 'i', energy_after))) AS state_after_hash
  FROM tr1)"""

CF = (
    TR
    + """,
cf AS (
  SELECT seed, concat(episode_id, '_cf_t', tick, '_b', branch) AS episode_id, event_id, ts, tick, concat('e', (event_id + branch + 1) % 4) AS agent_id,
         (['view', 'click', 'purchase', 'signup'])[(event_id + branch) % 4 + 1] AS action_type, 'counterfactual_branch' AS policy_id, 'ok' AS outcome_code,
         (event_id * 31 + (branch + 1) * 977) % 30000 AS d, energy_before, energy_before + (event_id * 31 + (branch + 1) * 977) % 30000 AS energy_after,
         state_before_hash, CAST(NULL AS VARCHAR) AS state_after_hash
  FROM tr, (SELECT unnest(range(3)) AS branch) WHERE tick > 0 AND tick % 5 = 0),
both_rows AS (SELECT * FROM tr UNION ALL SELECT * FROM cf)"""
)

EP = (
    TR
    + """,
ep AS (
  SELECT episode_id, seed, count(*) AS records, concat('scenario', seed % 7) AS scenario_id, concat('sha256:', sha256(concat('params', seed % 11))) AS world_parameters_hash,
         CASE WHEN seed % 4 <> 0 THEN concat('group', seed // 5) END AS branch_group_id,
         CASE seed % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split
  FROM tr GROUP BY episode_id, seed)"""
)

#: Split by seed, for any view with that column.
SPLIT_SQL = "CASE seed % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"
