"""Training rows of episodes: encoded state before and after, joint action, exogenous input, targets.

States come from an initial table and a log of set-valued changes, so the
fold over ticks is a window (the last change up to a tick wins). An episode
without an initial state fails; it is never encoded as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import features as X


def states(steps: DataFrame, initial: DataFrame, changes: DataFrame) -> DataFrame:
    """steps (episode_id, tick) with before and after: map<key, text> of the state around each tick.

    initial: episode_id, key, value; changes: episode_id, tick, key, value
    (null removes the key). Each change is placed among the steps once, and
    holds from its step to that of the key's next change, so the rows made
    are the entries of the maps that come out.
    """
    missing = steps.select("episode_id").distinct().join(initial.select("episode_id").distinct(), "episode_id", "left_anti")
    checked = steps.join(missing.withColumn("__missing", F.lit(True)), "episode_id", "left")
    failed = F.raise_error(F.concat(F.lit("no initial state: "), F.col("episode_id"))).cast("string")
    steps = checked.withColumn("episode_id", F.when(F.col("__missing"), failed).otherwise(F.col("episode_id"))).drop("__missing")
    log = initial.select("episode_id", F.lit(-1).cast("long").alias("tick"), "key", "value").unionByName(changes.select("episode_id", F.col("tick").cast("long").alias("tick"), "key", "value"))
    none = F.lit(None).cast("string")
    marks = steps.select("episode_id", F.col("tick").cast("long").alias("tick"), none.alias("key"), none.alias("value"), F.lit(1).alias("step"))
    marks = marks.unionByName(log.select("*", F.lit(0).alias("step")))
    by_tick = Window.partitionBy("episode_id").orderBy("tick")
    count = lambda until: F.coalesce(F.sum("step").over(by_tick.rangeBetween(Window.unboundedPreceding, until)), F.lit(0))
    # A change shows in the state after the first step at its tick or later, and in the state before the first step later than it.
    marks = marks.select("*", count(-1).alias("after"), count(0).alias("before"), F.sum("step").over(Window.partitionBy("episode_id")).alias("steps"))
    places = marks.filter("step = 1").select("episode_id", "tick", F.col("after").alias("place"))
    per_key = Window.partitionBy("episode_id", "key").orderBy("tick")
    spans = marks.filter("step = 0").select("*", *[F.coalesce(F.lead(name).over(per_key), F.col("steps")).alias(f"{name}_end") for name in ("before", "after")]).filter("value is not null")

    def at(name: str) -> DataFrame:
        held = spans.filter(F.col(name) < F.col(f"{name}_end")).withColumn("place", F.explode(F.sequence(F.col(name), F.col(f"{name}_end") - 1)))
        return held.groupBy("episode_id", "place").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name))

    empty = F.create_map().cast("map<string,string>")
    found = places.join(at("before"), ["episode_id", "place"], "left").join(at("after"), ["episode_id", "place"], "left")
    return found.select("episode_id", "tick", F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"))


def training_rows(steps: DataFrame, initial: DataFrame, changes: DataFrame, agents: tuple[str, ...], actions: tuple[str, ...], width: int = 32, buckets: int = 8) -> DataFrame:
    """steps: episode_id, tick, executed (map<agent, struct<action_type, params>>), exogenous (map<string,string>), and targets that pass through."""
    found = steps.join(states(steps.select("episode_id", "tick"), initial, changes), ["episode_id", "tick"])
    return found.select(
        *[c for c in steps.columns if c not in ("executed", "exogenous")],
        X.field_block(F.col("before"), width, buckets).alias("state_before"),
        X.field_block(F.col("after"), width, buckets).alias("state_after"),
        X.joint_action(F.col("executed"), agents, actions).alias("joint_action"),
        X.exogenous_block(F.col("exogenous"), buckets).alias("exogenous"),
    )
