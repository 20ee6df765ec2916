"""Fork-point groups, ranking metrics and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FORK = ["seed", "tick", "state_before_hash"]

TIE = 1e-9


def with_prediction(rows: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model's prediction, for queries on tables without one."""
    return rows.withColumn("pred", (F.col("event_id") * 7 + F.length("episode_id") * 13 + F.col("d")) % 101)


def episode_outcomes(rows: DataFrame) -> DataFrame:
    """(episode_id, tick, outcome): branches have the sum of their receipts at their first tick, others each tick's realised change.

    rows: episode_id, tick, receipt_delta, realized_delta.
    """
    branch = F.col("episode_id").contains("_cf_")
    own = rows.filter(~branch).select("episode_id", "tick", F.col("realized_delta").alias("outcome"))
    cf = rows.filter(branch).groupBy("episode_id").agg(F.min("tick").alias("tick"), F.sum("receipt_delta").alias("outcome"))
    return own.unionByName(cf.select("episode_id", "tick", "outcome"))


def attach_outcomes(samples: DataFrame, outcomes: DataFrame) -> DataFrame:
    """samples with their outcome, 0 if they have none."""
    return samples.join(outcomes, ["episode_id", "tick"], "left").withColumn("outcome", F.coalesce("outcome", F.lit(0)))


def groups(rows: DataFrame, at_least: int = 2) -> DataFrame:
    """The fork points with enough candidates, members ordered by episode."""
    found = rows.groupBy(*FORK).agg(F.sort_array(F.collect_list("episode_id")).alias("members"))
    return found.filter(F.size("members") >= at_least)


def evaluate(rows: DataFrame, truth: str, prediction: str, at_least: int = 2) -> DataFrame:
    """One row of metrics over fork points; nan where a metric has no base.

    A fork point has as many candidates as branches were asked for, so its
    candidates meet in one array; ties within TIE count as hits.
    """
    member = F.struct(F.col("episode_id"), F.col(truth).cast("double").alias("t"), F.col(prediction).cast("double").alias("p"))
    g = rows.groupBy(*FORK).agg(F.sort_array(F.collect_list(member)).alias("m")).filter(F.size("m") >= at_least)
    best = F.array_max(F.transform("m", lambda x: x["t"]))
    top = F.array_max(F.transform("m", lambda x: x["p"]))
    chosen = F.element_at(F.filter("m", lambda x: x["p"] == top), 1)["t"]
    pairs = F.flatten(
        F.transform("m", lambda a, i: F.transform(F.filter("m", lambda b, j: j > i), lambda b: F.struct((a["t"] - b["t"]).alias("t"), (a["p"] - b["p"]).alias("p"))))
    )
    told = F.filter(pairs, lambda d: F.abs(d["t"]) > TIE)
    g = g.select(
        (best - chosen).alias("regret"),
        F.size(told).alias("pairs"),
        F.size(F.filter(told, lambda d: d["t"] * d["p"] > 0)).alias("agree"),
        F.aggregate("m", F.lit(0.0), lambda s, x: s + F.abs(x["t"] - x["p"])).alias("error"),
        F.size("m").alias("n"),
    )
    nan = F.lit(float("nan"))
    return g.agg(
        F.coalesce(F.avg(F.when(F.col("regret") <= TIE, 1.0).otherwise(0.0)), nan).alias("ranking_accuracy"),
        F.coalesce(F.try_divide(F.sum("error"), F.sum("n")), nan).alias("energy_mae"),
        F.coalesce(F.avg("regret"), nan).alias("top1_regret"),
        F.coalesce(F.try_divide(F.sum("agree").cast("double"), F.sum("pairs").cast("double")), nan).alias("direction_consistency"),
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_candidates"),
    )


def candidate_pairs(rows: DataFrame, truth: str, prediction: str) -> DataFrame:
    """The unordered pairs of a fork point's candidates, with the signs of their differences."""
    left = rows.select(*FORK, F.col("episode_id").alias("a"), F.col(truth).alias("ta"), F.col(prediction).alias("pa"))
    right = rows.select(*FORK, F.col("episode_id").alias("b"), F.col(truth).alias("tb"), F.col(prediction).alias("pb"))
    pairs = left.join(right, FORK).filter("a < b")
    return pairs.select(*FORK, "a", "b", F.signum((F.col("ta") - F.col("tb")).cast("double")).alias("true_sign"), F.signum((F.col("pa") - F.col("pb")).cast("double")).alias("pred_sign"))


def ranked(rows: DataFrame, prediction: str) -> DataFrame:
    """Each candidate's place at its fork point, best prediction first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*FORK).orderBy(F.desc(prediction), "episode_id")))
