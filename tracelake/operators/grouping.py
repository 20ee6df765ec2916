"""Counts, reports and small statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

NULL_EPSILON = 0.005


def coverage(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(dimension, key, count) of several keys in one grouping; empty and null keys don't count."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), k.cast("string").alias("key")) for d, k in keys.items()]))
    long = rows.select(each.alias("k")).select("k.dimension", "k.key").filter("key is not null and key <> ''")
    return long.groupBy("dimension", "key").count()


def coverage_gaps(reported: DataFrame, found: DataFrame) -> DataFrame:
    """Keys of which a report counts fewer than the data has."""
    both = found.select("dimension", "key", F.col("count").alias("in_data")).join(reported.select("dimension", "key", F.col("count").alias("in_report")), ["dimension", "key"], "full_outer")
    both = both.select("dimension", "key", F.coalesce("in_data", F.lit(0)).alias("in_data"), F.coalesce("in_report", F.lit(0)).alias("in_report"))
    return both.filter("in_report < in_data")


def mode_of(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The most frequent value, the smallest of equals."""
    by = by or []
    counts = rows.groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("count", -F.col(value))).alias(value))


def mean_by(rows: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.avg(t).alias(t) for t in targets])


def mae(truth: Column, prediction: Column) -> Column:
    return F.coalesce(F.avg(F.abs(truth - prediction)), F.lit(float("nan")))


def accuracy(truth: Column, prediction: Column) -> Column:
    """Share of equal values after rounding half to even."""
    return F.coalesce(F.avg((F.rint(truth) == F.rint(prediction)).cast("double")), F.lit(float("nan")))


def ndcg_proxy(rank: Column, score: Column) -> Column:
    """Mean over ranked rows of 1 / log2(rank + 1) where the score is positive, else 0."""
    gain = F.when(score > 0, 1 / F.log2(rank + 1)).otherwise(0.0)
    return F.coalesce(F.avg(F.when(rank > 0, gain)), F.lit(float("nan")))


def normal_equations(rows: DataFrame, features: list[Column], target: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y with a constant feature last; one pass, and the driver gets (k + 1)(k + 2) / 2 + k + 1 numbers."""
    x = [*features, F.lit(1.0)]
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * target).alias(f"b{i}") for i in range(k)]
    row = rows.agg(*sums).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(k)])


def ridge(rows: DataFrame, features: list[Column], target: Column, alpha: float = 1.0) -> np.ndarray:
    """Ridge weights, the bias last and as penalised as the others."""
    a, b = normal_equations(rows, features, target)
    return np.linalg.solve(a + alpha * np.eye(len(b)), b)


def paired_stats(rows: DataFrame, diff: str, boots: int = 2000, seed: int = 0, ci: float = 0.95) -> DataFrame:
    """mean_diff, ci_low, ci_high, direction_consistency, n_pairs of paired differences; nan ones are dropped.

    The bootstrap draws by hash, so it is the same on any cluster and in any
    engine: draw k of all is the pair whose number is the first 60 bits of
    MD5("seed|k"), modulo n; n draws make a resample.
    """
    pairs = rows.filter(F.col(diff).isNotNull() & ~F.isnan(diff)).select(F.col(diff).cast("double").alias("x"))
    pairs = numbered(pairs, ["x"], "i")
    spark = rows.sparkSession
    n = pairs.count()
    mean = pairs.agg(F.avg("x")).first()[0]
    if n == 0:
        return spark.createDataFrame([(float("nan"),) * 4 + (0,)], "mean_diff double, ci_low double, ci_high double, direction_consistency double, n_pairs long")
    agree = pairs.filter(F.signum("x") == float(np.sign(mean))).count() / n
    low = high = mean
    if n > 1:
        draws = spark.range(boots * n).select(F.floor(F.col("id") / n).alias("b"), (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") % n).alias("i"))
        means = draws.join(pairs, "i").groupBy("b").agg(F.avg("x").alias("m"))
        tail = (1 - ci) / 2
        low, high = means.agg(F.percentile("m", F.lit(tail)), F.percentile("m", F.lit(1 - tail))).first()
    return spark.createDataFrame([(mean, low, high, agree, n)], "mean_diff double, ci_low double, ci_high double, direction_consistency double, n_pairs long")


def seed_diffs(rows: DataFrame) -> DataFrame:
    """Mean, spread and range of a data seed's differences over model seeds; rows: data_seed, diff."""
    known = rows.filter(F.col("diff").isNotNull() & ~F.isnan("diff") & (F.abs("diff") < float("inf")))
    return known.groupBy("data_seed").agg(
        F.count("*").alias("n_model_seeds"), F.avg("diff").alias("mean"), F.coalesce(F.stddev_samp("diff"), F.lit(0.0)).alias("std"), F.min("diff").alias("min"), F.max("diff").alias("max")
    )


def verdict(mean: Column, low: Column, high: Column, n: Column, higher_is_better: bool = True, epsilon: float = NULL_EPSILON) -> Column:
    lo, hi = (low, high) if higher_is_better else (-high, -low)
    return (
        F.when((n == 0) | mean.isNull() | F.isnan(mean), "INCONCLUSIVE").when(lo > 0, "PASS").when(hi < 0, "NEGATIVE").when(F.abs(mean) < epsilon, "NULL").otherwise("INCONCLUSIVE")
    )


def quantity_identity(rows: DataFrame) -> DataFrame:
    """produced = accepted + quarantined + rejected + dropped; rows: produced, accepted, quarantined, rejected."""
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("produced", "accepted", "quarantined", "rejected")])
    rest = F.col("produced") - F.col("accepted") - F.col("quarantined") - F.col("rejected")
    return total.withColumn("dropped", F.greatest(F.lit(0), rest).cast("long")).withColumn("ok", rest >= 0)


def utility(energy: Column, progress: Column, died: Column, violations: Column, side_effects: Column) -> Column:
    return energy + progress - 5 * died.cast("double") - 2 * violations - side_effects


def overall(passed: Column) -> Column:
    """AND of those that ran; false if none did."""
    return F.coalesce(F.bool_and(passed), F.lit(False))


def manifest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("episode_id").agg(
        F.count("*").alias("record_count"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.min_by("state_before_hash", "tick").alias("first_hash"), F.max_by("state_after_hash", "tick").alias("last_hash")
    )
