"""Baseline models: fitting is a grouped aggregate, predicting a join or an expression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import ridge


class Persistence:
    """Nothing changes."""

    def __init__(self, targets: Sequence[str]):
        self.targets = targets

    def fit(self, rows: DataFrame) -> Persistence:
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", *[F.lit(0.0).alias(f"pred_{t}") for t in self.targets])


class MeanDelta:
    """The training mean of a row's keys, the global mean for keys not seen."""

    def __init__(self, keys: Sequence[str], targets: Sequence[str]):
        self.keys, self.targets = list(keys), list(targets)

    def fit(self, rows: DataFrame) -> MeanDelta:
        self.means = rows.groupBy(*self.keys).agg(*[F.avg(t).alias(f"__{t}") for t in self.targets])
        self.overall = rows.agg(*[F.coalesce(F.avg(t), F.lit(0.0)).alias(t) for t in self.targets]).first().asDict()
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        found = rows.join(self.means, self.keys, "left")
        return found.select(*rows.columns, *[F.coalesce(f"__{t}", F.lit(self.overall[t])).alias(f"pred_{t}") for t in self.targets])


class Ridge:
    """Linear regression with penalised weights and bias; clipped targets are rounded half to even."""

    def __init__(self, features: Sequence[Column], target: str, alpha: float = 1.0, clip: tuple[float, float] | None = None):
        self.features, self.target, self.alpha, self.clip = list(features), target, alpha, clip

    def fit(self, rows: DataFrame) -> Ridge:
        self.weights = ridge(rows, self.features, F.col(self.target).cast("double"), self.alpha)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        value = F.lit(float(self.weights[-1]))
        for w, x in zip(self.weights[:-1], self.features, strict=True):
            value = value + F.lit(float(w)) * x
        if self.clip:
            value = F.greatest(F.lit(self.clip[0]), F.least(F.lit(self.clip[1]), F.rint(value)))
        return rows.withColumn(f"pred_{self.target}", value)


class Boosted:
    """Gradient-boosted trees of Spark's ML library, in place of another library's."""

    def __init__(self, features: Sequence[str], target: str, trees: int = 20, depth: int = 4, seed: int = 42):
        self.features, self.target, self.trees, self.depth, self.seed = list(features), target, trees, depth, seed

    def _assembled(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="__x").transform(rows)

    def fit(self, rows: DataFrame) -> Boosted:
        from pyspark.ml.regression import GBTRegressor

        self.model = GBTRegressor(featuresCol="__x", labelCol=self.target, predictionCol=f"pred_{self.target}", maxIter=self.trees, maxDepth=self.depth, seed=self.seed).fit(self._assembled(rows))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self._assembled(rows)).drop("__x")


class WithoutAction:
    """A model that doesn't see the action."""

    def __init__(self, base, action: str, neutral: object):
        self.base, self.action, self.neutral = base, action, neutral

    def _blind(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__action", F.col(self.action)).withColumn(self.action, F.lit(self.neutral))

    def fit(self, rows: DataFrame) -> WithoutAction:
        self.base.fit(self._blind(rows))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.base.predict(self._blind(rows)).drop(self.action).withColumnRenamed("__action", self.action)


class ShuffledAction(WithoutAction):
    """A model that sees another row's action: rows are numbered twice by hash and joined by number, which permutes the column."""

    def __init__(self, base, action: str, key: Sequence[str], seed: int = 42):
        super().__init__(base, action, None)
        self.key, self.seed = list(key), seed

    def _blind(self, rows: DataFrame) -> DataFrame:
        return permuted(rows, self.action, self.key, self.seed)


def permuted(rows: DataFrame, column: str, key: Sequence[str], seed: int) -> DataFrame:
    """rows with a column's values dealt anew; the old ones are in __action. Rows are numbered in two orders by hash of the
    key, over ranges, and a row gets the value of the row that has its number in the other order."""
    from .ordering import numbered

    def order(part: DataFrame, n: int, name: str) -> DataFrame:
        hashed = part.withColumn("__h", F.xxhash64(F.lit(seed + n), *key))
        return numbered(hashed, ["__h", *key], name).drop("__h")

    a = order(rows, 1, "__n").withColumnRenamed(column, "__action")
    b = order(rows.select(*key, F.col(column).alias("__value")), 2, "__n").select("__n", F.col("__value").alias(column))
    return a.join(b, "__n").drop("__n")


class Oracle:
    """The training row of the same state, action and agent if there is one (the last wins), else a base model."""

    def __init__(self, base, keys: Sequence[str], targets: Sequence[str], order: str):
        self.base, self.keys, self.targets, self.order = base, list(keys), list(targets), order

    def fit(self, rows: DataFrame) -> Oracle:
        self.base.fit(rows)
        self.known = rows.groupBy(*self.keys).agg(*[F.max_by(t, self.order).alias(f"__{t}") for t in self.targets])
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        found = self.base.predict(rows).join(self.known, self.keys, "left")
        for t in self.targets:
            found = found.withColumn(f"pred_{t}", F.coalesce(F.col(f"__{t}").cast("double"), f"pred_{t}")).drop(f"__{t}")
        return found


def errors(rows: DataFrame, target: str) -> np.ndarray:
    """(mae, n)"""
    r = rows.agg(F.avg(F.abs(F.col(target) - F.col(f"pred_{target}"))), F.count("*")).first()
    return np.array([r[0] if r[0] is not None else np.nan, r[1]])
