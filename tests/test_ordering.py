"""Global orders against the same over one window."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators.ordering import numbered, running, runs


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_numbers_and_runs(spark, n):
    rng = random.Random(n)
    rows = spark.createDataFrame([(i, rng.choice(["a", "a", "b", None])) for i in range(n)], "i int, k string").repartition(3)
    assert sorted((r.i, r.x) for r in numbered(rows, ["i"], "x").collect()) == [(i, i) for i in range(n)]
    w = Window.orderBy("i")
    new = F.when(F.col("k").isNull() | F.lag("k").over(w).isNull() | (F.lag("k").over(w) != F.col("k")), 1).otherwise(0)
    expected = rows.withColumn("n", new).withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    assert sorted((r.i, r.run) for r in runs(rows, "k", ["i"]).collect()) == sorted((r.i, r.run) for r in expected.collect())


@pytest.mark.parametrize("sizes", [[], [1], [400], [5, 300, 1, 1, 90], [3] * 60])
def test_running_sums_of_groups_that_span_ranges(spark, sizes):
    rows = [(g, i, (g * 31 + i * 17) % 23 - 11) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(3)
    found = running(df, ["g"], ["i"], {"v": "s"}, "n")
    w = Window.partitionBy("g").orderBy("i")
    expected = df.withColumn("n", F.row_number().over(w) - 1).withColumn("s", F.sum("v").over(w))
    columns = ["g", "i", "v", "n", "s"]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(tuple(r[c] for c in columns) for r in expected.collect())
