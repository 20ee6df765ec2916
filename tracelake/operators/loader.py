"""Samples for training: records, their split, their targets, their outcome and the outcome of the steps that follow, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import with_split
from .ranking import attach_outcomes
from .records import samples
from .windows import horizon


def load(records: DataFrame, splits: DataFrame, outcomes: DataFrame | None = None, steps: int = 3, split: str | None = None) -> DataFrame:
    """One row for each record of a declared split with an executed agent.

    splits: episode_id, split; outcomes: episode_id, tick, outcome (0 where
    there is none). horizon sums energy_delta over the next steps within the
    split's episode. One shuffle on the episode serves split and horizon.
    """
    rows = with_split(samples(records), splits)
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    rows = horizon(rows.withColumn("__d", F.col("energy_delta")), "__d", steps).drop("__d")
    return rows if outcomes is None else rows.join(attach_outcomes(rows.select("episode_id", "tick"), outcomes), ["episode_id", "tick"])
