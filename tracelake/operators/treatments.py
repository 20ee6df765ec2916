"""Training treatments from the same transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .predicates import is_counterfactual
from .windows import first_share


def downsample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n rows, chosen by a hash of the seed and the row's key, so that the choice doesn't depend on partitioning."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "episode_id", F.col("tick").cast("string")).cast("binary"), 256)
    return numbered(rows, [order, "episode_id", "tick"], "__i").filter(F.col("__i") < n).drop("__i")


def build(main: DataFrame, random: DataFrame, small_share: float = 0.25, match_seed: int = 20260729) -> dict[str, DataFrame]:
    """The five treatments by name. D_matched has as many rows as C_transition; a branch in the random set fails the query."""
    branch = is_counterfactual(F.col("policy_id"), F.col("episode_id"))
    c = main.filter(~branch)
    checked = random.withColumn("episode_id", F.when(branch, F.raise_error(F.concat(F.lit("branch in the random set: "), "episode_id")).cast("string")).otherwise(F.col("episode_id")))
    return {"A_small": first_share(c, small_share), "B_random": checked, "C_transition": c, "D_counterfactual": main, "D_matched": downsample(main, c.count(), match_seed)}
