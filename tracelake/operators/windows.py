"""Ordered operators over episodes.

All partition by the episode and order by the tick, so one shuffle serves
any chain of them. What needs an order over all episodes is in ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered, runs  # noqa: F401


def by_tick(episode: str = "episode_id", tick: str = "tick"):
    return Window.partitionBy(episode).orderBy(tick)


def chain_links(rows: DataFrame) -> DataFrame:
    """link_ok: whether a row's state after is the next row's state before; null on the last tick."""
    following = F.lead("state_before_hash").over(by_tick())
    return rows.withColumn("link_ok", F.when(following.isNotNull(), F.col("state_after_hash") == following))


def duplicate_ticks(rows: DataFrame) -> DataFrame:
    """Occurrences beyond the first of each tick, by episode."""
    per_tick = rows.groupBy("episode_id", "tick").count()
    return per_tick.groupBy("episode_id").agg(F.sum(F.col("count") - 1).alias("duplicate_ticks"))


def horizon(rows: DataFrame, value: str, steps: int = 3, out: str = "horizon") -> DataFrame:
    """The sum of the next steps' values, 0 at the end."""
    return rows.withColumn(out, F.coalesce(F.sum(value).over(by_tick().rowsBetween(1, steps)), F.lit(0)))


def first_share(rows: DataFrame, share: float) -> DataFrame:
    """The first ceil(share * n) ticks of each episode, one at least."""
    if not 0 < share <= 1:
        raise ValueError(f"a share is in (0, 1], not {share}")
    n = F.count("*").over(Window.partitionBy("episode_id"))
    return rows.withColumn("__i", F.row_number().over(by_tick())).withColumn("__n", n).filter(F.col("__i") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("__n")))).drop("__i", "__n")


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of each episode (a ranking filter that Spark applies before the shuffle as well)."""
    return rows.withColumn("__i", F.row_number().over(by_tick())).filter(F.col("__i") <= n).drop("__i")


def alternatives(rows: DataFrame, k: int, kind: str = "action_type", order: str = "episode_id") -> DataFrame:
    """The first representative of each distinct alternative at a fork, and of those the first k."""
    fork = ["seed", "tick", "state_before_hash"]
    first = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*fork, kind).orderBy(order))).filter("__i = 1").drop("__i")
    return first.withColumn("alternative", F.row_number().over(Window.partitionBy(*fork).orderBy(order))).filter(F.col("alternative") <= k)


def round_robin(rows: DataFrame, choices: int, out: str = "choice") -> DataFrame:
    """The choice that a cursor running over the episode's rows would make."""
    return rows.withColumn(out, F.pmod(F.row_number().over(by_tick()) - 1, F.lit(choices)))


def ratio_split(rows: DataFrame, group: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """A split for each group by its place: at least one group to train, counts rounded half to even, the rest to test."""
    groups = numbered(rows.select(group).distinct(), [group], "__g")
    n = groups.count()
    n_train = max(1, round(n * train))
    n_val = max(1, round(n * val)) if n - n_train > 1 else 0
    split = F.when(F.col("__g") < n_train, "train").when(F.col("__g") < n_train + n_val, "val").otherwise("test")
    return rows.join(groups.select(group, split.alias("split")), group)


def carried(rows: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """The last known value up to a tick: what replaying set-valued changes gives."""
    w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def floored_energy(rows: DataFrame, delta: str, start: int | Column, out: str = "energy") -> DataFrame:
    """Energy that never falls below zero, in closed form: the running sum less its lowest excursion below zero."""
    w = by_tick().rowsBetween(Window.unboundedPreceding, 0)
    start = F.lit(start) if isinstance(start, int) else start
    rows = rows.withColumn("__s", start + F.sum(delta).over(w))
    return rows.withColumn(out, F.col("__s") - F.least(F.lit(0), F.min("__s").over(w))).drop("__s")


def position(rows: DataFrame, step: str, size: int, start: int = 0, out: str = "position") -> DataFrame:
    """Position on a ring."""
    w = by_tick().rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.pmod(F.lit(start) + F.sum(step).over(w), F.lit(size)))


def schedule(rows: DataFrame, every: int) -> DataFrame:
    """The ticks at which branches start."""
    return rows.filter((F.col("tick") > 0) & (F.col("tick") % every == 0))


def cumulative(rows: DataFrame, values: list[str]) -> DataFrame:
    w = by_tick().rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.sum(v).over(w).alias(f"cumulative_{v}") for v in values])


def top_prediction(rows: DataFrame, keys: list[str], prediction: str, order: str) -> DataFrame:
    """The row with the largest prediction; on ties the first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(prediction), order)
    return rows.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i")
