"""Grouped splits and the checks that nothing crosses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

#: The suffix of a branch's episode id (fixed by the naming convention).
BRANCH_SUFFIX = r"_cf_t[0-9]+_b[0-9]+$"

STRATEGIES = ("seed", "episode_family")


def family(episode_id: Column) -> Column:
    """The episode without a branch's suffix."""
    return F.regexp_replace(episode_id, BRANCH_SUFFIX, "")


def is_branch(episode_id: Column) -> Column:
    return episode_id.rlike(BRANCH_SUFFIX)


def group_key(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("seed").cast("string").alias("group_seed"), family(F.col("episode_id")).alias("family"))


def grouped_split(rows: DataFrame, seed_splits: DataFrame, strategy: str = "seed", strict: bool = True) -> DataFrame:
    """rows with the split of their seed; seed_splits: seed, split, one row per seed. A seed without a split fails the query unless not strict, which drops its rows."""
    if strategy not in STRATEGIES:
        raise ValueError(f"split strategy {strategy!r} could part a group; use one of {STRATEGIES}")
    found = rows.join(seed_splits.select("seed", "split"), "seed", "left" if strict else "inner")
    if strict:
        message = F.concat(F.lit("no split for seed "), F.col("seed").cast("string"))
        found = found.withColumn("split", F.coalesce("split", F.raise_error(message).cast("string")))
    return found


def seed_map_split(episodes: DataFrame, seed_splits: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """An explicit split for each seed, and a ratio split by rank for the seeds that have none."""
    mapped = episodes.join(seed_splits.select("seed", F.col("split").alias("explicit")), "seed", "left")
    rest = numbered(mapped.filter("explicit is null").select("seed").distinct(), ["seed"], "__g")
    n = rest.count()
    n_train = max(1, round(n * train))
    n_val = max(1, round(n * val)) if n - n_train > 1 else 0
    rank = F.when(F.col("__g") < n_train, "train").when(F.col("__g") < n_train + n_val, "val").otherwise("test")
    return mapped.join(rest.select("seed", rank.alias("ranked")), "seed", "left").withColumn("split", F.coalesce("explicit", "ranked")).drop("explicit", "ranked")


def crossings(rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(kind, key, splits) of keys that appear in more than one split. All kinds go through one grouping; a null key is none."""
    keys = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")) for kind, key in kinds.items()]))
    long = rows.select("split", keys.alias("k")).select("split", "k.kind", "k.key").filter("key is not null").distinct()
    found = long.groupBy("kind", "key").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    return found.filter(F.size("splits") > 1)


def leakage(splits: DataFrame, episodes: DataFrame, kinds: tuple[str, ...] = ("seed", "scenario", "world_param", "branch_group")) -> DataFrame:
    """Episode keys that cross splits; splits: episode_id, split. Episodes without metadata don't count."""
    columns = {"seed": "seed", "scenario": "scenario_id", "world_param": "world_parameters_hash", "branch_group": "branch_group_id"}
    rows = splits.select("episode_id", "split").join(episodes, "episode_id")
    found = crossings(rows, {k: F.col(columns[k]) for k in kinds})
    return found.withColumn("description", F.concat("kind", F.lit(" "), "key", F.lit(" appears in splits "), F.array_join("splits", ", ")))


def leakage_report(found: DataFrame, checked: tuple[str, ...]) -> DataFrame:
    """One row: ok, violation_count, by_kind, checked_kinds."""
    counts = found.groupBy("kind").count()
    return counts.agg(
        (F.coalesce(F.sum("count"), F.lit(0)) == 0).alias("ok"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("violation_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "count")))).alias("by_kind"),
        F.array(*map(F.lit, checked)).alias("checked_kinds"),
    )


def group_leakage(rows: DataFrame) -> DataFrame:
    """Seeds, families and fork points that cross splits."""
    keyed = group_key(rows)
    fork = F.concat_ws("|", "group_seed", F.col("tick").cast("string"), "state_before_hash")
    return crossings(keyed, {"seed": F.col("group_seed"), "family": F.col("family"), "fork": fork})


def sibling_leakage(rows: DataFrame) -> DataFrame:
    """Families whose parent and branches cross splits."""
    return crossings(group_key(rows), {"family": F.col("family")})
