"""Fork points, what a branch holds fixed, and divergence from the parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_fixed_counts(rows: DataFrame) -> DataFrame:
    """Branches by fork point, and whether all start from one state."""
    return rows.groupBy("seed", "tick").agg(F.count("*").alias("branches"), F.count_if(F.col("energy_before") >= 0).alias("same_state"), (F.count_distinct("state_before_hash") == 1).alias("held_fixed"))


def _nul_hash(parts: Column) -> Column:
    """SHA-256 over parts that are each followed by a NUL byte; empty for no parts."""
    text = F.concat(F.array_join(parts, "\0"), F.lit("\0"))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) == 0, "").otherwise(F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256)))


def fingerprint(entries: Column) -> Column:
    """Of a random-state bundle (map<string,string>): keys and values in key order, empty for an empty or null map."""
    return _nul_hash(F.flatten(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.array(e["key"], e["value"]))))


def action_sequence_hash(encoded: Column) -> Column:
    """Of an array of encoded actions in order; of none, that of nothing."""
    nothing = F.concat(F.lit("sha256:"), F.sha2(F.lit("").cast("binary"), 256))
    return F.when(F.size(encoded) == 0, nothing).otherwise(_nul_hash(encoded))


def non_focal_fingerprint(actions: Column, focal: Column) -> Column:
    """Of a joint action without the focal agent's: agents in text order with their encoded actions (map<string,string>)."""
    others = F.filter(F.array_sort(F.map_entries(actions)), lambda e: e["key"] != focal)
    return _nul_hash(F.flatten(F.transform(others, lambda e: F.array(e["key"], e["value"]))))


def checkpoint_checksum(schema_version: Column, world_id: Column, world_version: Column, tick: Column, state_hash: Column, payload: Column, codec: Column, rng: Column) -> Column:
    """Over a checkpoint's parts, NUL bytes between them; payload is binary, rng a map<string,string>."""
    nul = F.lit(b"\0")
    parts = []
    for part in (schema_version, world_id, world_version, tick.cast("string"), state_hash):
        parts += [part.cast("binary"), nul]
    parts += [payload, nul, codec.cast("binary")]
    bundle = F.transform(F.array_sort(F.map_entries(rng)), lambda e: F.concat(F.lit("\0"), e["key"], F.lit("\1"), e["value"]))
    parts.append(F.coalesce(F.array_join(bundle, ""), F.lit("")).cast("binary"))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*parts), 256))


def verify_held_fixed(parent: DataFrame, branch: DataFrame, columns: list[str]) -> DataFrame:
    """For each branch row, whether each column equals the parent's at the fork (both on seed and tick)."""
    p = parent.select("seed", "tick", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = branch.join(p, ["seed", "tick"], "left")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")).alias(f"{c}_fixed") for c in columns]
    out = joined.select("seed", "tick", "episode_id", *same)
    held = F.lit(True)
    for c in columns:
        held = held & F.col(f"{c}_fixed")
    return out.withColumn("held_fixed", held)


def divergence(parent: DataFrame, branch: DataFrame) -> DataFrame:
    """The first tick after the fork at which a branch's state hash differs from the parent's or has none to compare with.

    parent: seed, tick, hash; branch: seed, episode_id, fork_tick, offset, hash. The state after offset i is that of tick fork + 1 + i.
    """
    at = branch.withColumn("tick", F.col("fork_tick") + 1 + F.col("offset"))
    both = at.join(parent.select("seed", "tick", F.col("hash").alias("parent_hash")), ["seed", "tick"], "left")
    differs = F.col("parent_hash").isNull() | (F.col("parent_hash") != F.col("hash"))
    return both.groupBy("seed", "episode_id", "fork_tick").agg(F.min(F.when(differs, F.col("tick"))).alias("divergence_tick"))
