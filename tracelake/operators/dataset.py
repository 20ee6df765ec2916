"""From a specification to a checked dataset: rollouts, splits, branches, gates and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import staged
from ..sources import sinks
from ..sources import spec as specs
from . import counterfactual, grouping, joins, quality, records, simulate, splits
from .policies import BUILT_IN


@dataclass(frozen=True)
class Config:
    ticks: int = 100
    train: float = 0.8
    val: float = 0.1
    branch_every: int = 5
    branches: int = 2
    replayed: int = 5
    baseline: str = "scripted"
    horizon: int = 5


@dataclass
class Dataset:
    steps: DataFrame  # flat transitions with their split
    branches: DataFrame
    episodes: DataFrame
    leakage: DataFrame
    gates: DataFrame
    manifest: DataFrame
    spec: Mapping


def nested(steps: DataFrame, caps: Mapping) -> DataFrame:
    """Records of simulated steps, with the world's capabilities."""
    flat = steps.select(
        "episode_id", "seed", "tick", "agent_id", "action_type", "policy_id", "outcome_code", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("energy_before"),
        (F.col("realized_delta") * 100).cast("long").alias("energy_after"), "state_before_hash", "state_after_hash",
    )
    found = records.records(flat)
    flags = [F.lit(caps[f.name]).alias(f.name) for f in records.CAPABILITY.fields]
    return found.withColumn("capability_profile", F.struct(*flags).cast(records.CAPABILITY))


def build(spark: SparkSession, data: Mapping, seeds: DataFrame, config: Config = Config(), policies: Mapping[str, Callable] | None = None) -> Dataset:  # noqa: B008
    """Everything a run makes. Steps are simulated once and staged; all else reads them."""
    compiled = specs.compile_spec(data)
    params = specs.params_hash(compiled)
    policies = policies or BUILT_IN
    steps = staged(simulate.rollout(spark, compiled, seeds, config.ticks, policies), "steps")
    cf = staged(simulate.branch(steps, compiled, config.branch_every, config.branches), "branches")
    episodes = steps.groupBy("episode_id", "seed").agg(F.count("*").alias("records"))
    episodes = episodes.select("episode_id", "seed", "records", F.lit(data["scenario"]["scenario_id"]).alias("scenario_id"), F.lit(params).alias("world_parameters_hash"), F.lit(None).cast("string").alias("branch_group_id"))
    none = episodes.limit(0).select("seed", F.lit("").alias("split"))
    split = staged(splits.seed_map_split(episodes, none, config.train, config.val), "splits")
    steps = steps.join(split.select("episode_id", "split"), "episode_id")

    found = splits.leakage(split.select("episode_id", "split"), episodes, ("seed",))
    report = splits.leakage_report(found, ("seed",))
    recs = nested(steps, specs.capabilities(compiled))
    counts = grouping.coverage(steps, {"policy": F.col("policy_id"), "action_type": F.col("action_type"), "outcome_code": F.col("outcome_code")})
    forks = steps.join(cf.filter("error is null").select("seed", "tick").distinct(), ["seed", "tick"], "left_semi").select("seed", "tick", "state_before_hash")
    groups = forks.unionByName(cf.filter("error is null").select("seed", "tick", "state_before_hash")).withColumn("energy_before", F.lit(0))
    outcomes = simulate.matched_utilities(spark, compiled, seeds, policies, config.baseline, config.horizon)
    total = steps.agg(F.count("*").alias("produced"), F.count("*").alias("accepted"), F.lit(0).alias("quarantined"), F.lit(0).alias("rejected"))
    gates = quality.report(
        quality.q0_schema(recs), quality.q1_traceability(recs), quality.q2_structure(recs), quality.q3_replay(simulate.replay(steps, compiled, config.replayed)),
        quality.q4_provenance(recs, split.select("episode_id", F.col("records").alias("record_count"))), quality.q5_leakage(report, steps.select("split", "episode_id", "seed")),
        quality.q6_coverage(grouping.coverage_gaps(counts, counts)), quality.q7_counterfactual(counterfactual.held_fixed_counts(groups)), quality.q8_quantity(grouping.quantity_identity(total)),
        quality.q9_utility(simulate.compare_policies(outcomes, config.baseline)),
    )
    return Dataset(steps, cf, split, found, gates, sinks.dataset_manifest(steps, data["scenario"]["scenario_id"], params), compiled)


def write(dataset: Dataset, path: str) -> None:
    """Steps by split with a manifest of each split, branches, episodes, the split of every episode, gates, leakage, the
    manifest, the documents that describe a dataset (schema, capabilities, world parameters) and its card."""
    spark = dataset.steps.sparkSession
    dataset.steps.write.mode("overwrite").partitionBy("split").parquet(f"{path}/transitions")
    dataset.branches.write.mode("overwrite").parquet(f"{path}/branches")
    for name in ("episodes", "leakage", "gates", "manifest"):
        getattr(dataset, name).write.mode("overwrite").json(f"{path}/{name}")
    sinks.write_splits(dataset.episodes, f"{path}/splits")
    sinks.split_manifest(dataset.steps).write.mode("overwrite").partitionBy("split").json(f"{path}/split_manifests")
    documents = {"schema": json.loads(sinks.schema_snapshot(dataset.steps)), "capabilities": specs.capabilities(dataset.spec), "world_parameters": specs.parameters(dataset.spec)}
    sinks.write_documents(spark, documents, f"{path}/documents")
    manifest = {k: v for k, v in dataset.manifest.first().asDict(True).items()}
    card = sinks.dataset_card(manifest, [r.asDict() for r in dataset.gates.collect()])
    spark.createDataFrame([(card,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def undeclared_policies(steps: DataFrame, declared: DataFrame) -> DataFrame:
    """Policies in the data that a report (policy_id) doesn't name."""
    return steps.select(F.col("policy_id")).distinct().join(declared, "policy_id", "left_anti")


def record_closure(steps: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes of the data that no split declares."""
    return joins.undeclared(steps.select("episode_id").distinct(), episodes.select("episode_id"))
