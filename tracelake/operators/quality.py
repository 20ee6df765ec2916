"""Quality gates Q0 to Q9: each is one aggregate over the records, and gives key, status and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import records as R
from .splits import crossings

GATE = "key string, name string, status string, evidence string"

NAMES = {
    "Q0": "Schema", "Q1": "Traceability", "Q2": "Structural Delta-Capability Consistency", "Q3": "Replay", "Q4": "Provenance",
    "Q5": "Leakage", "Q6": "Coverage", "Q7": "Counterfactual", "Q8": "Quantity Identity", "Q9": "Utility",
}


def _gate(rows: DataFrame, key: str, ok: Column, evidence: Column) -> DataFrame:
    return rows.select(F.lit(key).alias("key"), F.lit(NAMES[key]).alias("name"), F.when(ok, "pass").otherwise("fail").alias("status"), evidence.alias("evidence"))


def skipped(spark, key: str, why: str) -> DataFrame:
    return spark.createDataFrame([(key, NAMES[key], "skipped", why)], GATE)


def _say(text: str, *columns: str) -> Column:
    return F.format_string(text, *[F.col(c) for c in columns])


def q0_schema(rows: DataFrame) -> DataFrame:
    found = rows.agg(F.count("*").alias("n"), F.count_if(R.valid_schema()).alias("valid"))
    return _gate(found, "Q0", (F.col("n") > 0) & (F.col("valid") == F.col("n")), _say("%d/%d records schema-valid", "valid", "n"))


def traceability(rows: DataFrame) -> DataFrame:
    """One row of the counts behind Q1. Hash chains and repeated ticks share one shuffle on the episode."""
    episode = F.coalesce("provenance.episode_id", F.lit(""))
    w = Window.partitionBy("__ep").orderBy("tick", "state_before_hash")
    actions = F.map_values("executed_actions")
    orphan = F.filter(F.map_keys("executed_actions"), lambda a: ~F.coalesce(F.map_contains_key("candidate_actions", a), F.lit(False)))
    mismatch = F.filter(actions, lambda e: F.coalesce(F.map_contains_key("candidate_actions", e["agent_id"]), F.lit(False)) & ~F.coalesce(R.proposal_hash(F.try_element_at("candidate_actions", e["agent_id"])) == e["proposal_hash"], F.lit(False)))
    marked = rows.withColumn("__ep", episode)
    marked = marked.select(
        "__ep", "tick", (F.array_sort(F.map_keys("executed_actions")) == F.array_sort(F.map_keys("receipts"))).alias("matched"), F.size(orphan).alias("orphans"), F.size(mismatch).alias("mismatches"), "state_before_hash", "state_after_hash"
    )
    following = F.lead("state_before_hash").over(w)
    last = F.lead("tick").over(w).isNull()
    again = F.coalesce(F.lag("tick").over(w) == F.col("tick"), F.lit(False))
    marked = marked.withColumn("link", F.when(~last, F.coalesce(F.col("state_after_hash") == following, F.lit(False)))).withColumn("again", again)
    return marked.agg(
        F.count("*").alias("n"), F.count("link").alias("links"), F.count_if("link").alias("valid_links"), F.count_if(F.coalesce("matched", F.lit(False))).alias("matched"), F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphans"),
        F.coalesce(F.sum("mismatches"), F.lit(0)).alias("mismatches"), F.count_if("again").alias("repeated_ticks"), F.count_if(F.col("__ep") == "").alias("without_episode"),
    )


def q1_traceability(rows: DataFrame) -> DataFrame:
    found = traceability(rows)
    ok = (F.col("n") > 0) & (F.col("links") == F.col("valid_links")) & (F.col("matched") == F.col("n"))
    for c in ("orphans", "mismatches", "repeated_ticks", "without_episode"):
        ok = ok & (F.col(c) == 0)
    text = "%d records, %d/%d hash-chain links valid, %d exec/receipt keys match, %d orphans, %d proposal hash mismatches, %d repeated ticks, %d without episode"
    return _gate(found, "Q1", ok, _say(text, "n", "valid_links", "links", "matched", "orphans", "mismatches", "repeated_ticks", "without_episode"))


def q2_structure(rows: DataFrame) -> DataFrame:
    found = rows.agg(F.count("*").alias("n"), F.count_if(R.delta_consistent()).alias("consistent"), F.count(R.meta_tick_ok()).alias("meta"), F.count_if(R.meta_tick_ok()).alias("meta_ok"))
    ok = (F.col("n") > 0) & (F.col("consistent") == F.col("n")) & (F.col("meta") == F.col("meta_ok"))
    return _gate(found, "Q2", ok, _say("%d/%d delta-capability consistent, %d/%d ticks after valid", "consistent", "n", "meta_ok", "meta"))


def q3_replay(replayed: DataFrame) -> DataFrame:
    """From simulate.replay()."""
    found = replayed.agg(F.count("*").alias("n"), F.count_if("ok").alias("same"), F.count_if(~F.col("anchored")).alias("unanchored"))
    ok = (F.col("n") > 0) & (F.col("same") == F.col("n"))
    return _gate(found, "Q3", ok, _say("%d/%d records replay identically, %d episodes without their initial state", "same", "n", "unanchored"))


def q4_provenance(rows: DataFrame, splits: DataFrame | None = None, declared_total: int | None = None) -> DataFrame:
    """Complete provenance; with splits (episode_id, split, record_count) also declared episodes, totals and one seed for each episode."""
    found = rows.agg(F.count("*").alias("n"), F.count_if(R.provenance_complete()).alias("complete"))
    per = rows.groupBy(F.col("provenance.episode_id").alias("episode_id")).agg(F.count_distinct("provenance.seed").alias("seeds"), F.count("*").alias("records"))
    per = per.agg(F.count_if(F.col("seeds") > 1).alias("conflicts"))
    found = found.join(per, F.lit(True))
    if splits is None:
        found = found.withColumn("undeclared", F.lit(0)).withColumn("declared", F.col("n"))
    else:
        missing = rows.select(F.col("provenance.episode_id").alias("episode_id")).distinct().join(splits, "episode_id", "left_anti").agg(F.count("*").alias("undeclared"))
        total = splits.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("declared"))
        found = found.join(missing, F.lit(True)).join(total, F.lit(True))
    total_ok = F.lit(True) if declared_total is None else F.col("declared") == F.lit(declared_total)
    ok = (F.col("n") > 0) & (F.col("complete") == F.col("n")) & (F.col("conflicts") == 0) & (F.col("undeclared") == 0) & (F.col("declared") == F.col("n")) & total_ok
    return _gate(found, "Q4", ok, _say("%d/%d records have complete provenance, %d episodes with several seeds, %d undeclared, %d declared records", "complete", "n", "conflicts", "undeclared", "declared"))


def q5_leakage(report: DataFrame, rows: DataFrame) -> DataFrame:
    """report: one row of splits.leakage_report(); rows: split, episode_id, seed, from which disjointness is counted again."""
    again = crossings(rows, {"episode": F.col("episode_id"), "seed": F.col("seed")}).agg(F.count("*").alias("again"))
    found = report.join(again, F.lit(True))
    sums = F.aggregate(F.map_values("by_kind"), F.lit(0).cast("long"), lambda s, x: s + x)
    consistent = (F.col("ok") == (F.col("violation_count") == 0)) & (sums == F.col("violation_count"))
    vacuous = F.size("checked_kinds") == 0
    found = found.withColumn("consistent", consistent).withColumn("vacuous", vacuous)
    return _gate(found, "Q5", F.col("ok") & F.col("consistent") & ~F.col("vacuous") & (F.col("again") == 0), _say("%d violations reported, %d found again from the records", "violation_count", "again"))


def q6_coverage(gaps: DataFrame) -> DataFrame:
    """gaps: from grouping.coverage_gaps()."""
    found = gaps.agg(F.count("*").alias("n"))
    return _gate(found, "Q6", F.col("n") == 0, _say("%d keys with fewer counts in the report than in the data", "n"))


def q7_counterfactual(groups: DataFrame) -> DataFrame:
    """groups: branches, held_fixed by fork point."""
    found = groups.agg(F.count("*").alias("n"), F.count_if("held_fixed").alias("held"), F.coalesce(F.sum("branches"), F.lit(0)).alias("branches"))
    return _gate(found, "Q7", (F.col("n") > 0) & (F.col("n") == F.col("held")), _say("%d/%d fork points held fixed, %d branches", "held", "n", "branches"))


def q8_quantity(total: DataFrame) -> DataFrame:
    """total: from grouping.quantity_identity()."""
    return _gate(total, "Q8", F.col("ok") & (F.col("dropped") == 0), _say("produced %d = accepted %d + quarantined %d + rejected %d + dropped %d", "produced", "accepted", "quarantined", "rejected", "dropped"))


def q9_utility(comparisons: DataFrame, least: float = 1e-9) -> DataFrame:
    """comparisons: delta, matched. Some policy must beat the baseline in a matched comparison."""
    valid = F.col("matched") & F.col("delta").isNotNull() & ~F.isnan("delta")
    found = comparisons.agg(F.count_if(valid).alias("n"), F.max(F.when(valid, F.col("delta"))).alias("best"))
    return _gate(found, "Q9", F.coalesce(F.col("best") >= least, F.lit(False)), F.format_string("%d matched comparisons, best %.6f", F.col("n"), F.coalesce("best", F.lit(0.0))))


def report(*gates: DataFrame) -> DataFrame:
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def summary(gates: DataFrame) -> DataFrame:
    """Counts of statuses; skipped gates don't fail the report."""
    return gates.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "skipped")], (F.count_if(F.col("status") == "fail") == 0).alias("ok"))


def invariants(rows: DataFrame) -> DataFrame:
    """The seven transition invariants by record; null where one can't be judged."""
    w = Window.partitionBy("provenance.episode_id").orderBy("tick")
    previous = F.lag("state_after_hash").over(w)
    rules = R.schema_rules()
    return rows.select(
        F.col("provenance.episode_id").alias("episode_id"), "tick", rules["receipts_complete"].alias("receipts"), rules["outcome_codes"].alias("outcomes"), rules["grounded"].alias("authority"),
        R.delta_consistent().alias("capability"), R.meta_tick_ok().alias("tick_advances"), F.when(previous.isNotNull(), previous == F.col("state_before_hash")).alias("chain"),
        F.when(F.lag("tick").over(w).isNotNull(), F.col("tick") == F.lag("tick").over(w) + 1).alias("dense"),
    )
