"""Queries of single functions that larger queries use: receipts, energy changes, splits, places in a block, scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features as X
from ..operators import grouping as G
from ..operators import joins as J
from ..operators import predicates as P
from ..operators import records as R
from ..operators import splits as S
from ..operators import telemetry as M
from ..registry import query, table
from ..scratch import scratch
from ..sources import files
from ..trajectory import CF, EP, TR, episodes, split_of, transitions, with_branches
from .tables import ATTEMPTS, attempts

#: Three changes of a tick: the agent's energy twice, unless it is removed, and another agent's.
TWICE = "CASE WHEN tick % 3 = 0 THEN 0 ELSE d END"


def _changes(rows):
    one = lambda kind, who, after: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), who.alias("entity_id"), F.lit("energy").alias("column"), F.lit(0.0).alias("before"), after.cast("double").alias("after"))
    kind = F.when(F.col("tick") % 3 == 0, "remove").otherwise("update")
    return rows.withColumn("changes", F.array(one("update", F.lit("e9"), F.col("tick")), one(kind, F.col("agent_id"), F.col("d")), one("update", F.col("agent_id"), F.col("seed"))).cast(T.ArrayType(R.CHANGE)))


@query("pf3_receipt", f"WITH {TR} SELECT episode_id, tick, outcome_code, CASE WHEN agent_id = 'e1' THEN d / 100.0 END AS of_e1 FROM tr")
def receipt(spark, sf_dir):
    """An agent's receipt of a record, none for an agent that did nothing."""
    rows = R.records(transitions(spark, sf_dir))
    own = P.receipt_of(F.col("receipts"), P.first_agent(F.col("executed_actions")))
    return rows.select(F.col("provenance.episode_id").alias("episode_id"), "tick", own["outcome_code"].alias("outcome_code"), P.receipt_of(F.col("receipts"), F.lit("e1"))["energy_delta"].alias("of_e1"))


@query("pf7_first_change", f"WITH {TR} SELECT episode_id, tick, CAST(CASE WHEN tick % 3 = 0 THEN seed ELSE d END AS DOUBLE) AS change FROM tr")
def first_change(spark, sf_dir):
    return _changes(transitions(spark, sf_dir)).select("episode_id", "tick", P.first_energy_change(F.col("changes"), F.col("agent_id")).alias("change"))


@query("pf8_total_change", f"WITH {TR} SELECT episode_id, tick, CAST({TWICE} + seed AS DOUBLE) AS change, CAST(0 AS DOUBLE) AS of_nobody FROM tr")
def total_change(spark, sf_dir):
    rows = _changes(transitions(spark, sf_dir))
    return rows.select("episode_id", "tick", P.total_energy_change(F.col("changes"), F.col("agent_id")).alias("change"), P.total_energy_change(F.col("changes"), F.lit("nobody")).alias("of_nobody"))


@query("pf4_edge_changes", f"WITH {TR} SELECT episode_id, tick, CAST(CASE WHEN tick % 5 = 0 THEN 0 ELSE tick % 4 END AS INTEGER) AS n FROM tr")
def edge_changes(spark, sf_dir):
    """None where a record has no relation changes at all."""
    changes = F.when(F.col("tick") % 5 != 0, F.array_repeat(F.lit("x"), (F.col("tick") % 4).cast("int")))
    return transitions(spark, sf_dir).select("episode_id", "tick", P.edge_change_count(changes).alias("n"))


@query("pf9_known_splits", f"WITH {EP} SELECT tr.episode_id, tick, split FROM tr JOIN ep USING (episode_id) WHERE ep.seed % 4 <> 0")
def known_splits(spark, sf_dir):
    """Rows of other splits than the three are dropped."""
    rows = transitions(spark, sf_dir)
    splits = episodes(rows).select("episode_id", F.when(F.col("seed") % 4 == 0, "holdout").otherwise(split_of(F.col("seed"))).alias("split"))
    return J.with_split(rows, splits).select("episode_id", "tick", "split")


@query("dp4_grouped_split", f"WITH {CF}, s AS (SELECT DISTINCT seed, CASE seed % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM tr WHERE seed % 6 <> 5) SELECT episode_id, tick, split FROM both_rows JOIN s USING (seed)")
def grouped_split(spark, sf_dir):
    """Branches go with their parent's seed; seeds without a split are dropped, as asked."""
    rows = with_branches(transitions(spark, sf_dir))
    seeds = rows.filter("seed % 6 <> 5").select("seed", split_of(F.col("seed")).alias("split")).distinct()
    return S.grouped_split(rows, seeds, strict=False).select("episode_id", "tick", "split")


@query("dp20_evidence_batch", f"WITH {ATTEMPTS} SELECT 'evidence' AS tier, avg(CAST(final_origin = 'fallback' AS INTEGER)) AS fallback_rate, 0.0::DOUBLE AS fallback_rate_max, avg(CAST(final_origin = 'fallback' AS INTEGER)) <= 0 AS ok, count(*) FILTER (requested_backend = 'real' AND (effective_backend <> 'real' OR mock_calls > 0 OR auth_error OR final_origin = 'fallback')) AS violations FROM de")
def evidence_batch(spark, sf_dir):
    found = M.decisions(attempts(spark, sf_dir))
    bad = found.agg(F.count(M.evidence_violation("evidence")).alias("violations"))
    return M.fallback_gate(found, "evidence").join(bad, F.lit(True)).withColumn("tier", F.lit("evidence"))


@query("f22_one_hot", f"WITH {TR} SELECT episode_id, tick, array_to_string(list_transform(range(5), lambda i: CASE WHEN i = tick % 7 THEN '1' ELSE '0' END), '') AS hot FROM tr")
def one_hot(spark, sf_dir):
    """Zeros alone for an index out of range."""
    hot = F.transform(X.one_hot(F.col("tick") % 7, 5), lambda x: x.cast("int").cast("string"))
    return transitions(spark, sf_dir).select("episode_id", "tick", F.array_join(hot, "").alias("hot"))


@query("sl7_place_in_block", f"WITH {TR} SELECT episode_id, tick, tick % 5 AS place FROM tr")
def place_in_block(spark, sf_dir):
    return transitions(spark, sf_dir).select("episode_id", "tick", X.arg_max(X.one_hot(F.col("tick") % 5, 6)).alias("place"))


@query("sl4_members", f"WITH {CF} SELECT seed, tick, string_agg(episode_id, '|' ORDER BY episode_id) AS members FROM both_rows WHERE tick > 0 AND tick % 5 = 0 GROUP BY seed, tick")
def members(spark, sf_dir):
    """Of each fork point, its members by episode."""
    from ..operators.ranking import groups

    found = groups(with_branches(transitions(spark, sf_dir)).withColumn("state_before_hash", F.lit("one")))
    return found.select("seed", "tick", F.array_join("members", "|").alias("members"))


@query("ag14_accuracy", f"WITH {TR} SELECT seed, avg(CASE WHEN round_even(d / 200.0, 0) = round_even((d + tick) / 200.0, 0) THEN 1.0 ELSE 0.0 END) AS accuracy FROM tr GROUP BY seed")
def accuracy(spark, sf_dir):
    return transitions(spark, sf_dir).groupBy("seed").agg(G.accuracy(F.col("d") / 200.0, (F.col("d") + F.col("tick")) / 200.0).alias("accuracy"))


@query("ag15_ndcg", f"WITH {TR} SELECT seed, avg(CASE WHEN event_id % 4 > 0 THEN CASE WHEN d % 2 = 1 THEN 1 / log2(event_id % 4 + 1) ELSE 0 END END) AS ndcg FROM tr GROUP BY seed HAVING count(*) FILTER (event_id % 4 > 0) > 0")
def ndcg(spark, sf_dir):
    found = transitions(spark, sf_dir).groupBy("seed").agg(G.ndcg_proxy(F.col("event_id") % 4, F.col("d") % 2).alias("ndcg"))
    return found.filter(~F.isnan("ndcg"))


@query("f17_text_order", f"WITH {TR} SELECT seed, array_to_string(list_sort(list(DISTINCT CAST(event_id % 40 AS VARCHAR))), ',') AS ids FROM tr GROUP BY seed")
def text_order(spark, sf_dir):
    """Ids in the order of their texts, where 10 comes before 9."""
    return transitions(spark, sf_dir).groupBy("seed").agg(F.array_join(F.array_sort(F.collect_set((F.col("event_id") % 40).cast("string"))), ",").alias("ids"))


@query("sc1_blank_lines", f"WITH {TR} SELECT episode_id, tick FROM tr")
def blank_lines(spark, sf_dir):
    """Blank lines between records are none."""
    text = F.to_json(F.struct(F.col("tick"), F.struct("episode_id").alias("provenance")))
    path = scratch(spark, "blank-lines")
    transitions(spark, sf_dir).select(F.concat(F.when(F.col("tick") % 2 == 0, "\n  \n").otherwise(""), text).alias("value")).write.text(path)
    return files.json_lines(spark, path).select(F.col("provenance.episode_id").alias("episode_id"), "tick")


@query("sc9_first_record", "SELECT min(o_orderkey) AS tick, 'e1' AS episode_id FROM orders WHERE o_orderkey % 3 = 1")
def first_record(spark, sf_dir):
    """By split, then episode, then tick: training rows of e1 before those of e2, and both before validation rows."""
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("e"), (F.col("o_orderkey") % 3).cast("string")).alias("episode_id"), F.col("o_orderkey").alias("tick"))
    return files.first_record(rows).select("episode_id", "tick")
