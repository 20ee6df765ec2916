"""Queries of gates, records, simulation, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import counterfactual as CFO
from ..operators import grouping as G
from ..operators import joins as J
from ..operators import policies as PO
from ..operators import predicates as P
from ..operators import quality as Q
from ..operators import records as R
from ..operators import simulate as SIM
from ..operators import splits as S
from ..registry import query, table
from ..scratch import scratch
from ..sources import environments as ENV
from ..sources import files, scenarios, sinks, spec
from ..streaming import log
from ..trajectory import EP, TR, episodes, split_of, transitions, with_branches


# -- records and gates ------------------------------------------------------
def moved(rows):
    """Rows with branches of which some start from another state."""
    other = (F.col("policy_id") == "counterfactual_branch") & (F.col("event_id") % 31 == 0)
    return rows.withColumn("state_before_hash", F.when(other, "sha256:moved").otherwise(F.col("state_before_hash")))


def flawed(rows):
    """Records with planted flaws, by event number: the negative controls of the gates."""
    rows = rows.withColumn("state_after_hash", F.when(F.col("event_id") % 101 == 7, "sha256:broken").otherwise(F.col("state_after_hash")))
    found = R.records(rows.withColumn("outcome_code", F.when(F.col("event_id") % 89 == 5, "exploded").otherwise(F.col("outcome_code"))))
    return found


@query("dp6_q0_schema", f"WITH {TR} SELECT 'Q0' AS key, 'fail' AS status, concat(count(*) FILTER (event_id % 89 <> 5), '/', count(*), ' records schema-valid') AS evidence FROM tr")
def q0(spark, sf_dir):
    return Q.q0_schema(flawed(transitions(spark, sf_dir))).select("key", "status", "evidence")


@query(
    "dp7_q1_traceability",
    f"""WITH {TR}, f AS (SELECT *, CASE WHEN event_id % 101 = 7 THEN 'x' ELSE state_after_hash END AS h, lead(state_before_hash) OVER (PARTITION BY episode_id ORDER BY tick) AS nxt FROM tr)
SELECT count(*) AS n, count(nxt) AS links, count(*) FILTER (h = nxt) AS valid_links, count(*) AS matched, CAST(0 AS BIGINT) AS orphans, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS repeated_ticks, CAST(0 AS BIGINT) AS without_episode FROM f""",
)
def q1(spark, sf_dir):
    return Q.traceability(flawed(transitions(spark, sf_dir)))


@query("dp8_q2_structure", f"WITH {TR} SELECT 'Q2' AS key, CASE WHEN bool_and(tick % 11 <> 4 AND tick % 13 <> 2) THEN 'pass' ELSE 'fail' END AS status, concat(count(*) FILTER (tick % 11 <> 4), '/', count(*), ' delta-capability consistent, ', count(*) FILTER (tick % 13 <> 2), '/', count(*), ' ticks after valid') AS evidence FROM tr")
def q2(spark, sf_dir):
    """Planted: changes of a slot that the world lacks, and states that stay at their tick."""
    tick, delta = F.col("tick"), F.col("state_delta")
    changes = F.when(tick % 11 == 4, F.struct(F.array().cast(T.ArrayType(R.CHANGE)).alias("changes")))
    after = F.when(tick % 13 == 2, tick).otherwise(delta["meta_after"]["tick"])
    rows = R.records(transitions(spark, sf_dir)).withColumn("state_delta", delta.withField("population_changes", changes).withField("meta_after.tick", after))
    return Q.q2_structure(rows).select("key", "status", "evidence")


@query(
    "dp10_q4_provenance",
    f"""WITH {EP} SELECT 'Q4' AS key, 'fail' AS status, concat((SELECT count(*) FROM tr), '/', (SELECT count(*) FROM tr), ' records have complete provenance, 0 episodes with several seeds, ', (SELECT count(*) FROM ep WHERE seed % 9 = 0), ' undeclared, ', (SELECT sum(records) FROM ep WHERE seed % 9 <> 0), ' declared records') AS evidence""",
)
def q4(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    declared = episodes(rows).filter("seed % 9 <> 0").select("episode_id", F.col("records").alias("record_count"))
    return Q.q4_provenance(R.records(rows), declared).select("key", "status", "evidence")


def _leakage(spark, sf_dir):
    found = episodes(transitions(spark, sf_dir))
    splits = found.select("episode_id", split_of(F.col("seed")).alias("split"))
    return found, splits


@query(
    "dp11_q5_leakage",
    f"""WITH {EP}, a AS (SELECT episode_id, seed, split FROM ep UNION ALL SELECT concat(episode_id, '_again'), seed, 'val' FROM ep WHERE seed % 17 = 0), v AS (SELECT seed FROM a GROUP BY seed HAVING count(DISTINCT split) > 1)
SELECT 'Q5' AS key, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, concat(count(*), ' violations reported, ', count(*), ' found again from the records') AS evidence FROM v""",
)
def q5(spark, sf_dir):
    """Planted: a second episode of some seeds, in the validation split."""
    found, splits = _leakage(spark, sf_dir)
    again = found.filter("seed % 17 = 0").withColumn("episode_id", F.concat("episode_id", F.lit("_again")))
    found, splits = found.unionByName(again), splits.unionByName(again.select("episode_id", F.lit("val").alias("split")))
    report = S.leakage_report(S.leakage(splits, found, ("seed",)), ("seed",))
    return Q.q5_leakage(report, splits.join(found.select("episode_id", "seed"), "episode_id")).select("key", "status", "evidence")


def _coverage(spark, sf_dir):
    rows, key = transitions(spark, sf_dir), {"action_type": F.col("action_type")}
    return G.coverage_gaps(G.coverage(rows.filter("tick % 2 = 0"), key), G.coverage(rows, key))


@query("dp12_q6_coverage", f"WITH {TR}, d AS (SELECT action_type, count(*) AS n, count(*) FILTER (tick % 2 = 0) AS r FROM tr GROUP BY 1) SELECT 'Q6' AS key, CASE WHEN count(*) FILTER (r < n) = 0 THEN 'pass' ELSE 'fail' END AS status, concat(count(*) FILTER (r < n), ' keys with fewer counts in the report than in the data') AS evidence FROM d")
def q6(spark, sf_dir):
    return Q.q6_coverage(_coverage(spark, sf_dir)).select("key", "status", "evidence")


@query("dp13_q7_counterfactual", f"WITH {TR}, g AS (SELECT event_id % 31 <> 0 AS held FROM tr WHERE tick > 0 AND tick % 5 = 0) SELECT 'Q7' AS key, CASE WHEN bool_and(held) THEN 'pass' ELSE 'fail' END AS status, concat(count(*) FILTER (held), '/', count(*), ' fork points held fixed, ', 4 * count(*), ' branches') AS evidence FROM g")
def q7(spark, sf_dir):
    """Planted: branches that start from another state than their parent."""
    groups = CFO.held_fixed_counts(moved(with_branches(transitions(spark, sf_dir))).filter("tick > 0 and tick % 5 = 0"))
    return Q.q7_counterfactual(groups).select("key", "status", "evidence")


@query("dp14_q8_quantity", f"WITH {TR}, t AS (SELECT count(*) AS p, count(*) FILTER (action_type <> 'error') AS a, count(*) FILTER (action_type = 'error') AS q FROM tr) SELECT 'Q8' AS key, 'pass' AS status, concat('produced ', p, ' = accepted ', a, ' + quarantined ', q, ' + rejected 0 + dropped 0') AS evidence FROM t")
def q8(spark, sf_dir):
    return q8_full(spark, sf_dir).select("key", "status", "evidence")


def q8_full(spark, sf_dir):
    rows = transitions(spark, sf_dir).groupBy("episode_id").agg(F.count("*").alias("produced"), F.count_if(F.col("action_type") != "error").alias("accepted"), F.count_if(F.col("action_type") == "error").alias("quarantined"), F.lit(0).alias("rejected"))
    return Q.q8_quantity(G.quantity_identity(rows))


@query("dp15_q9_utility", f"WITH {TR} SELECT 'Q9' AS key, 'pass' AS status, concat(3 * count(*), ' matched comparisons, best ', printf('%.6f', CAST(max(greatest((event_id * 31 + 977) % 30000, (event_id * 31 + 1954) % 30000, (event_id * 31 + 2931) % 30000) - d) AS DOUBLE))) AS evidence FROM tr WHERE tick > 0 AND tick % 5 = 0")
def q9(spark, sf_dir):
    return q9_full(spark, sf_dir).select("key", "status", "evidence")


def q9_full(spark, sf_dir):
    rows = with_branches(transitions(spark, sf_dir)).withColumn("scalar", F.col("d").cast("double"))
    found = J.matched_utilities(rows.filter("policy_id <> 'counterfactual_branch'"), rows.filter("policy_id = 'counterfactual_branch'"))
    return Q.q9_utility(found)


def _said(key: str, evidence: str, source: str = "t") -> str:
    return f"SELECT '{key}' AS key, '{Q.NAMES[key]}' AS name, 'pass' AS status, {evidence} AS evidence FROM {source}"


_GATES = " UNION ALL ".join((
    _said("Q0", "concat(n, '/', n, ' records schema-valid')"),
    _said("Q1", "concat(n, ' records, ', n - e, '/', n - e, ' hash-chain links valid, ', n, ' exec/receipt keys match, 0 orphans, 0 proposal hash mismatches, 0 repeated ticks, 0 without episode')"),
    _said("Q2", "concat(n, '/', n, ' delta-capability consistent, ', n, '/', n, ' ticks after valid')"),
    _said("Q3", "concat(5 * e, '/', 5 * e, ' records replay identically, 0 episodes without their initial state')"),
    _said("Q4", "concat(n, '/', n, ' records have complete provenance, 0 episodes with several seeds, 0 undeclared, ', n, ' declared records')"),
    _said("Q5", "'0 violations reported, 0 found again from the records'"),
    _said("Q6", "'0 keys with fewer counts in the report than in the data'"),
    _said("Q7", "concat(f, '/', f, ' fork points held fixed, ', 4 * f, ' branches')"),
    _said("Q8", "concat('produced ', n, ' = accepted ', n - q, ' + quarantined ', q, ' + rejected 0 + dropped 0')"),
    _said("Q9", "concat(3 * f, ' matched comparisons, best ', printf('%.6f', best))"),
))


@query(
    "ag32_quality_summary",
    f"""WITH {TR}, b AS (SELECT CAST(max(greatest((event_id * 31 + 977) % 30000, (event_id * 31 + 1954) % 30000, (event_id * 31 + 2931) % 30000) - d) AS DOUBLE) AS best, count(*) AS f FROM tr WHERE tick > 0 AND tick % 5 = 0),
t AS (SELECT count(*) AS n, count(DISTINCT episode_id) AS e, count(*) FILTER (action_type = 'error') AS q, (SELECT best FROM b) AS best, (SELECT f FROM b) AS f FROM tr) {_GATES}""",
)
def quality_report(spark, sf_dir):
    """All ten gates in one report; the scenario simulated for the table's seeds gives the replayed records of Q3."""
    compiled = spec.compile_spec(scenarios.RELIEF)
    played = SIM.rollout(spark, compiled, _seeds(spark, sf_dir), 8)
    rows = transitions(spark, sf_dir)
    recs = R.records(rows)
    found, splits = _leakage(spark, sf_dir)
    leak = S.leakage_report(S.leakage(splits, found, ("seed",)), ("seed",))
    gates = [
        Q.q0_schema(recs), Q.q1_traceability(recs), Q.q2_structure(recs), Q.q3_replay(SIM.replay(played, compiled)), Q.q4_provenance(recs), Q.q5_leakage(leak, splits.join(found.select("episode_id", "seed"), "episode_id")),
        q6_full(spark, sf_dir), Q.q7_counterfactual(CFO.held_fixed_counts(with_branches(rows).filter("tick > 0 and tick % 5 = 0"))), q8_full(spark, sf_dir), q9_full(spark, sf_dir),
    ]
    return Q.report(*gates)


def q6_full(spark, sf_dir):
    rows, key = transitions(spark, sf_dir), {"action_type": F.col("action_type")}
    counts = G.coverage(rows, key)
    return Q.q6_coverage(G.coverage_gaps(counts, counts))


@query(
    "dp29_invariants",
    f"""WITH {TR} SELECT episode_id, tick, true AS receipts, event_id % 89 <> 5 AS outcomes, true AS authority, true AS capability, true AS tick_advances,
CASE WHEN tick > 0 THEN lag(event_id) OVER (PARTITION BY episode_id ORDER BY tick) % 101 <> 7 END AS chain, CASE WHEN tick > 0 THEN true END AS dense FROM tr""",
)
def invariants(spark, sf_dir):
    return Q.invariants(flawed(transitions(spark, sf_dir)))


@query(
    "pf1_samples",
    f"""WITH {TR} SELECT episode_id, CAST(seed AS VARCHAR) AS seed, tick, agent_id, action_type, tick % 3 <> 1 AS has_params, d / 100.0 AS energy_delta, energy_after / 100.0 - energy_before / 100.0 AS realized_first, energy_after / 100.0 - energy_before / 100.0 AS realized_total,
tick % 4 = 2 AS position_changed, CAST(tick % 3 AS INTEGER) AS edge_change_count, CAST(CASE WHEN tick % 2 = 0 THEN 2 WHEN tick % 6 = 1 THEN 1 ELSE 0 END AS BIGINT) AS executed_candidate_rank FROM tr""",
)
def samples(spark, sf_dir):
    """First agent, receipt, ranks and realised changes of each record; some have moves, edge changes, other candidates or no parameters."""
    rows, tick, delta = R.records(transitions(spark, sf_dir)), F.col("tick"), F.col("state_delta")
    agent, first = F.map_keys("executed_actions")[0], F.map_values("candidate_actions")[0]
    move = F.struct(F.lit("update").alias("kind"), agent.alias("entity_id"), F.lit("node").alias("column"), F.lit(None).alias("before"), F.lit(None).alias("after")).cast(R.CHANGE)
    own = delta["entity_changes"]["changes"]
    delta = delta.withField("entity_changes.changes", F.when(tick % 4 == 2, F.concat(own, F.array(move))).otherwise(own))
    delta = delta.withField("relation_changes", F.struct(F.lit("r").alias("schema_id"), F.array_repeat(move, (tick % 3).cast("int")).alias("changes")))
    none = F.create_map().cast("map<string,string>")
    executed = F.transform_values("executed_actions", lambda k, v: v.withField("params", F.when(tick % 3 == 1, none).otherwise(v["params"])))
    other = F.when(tick % 2 == 0, F.create_map(F.lit("a0"), first)).when(tick % 6 == 1, F.create_map(F.lit("e9"), first)).otherwise(F.map_filter("candidate_actions", lambda k, v: F.lit(False)))
    rows = rows.withColumn("state_delta", delta).withColumn("candidate_actions", F.map_concat("candidate_actions", other)).withColumn("executed_actions", executed)
    return R.samples(rows).drop("policy_id", "state_before_hash", "state_after_hash")


@query("sk2_quarantine", f"WITH {TR} SELECT CASE WHEN event_id % 89 = 5 THEN 'validation_failed: outcome_codes' END AS reason, count(*) AS n FROM tr GROUP BY 1")
def quarantine(spark, sf_dir):
    return sinks.judged(flawed(transitions(spark, sf_dir))).groupBy("reason").agg(F.count("*").alias("n"))


@query("sk4_jsonl_round_trip", f"WITH {TR} SELECT episode_id, tick, state_after_hash FROM tr")
def jsonl_round_trip(spark, sf_dir):
    """Written as sorted JSON lines and read back with the record schema."""
    rows = transitions(spark, sf_dir)
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(R.records(rows).withColumn("split", split_of(F.col("provenance.seed").cast("long"))), path)
    found = files.json_lines(spark, path)
    return found.select(F.col("provenance.episode_id").alias("episode_id"), "tick", "state_after_hash")


@query("sk6_dataset_manifest", f"WITH {EP} SELECT split, count(*) AS episode_count, CAST(sum(records) AS BIGINT) AS record_count FROM ep GROUP BY 1")
def dataset_manifest(spark, sf_dir):
    flat = transitions(spark, sf_dir).withColumn("split", split_of(F.col("seed")))
    found = sinks.dataset_manifest(flat, "events", "sha256:none").select(F.explode("splits"))
    return found.select(F.col("key").alias("split"), F.col("value.episode_count").alias("episode_count"), F.col("value.record_count").alias("record_count"))


@query("sk10_checksums", """SELECT 'customer.parquet' AS name, count(*) AS rows FROM customer""")
def checksums(spark, sf_dir):
    """A file's checksum has no SQL, so its row count stands in; tests compare the digest."""
    found = sinks.checksums(spark, f"{sf_dir}/customer.parquet")
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("rows"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name")).join(n, F.lit(True))


@query("sl1_split_order", f"WITH {EP} SELECT split, episode_id, records FROM ep ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, episode_id LIMIT 1")
def split_order(spark, sf_dir):
    found = episodes(transitions(spark, sf_dir)).withColumn("split", split_of(F.col("seed"))).withColumn("tick", F.lit(0))
    return files.first_record(found).select("split", "episode_id", "records")


# -- actions ----------------------------------------------------------------
@query(
    "u5_policies",
    f"""WITH {TR}, l AS (SELECT *, CASE tick % 4 WHEN 0 THEN ['a', 'b', 'c'] WHEN 1 THEN ['a', 'a', 'b', 'b', 'c'] WHEN 2 THEN ['x'] ELSE ['b', 'a', 'b'] END AS legal FROM tr)
SELECT episode_id, tick, CASE policy_id WHEN 'random' THEN legal[CAST(floor((event_id % 97) / 97.0 * len(legal)) AS BIGINT) + 1] WHEN 'scripted:first' THEN legal[1] ELSE CASE tick % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'c' WHEN 2 THEN 'x' ELSE 'a' END END AS choice FROM l""",
)
def policies(spark, sf_dir):
    arrays = [F.array(*map(F.lit, x)) for x in (("a", "b", "c"), ("a", "a", "b", "b", "c"), ("x",), ("b", "a", "b"))]
    k = F.col("tick") % 4
    legal = F.when(k == 0, arrays[0]).when(k == 1, arrays[1]).when(k == 2, arrays[2]).otherwise(arrays[3])
    rows = transitions(spark, sf_dir).withColumn("legal", legal)
    return rows.select("episode_id", "tick", PO.by_policy(F.col("legal"), F.col("policy_id"), (F.col("event_id") % 97) / F.lit(97.0)).alias("choice"))


@query(
    "pf18_receipts",
    f"""WITH {TR} SELECT episode_id, tick, action_type, CASE WHEN action_type IN ('signup', 'error') THEN 'unrecognized_intent' WHEN energy_before < 5000 THEN 'illegal_action' ELSE 'ok' END AS outcome_code,
CASE WHEN action_type IN ('signup', 'error') OR energy_before < 5000 THEN 0.0 ELSE CASE action_type WHEN 'click' THEN -0.5 WHEN 'view' THEN -0.1 ELSE -2.0 END END AS energy_delta FROM tr""",
)
def receipts(spark, sf_dir):
    actions = spark.createDataFrame([("click", 0.5), ("view", 0.1), ("purchase", 2.0)], "action_type string, cost double")
    rows = transitions(spark, sf_dir).withColumn("legal", P.energy_above(F.col("energy_before"), F.lit(5000)))
    return P.receipts_for(rows, actions).select("episode_id", "tick", "action_type", "outcome_code", F.col("energy_delta").cast("double").alias("energy_delta"))


@query(
    "pf13_legal_actions",
    f"""WITH {TR}, a(action_type, precondition, threshold) AS (VALUES ('rest', NULL, 0), ('walk', 'energy_above', 2000), ('lift', 'energy_above', 50000)) SELECT episode_id, tick, a.action_type FROM tr, a WHERE precondition IS NULL OR energy_before >= threshold""",
)
def legal_actions(spark, sf_dir):
    actions = spark.createDataFrame([("rest", None, 0), ("walk", "energy_above", 2000), ("lift", "energy_above", 50000)], "action_type string, precondition string, threshold int")
    agents = transitions(spark, sf_dir).select("episode_id", "tick", "energy_before")
    return P.legal_actions(agents, actions, {"energy_above": P.energy_above(F.col("energy_before"), F.col("threshold"))}).select("episode_id", "tick", "action_type")


@query(
    "pf11_observation",
    f"""WITH {TR}, s AS (SELECT DISTINCT episode_id, tick // 4 AS tick, agent_id, 1 AS alive FROM tr) SELECT a.episode_id, CAST(a.tick AS BIGINT) AS tick, a.agent_id AS focal, coalesce(string_agg(b.agent_id, ',' ORDER BY b.agent_id), '') AS others
FROM s a LEFT JOIN s b ON a.episode_id = b.episode_id AND a.tick = b.tick AND a.agent_id <> b.agent_id GROUP BY ALL""",
)
def observation(spark, sf_dir):
    """What a focal agent sees of the others: public columns only."""
    rows = transitions(spark, sf_dir).select("episode_id", F.floor(F.col("tick") / 4).alias("tick"), "agent_id").distinct().withColumn("alive", F.lit(True)).withColumn("energy", F.lit(1.0))
    found = P.public_view(rows, ["alive"])
    return found.select("episode_id", "tick", "focal", F.array_join(F.transform("others", lambda o: o["agent_id"]), ",").alias("others"))


@query(
    "pf15_first_neighbour",
    """WITH e AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS src, concat('p', l_partkey % 50) AS dst FROM lineitem), o AS (SELECT *, row_number() OVER (ORDER BY src, dst) AS ord FROM e),
x AS (SELECT src AS node, dst AS n, ord, 0 AS side FROM o UNION ALL SELECT dst, src, ord, 1 FROM o), f AS (SELECT node, n FROM x QUALIFY row_number() OVER (PARTITION BY node ORDER BY ord, side) = 1),
s AS (SELECT DISTINCT src AS node FROM e UNION SELECT 'nowhere') SELECT s.node, coalesce(n, s.node) AS neighbour FROM s LEFT JOIN f USING (node)""",
)
def first_neighbour(spark, sf_dir):
    from ..operators.ordering import numbered

    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")).alias("dst")).distinct()
    e = numbered(e, ["src", "dst"], "ord")
    nodes = e.select(F.col("src").alias("node")).distinct().union(spark.createDataFrame([("nowhere",)], "node string"))
    return P.first_neighbour(nodes, e)


@query("pf19_external_action", f"WITH {TR} SELECT episode_id, tick, CASE WHEN event_id % 7 < 5 THEN CAST(event_id % 7 AS INTEGER) END AS action FROM tr")
def external_action(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 6, "jump").otherwise((F.col("event_id") % 7).cast("string"))
    return transitions(spark, sf_dir).select("episode_id", "tick", P.external_action(text, 5).alias("action"))


@query("f34_slot_triple", f"WITH {TR} SELECT episode_id, tick, CASE WHEN tick % 3 = 0 OR tick % 5 = 0 THEN tick % 2 = 0 ELSE tick % 2 = 1 END AS ok FROM tr")
def slot_triple(spark, sf_dir):
    capable, missing = F.col("tick") % 3 != 0, F.col("tick") % 5 == 0
    value = F.when(F.col("tick") % 2 == 1, F.col("d"))
    return transitions(spark, sf_dir).select("episode_id", "tick", R.slot_triple(capable, missing, value).alias("ok"))


@query("h18_seed_number", f"WITH {TR} SELECT episode_id, tick, CASE WHEN tick % 2 = 0 THEN seed ELSE 0 END AS seed FROM tr")
def seed_number(spark, sf_dir):
    text = F.when(F.col("tick") % 2 == 0, F.col("seed").cast("string")).otherwise("none")
    return transitions(spark, sf_dir).select("episode_id", "tick", R.seed_number(text).alias("seed"))


@query("dp30_distances", """WITH RECURSIVE e AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS src, CAST((c_nationkey * 7 + 3) % 25 AS VARCHAR) AS dst FROM customer), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(node, distance) AS (SELECT '0', 0 UNION SELECT b.dst, r.distance + 1 FROM r JOIN b ON b.src = r.node WHERE r.distance < 25) SELECT node, min(distance) AS distance FROM r GROUP BY node""")
def distances(spark, sf_dir):
    e = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("src"), ((F.col("c_nationkey") * 7 + 3) % 25).cast("string").alias("dst")).distinct()
    from ..scratch import shared_dir

    if not spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return J.distances(e, "0")


# -- simulation -------------------------------------------------------------
def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seed")).distinct()


@query("st22_rollout")
def rollout(spark, sf_dir):
    return SIM.rollout(spark, spec.compile_spec(scenarios.RELIEF), _seeds(spark, sf_dir), 12)


@query("st23_joint_rollout")
def joint_rollout(spark, sf_dir):
    return SIM.joint_rollout(spark, spec.compile_spec(scenarios.RELIEF), _seeds(spark, sf_dir), 8, PO.random_choice)


@query("st17_replay")
def replay(spark, sf_dir):
    compiled = spec.compile_spec(scenarios.RELIEF)
    return SIM.replay(SIM.rollout(spark, compiled, _seeds(spark, sf_dir), 8), compiled)


@query("st18_branch")
def branch(spark, sf_dir):
    compiled = spec.compile_spec(scenarios.RELIEF)
    return SIM.branch(SIM.rollout(spark, compiled, _seeds(spark, sf_dir), 12), compiled)


@query("st21_joint_branch")
def joint_branch(spark, sf_dir):
    compiled = spec.compile_spec(scenarios.RELIEF)
    return SIM.joint_branch(SIM.joint_rollout(spark, compiled, _seeds(spark, sf_dir), 8, PO.random_choice), compiled)


@query("dp1_dataset")
def dataset(spark, sf_dir):
    """The gates of a whole run over the table's seeds."""
    from ..operators import dataset as DS

    return DS.build(spark, scenarios.RELIEF, _seeds(spark, sf_dir), DS.Config(ticks=8)).gates


@query(
    "dp22_decisions",
    f"""WITH {TR} SELECT concat(episode_id, '/', tick) AS decision_id, CASE WHEN tick % 3 = 2 THEN 'view' ELSE 'click' END AS action_type, CASE WHEN tick % 3 = 2 THEN 'fallback' ELSE 'llm' END AS final_origin, CASE WHEN tick % 3 = 2 THEN 2 ELSE 1 END AS attempts FROM tr""",
)
def decisions(spark, sf_dir):
    """A constant client: where its action isn't legal, a retry and then the fallback."""
    from ..operators import decide as DE

    legal = F.when(F.col("tick") % 3 == 2, F.array(F.lit("view"))).otherwise(F.array(F.lit("view"), F.lit("click")))
    asked = transitions(spark, sf_dir).select(F.concat_ws("/", "episode_id", F.col("tick").cast("string")).alias("decision_id"), F.lit("{}").alias("prompt"), legal.alias("legal"))
    tries = DE.decide(asked, DE.constant("click"), retries=1, wait=_no_wait)
    counts = tries.groupBy("decision_id").agg(F.count("*").cast("int").alias("attempts"))
    return DE.chosen(tries).join(counts, "decision_id")


def _no_wait(seconds: float) -> None:
    """Retries of test clients needn't wait."""


@query(
    "dp25_states",
    f"""WITH {TR}, e AS (SELECT DISTINCT episode_id FROM tr), l AS (SELECT episode_id, -1 AS tick, 'energy' AS key, '0' AS value FROM e UNION ALL SELECT episode_id, tick, 'energy', CAST(energy_after AS VARCHAR) FROM tr WHERE tick % 2 = 0 UNION ALL SELECT episode_id, tick, 'last', CASE WHEN action_type <> 'error' THEN action_type END FROM tr WHERE tick % 3 = 0),
k AS (SELECT episode_id, tick, max(struct_pack(t := tick, v := value)) FILTER (key = 'energy') AS e, max(struct_pack(t := tick, v := value)) FILTER (key = 'last') AS a FROM l GROUP BY ALL),
c AS (SELECT episode_id, tick, last_value(e IGNORE NULLS) OVER w AS e, last_value(a IGNORE NULLS) OVER w AS a FROM (SELECT episode_id, tick FROM tr UNION SELECT episode_id, -1 FROM e) LEFT JOIN k USING (episode_id, tick) WINDOW w AS (PARTITION BY episode_id ORDER BY tick))
SELECT episode_id, tick, e.v AS energy, a.v AS last FROM c WHERE tick >= 0""",
)
def states(spark, sf_dir):
    """The state after each tick, from an initial table and a change log with removals."""
    from ..operators.materialize import states as folded

    rows = transitions(spark, sf_dir)
    initial = rows.select("episode_id").distinct().select("episode_id", F.lit("energy").alias("key"), F.lit("0").alias("value"))
    changes = rows.filter("tick % 2 = 0").select("episode_id", "tick", F.lit("energy").alias("key"), F.col("energy_after").cast("string").alias("value"))
    changes = changes.unionByName(rows.filter("tick % 3 = 0").select("episode_id", "tick", F.lit("last").alias("key"), F.when(F.col("action_type") != "error", F.col("action_type")).alias("value")))
    found = folded(rows.select("episode_id", "tick"), initial, changes)
    return found.select("episode_id", "tick", F.element_at("after", "energy").alias("energy"), F.try_element_at("after", F.lit("last")).alias("last"))


@query("st28_matched_policies")
def matched_policies(spark, sf_dir):
    found = SIM.matched_utilities(spark, spec.compile_spec(scenarios.RELIEF), _seeds(spark, sf_dir), {k: PO.BUILT_IN[k] for k in ("scripted", "adversarial", "random")}, "scripted", 4)
    return SIM.compare_policies(found, "scripted")


@query("st2_field_prefix")
def field_prefix(spark, sf_dir):
    compiled = spec.compile_spec(scenarios.RELIEF)
    return SIM.field_by_prefix(SIM.rollout(spark, compiled, _seeds(spark, sf_dir), 12), compiled, "water_level")


@query("dp28_spec_issues", " UNION ALL ".join(f"SELECT '{k}' AS spec, {n} AS n" for k, n in (("1", 1), ("2", 1), ("3", 1), ("4", 1), ("5", 2), ("6", 1), ("7", 1), ("8", 1), ("9", 1), ("10", 1), ("11", 1))))
def spec_issues(spark, sf_dir):
    """The faulty specifications, one for each semantic check, and how often that check speaks."""
    rows = [(k, i.check_id) for k, data in scenarios.FAULTY.items() for i in spec.semantic_issues(data)]
    found = spark.createDataFrame(rows, "spec string, check_id string").filter("spec = check_id")
    return found.groupBy("spec").agg(F.count("*").cast("int").alias("n"))


@query("h8_counter_environment", f"WITH {TR}, a AS (SELECT seed, tick, CAST(seed * 7 + tick * 3 AS BIGINT) % 2 AS action, sum(1 + CAST(seed * 7 + tick * 3 AS BIGINT) % 2) OVER (PARTITION BY seed ORDER BY tick) AS v FROM (SELECT DISTINCT seed, unnest(range(10)) AS tick FROM tr)) SELECT seed, tick, action, CAST(v AS DOUBLE) AS reward, v >= 10 AS terminated FROM a WHERE v - 1 - action < 10")
def counter_environment(spark, sf_dir):
    """An external environment run for each seed."""
    found = ENV.run_single(_seeds(spark, sf_dir), ENV.Counter, lambda seed, tick, observation, n: (seed * 7 + tick * 3) % 2)
    return found.select("seed", "tick", "action", "reward", "terminated")


# -- streams ----------------------------------------------------------------
def _logged(spark, sf_dir):
    rows = transitions(spark, sf_dir).select("episode_id", "tick", F.col("ts").cast("timestamp").alias("ts"), "action_type", "state_before_hash", "state_after_hash")
    path = scratch(spark, "log")
    log.append(rows.filter("tick % 2 = 1"), path)
    log.append(rows.filter("tick % 2 = 0"), path)
    return log.tail(spark, path, rows.schema)


@query("sm3_stream_chain", f"WITH {TR} SELECT episode_id, tick, CASE WHEN tick > 0 THEN true END AS link_ok, false AS late FROM tr")
def stream_chain(spark, sf_dir):
    """Odd ticks come before even ones; the state puts them in order."""
    return log.drain(log.chain(_logged(spark, sf_dir)), "chain")


@query("sm6_live_manifest", f"WITH {TR} SELECT episode_id, count(*) AS record_count, min(tick) AS first_tick, max(tick) AS last_tick FROM tr GROUP BY 1")
def live_manifest(spark, sf_dir):
    return log.drain(log.live_manifest(_logged(spark, sf_dir)), "manifest", ["episode_id"])


@query("sm2_observed_counters", f"WITH {TR} SELECT episode_id, count(*) AS record_count, min(tick) AS first_tick, max(tick) AS last_tick, {', '.join(f"count(*) FILTER (action_type = '{k}') AS {k}_count" for k in ('view', 'click', 'purchase', 'signup', 'error'))} FROM tr GROUP BY 1")
def observed_counters(spark, sf_dir):
    return log.drain(log.live_manifest(_logged(spark, sf_dir), streaming_only=False), "counters", ["episode_id"])


@query("sm4_stream_repeats", f"WITH {TR} SELECT episode_id, tick FROM tr")
def stream_repeats(spark, sf_dir):
    rows = transitions(spark, sf_dir).select("episode_id", "tick", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch(spark, "log")
    log.append(rows, path)
    log.append(rows.filter("tick % 3 = 0"), path)
    return log.drain(log.without_repeats(log.tail(spark, path, rows.schema), "400 days"), "repeats").select("episode_id", "tick")


@query("sm5_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS action_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    return log.drain(log.windowed(_logged(spark, sf_dir), "1 hour", "400 days"), "windows", ["start", "action_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))

