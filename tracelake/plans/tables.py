"""Queries of joins, set operations, differences, functions, telemetry, prompts and features."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canonical as C
from ..operators import counterfactual as CFO
from ..operators import delta as D
from ..operators import features as X
from ..operators import joins as J
from ..operators import predicates as P
from ..operators import prompts as R
from ..operators import telemetry as M
from ..registry import query, table
from ..trajectory import CF, EP, TR, branches, episodes, split_of, transitions, with_branches


# -- joins ------------------------------------------------------------------
@query("j1_records_splits", f"WITH {EP} SELECT tr.episode_id, tick, split FROM tr JOIN ep USING (episode_id) WHERE split IN ('train', 'val', 'test')")
def records_splits(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    splits = episodes(rows).select("episode_id", split_of(F.col("seed")).alias("split"))
    return J.with_split(rows, splits).select("episode_id", "tick", "split")


@query(
    "j3_samples_outcomes",
    f"""WITH {CF}, o AS (SELECT episode_id, tick, d AS outcome FROM both_rows WHERE event_id % 3 <> 0) SELECT b.episode_id, b.tick, coalesce(outcome, 0) AS outcome FROM both_rows b LEFT JOIN o USING (episode_id, tick)""",
)
def samples_outcomes(spark, sf_dir):
    from ..operators.ranking import attach_outcomes

    rows = with_branches(transitions(spark, sf_dir))
    return attach_outcomes(rows.select("episode_id", "tick"), rows.filter("event_id % 3 <> 0").select("episode_id", "tick", F.col("d").alias("outcome")))


@query("j4_orphan_actions", f"WITH {TR} SELECT episode_id, tick, agent_id FROM tr WHERE event_id % 7 = 0 AND NOT EXISTS (SELECT 1 FROM tr c WHERE c.episode_id = tr.episode_id AND c.tick = tr.tick AND c.event_id % 14 = 0)")
def orphan_actions(spark, sf_dir):
    rows = transitions(spark, sf_dir).select("episode_id", "tick", "agent_id", "event_id")
    return J.orphans(rows.filter("event_id % 7 = 0"), rows.filter("event_id % 14 = 0")).select("episode_id", "tick", "agent_id")


@query(
    "j6_coverage_gaps",
    f"""WITH {TR}, d AS (SELECT action_type AS key, count(*) AS in_data FROM tr GROUP BY 1), r AS (SELECT action_type AS key, count(*) AS in_report FROM tr WHERE tick % 2 = 0 AND action_type <> 'view' GROUP BY 1)
SELECT 'action_type' AS dimension, key, coalesce(in_data, 0) AS in_data, coalesce(in_report, 0) AS in_report FROM d FULL JOIN r USING (key) WHERE coalesce(in_report, 0) < coalesce(in_data, 0)""",
)
def coverage_gaps(spark, sf_dir):
    from ..operators.grouping import coverage
    from ..operators.grouping import coverage_gaps as gaps

    rows, key = transitions(spark, sf_dir), {"action_type": F.col("action_type")}
    return gaps(coverage(rows.filter("tick % 2 = 0 and action_type <> 'view'"), key), coverage(rows, key))


@query("j8_undeclared_episodes", f"WITH {EP} SELECT episode_id FROM ep WHERE split <> 'train'")
def undeclared_episodes(spark, sf_dir):
    rows = episodes(transitions(spark, sf_dir)).withColumn("split", split_of(F.col("seed")))
    return J.undeclared(rows.select("episode_id"), rows.filter("split = 'train'").select("episode_id"))


@query(
    "j13_matched_utilities",
    f"""WITH {CF} SELECT b.seed, b.tick, c.episode_id, CAST(b.d AS BIGINT) AS baseline_utility, c.d AS candidate_utility, c.d - b.d AS delta, b.state_before_hash = c.state_before_hash AS matched
FROM tr b JOIN cf c ON b.seed = c.seed AND b.tick = c.tick""",
)
def matched_utilities(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    return J.matched_utilities(rows, branches(rows), "d")


@query(
    "j16_oracle_lookup",
    f"""WITH {CF}, k AS (SELECT state_before_hash, action_type, agent_id, arg_max(d, episode_id) AS known FROM both_rows WHERE event_id % 2 = 0 GROUP BY ALL), g AS (SELECT action_type, avg(d) AS m FROM both_rows WHERE event_id % 2 = 0 GROUP BY 1)
SELECT b.episode_id, b.tick, coalesce(CAST(known AS DOUBLE), m) AS prediction FROM both_rows b LEFT JOIN k USING (state_before_hash, action_type, agent_id) JOIN g ON g.action_type = b.action_type""",
)
def oracle_lookup(spark, sf_dir):
    from ..operators.baselines import MeanDelta, Oracle

    rows = with_branches(transitions(spark, sf_dir))
    model = Oracle(MeanDelta(["action_type"], ["d"]), ["state_before_hash", "action_type", "agent_id"], ["d"], "episode_id").fit(rows.filter("event_id % 2 = 0"))
    return model.predict(rows).select("episode_id", "tick", F.col("pred_d").alias("prediction"))


@query(
    "j17_divergence",
    f"""WITH {CF}, p AS (SELECT seed, tick, state_before_hash AS hash FROM tr), b AS (SELECT seed, episode_id, tick AS fork_tick, unnest(range(2)) AS off, energy_after, d FROM cf),
h AS (SELECT *, concat('sha256:', sha256(concat('(3:i', seed, 'i', fork_tick + 1 + off, 'i', energy_after - CASE WHEN off = 0 THEN d % 2 * d ELSE 0 END))) AS hash FROM b)
SELECT h.seed, episode_id, fork_tick, min(CASE WHEN p.hash IS NULL OR p.hash <> h.hash THEN fork_tick + 1 + off END) AS divergence_tick FROM h LEFT JOIN p ON p.seed = h.seed AND p.tick = fork_tick + 1 + off GROUP BY ALL""",
)
def divergence(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    b = branches(rows).withColumn("fork_tick", F.col("tick")).withColumn("offset", F.explode(F.array(F.lit(0), F.lit(1))))
    energy = F.col("energy_after") - F.when(F.col("offset") == 0, F.col("d") % 2 * F.col("d")).otherwise(0)
    b = b.withColumn("hash", C.hash_of(C.int_tuple(F.col("seed"), F.col("fork_tick") + 1 + F.col("offset"), energy)))
    return CFO.divergence(rows.select("seed", "tick", F.col("state_before_hash").alias("hash")), b)


@query("j18_edge_exists", """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber <= 2)
SELECT src, dst FROM p SEMI JOIN e USING (src, dst)""")
def edge_exists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_returnflag", "l_linenumber")
    return P.has_edge(rows.filter("l_linenumber <= 2").select("src", "dst").distinct(), rows.filter("l_returnflag = 'R'"))


@query("j2_episode_metadata", f"WITH {EP} SELECT split, scenario_id, count(*) AS episodes FROM ep WHERE seed % 5 <> 0 GROUP BY ALL")
def episode_metadata(spark, sf_dir):
    found = episodes(transitions(spark, sf_dir))
    splits = found.select("episode_id", split_of(F.col("seed")).alias("split"))
    return splits.join(found.filter("seed % 5 <> 0"), "episode_id").groupBy("split", "scenario_id").agg(F.count("*").alias("episodes"))


@query(
    "pf6_known_vocabulary",
    f"""WITH {TR}, v AS (SELECT action_type, row_number() OVER (ORDER BY action_type) - 1 AS action_type_idx FROM (SELECT DISTINCT action_type FROM tr WHERE action_type <> 'error')) SELECT episode_id, tick, action_type, action_type_idx FROM tr JOIN v USING (action_type)""",
)
def known_vocabulary(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    return J.in_vocabulary(rows, J.vocabulary(rows.filter("action_type <> 'error'"), "action_type"), "action_type").select("episode_id", "tick", "action_type", "action_type_idx")


# -- differences ------------------------------------------------------------
PARTS = """b AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n FROM lineitem WHERE l_partkey % 10 < 8 AND l_linenumber <= 3 GROUP BY 1),
a AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n FROM lineitem WHERE l_partkey % 10 >= 2 AND (l_linenumber <= 3 OR l_partkey % 10 < 5) GROUP BY 1)"""


def _parts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey") % 10
    agg = (F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("n"))
    before = rows.filter((key < 8) & (F.col("l_linenumber") <= 3)).groupBy(F.col("l_partkey").alias("k")).agg(*agg)
    after = rows.filter((key >= 2) & ((F.col("l_linenumber") <= 3) | (key < 5))).groupBy(F.col("l_partkey").alias("k")).agg(*agg)
    return before, after


@query(
    "j9_entity_diff",
    f"""WITH {PARTS}, j AS (SELECT CAST(coalesce(b.k, a.k) AS VARCHAR) AS entity_id, b.k AS bk, a.k AS ak, b.quantity AS bq, a.quantity AS aq, b.n AS bn, a.n AS an FROM b FULL JOIN a ON a.k = b.k)
SELECT entity_id, 'add' AS kind, NULL AS "column", NULL AS before, NULL AS after FROM j WHERE bk IS NULL UNION ALL SELECT entity_id, 'remove', NULL, NULL, NULL FROM j WHERE ak IS NULL
UNION ALL SELECT entity_id, 'update', 'quantity', CAST(bq AS VARCHAR), CAST(aq AS VARCHAR) FROM j WHERE bk IS NOT NULL AND ak IS NOT NULL AND bq <> aq UNION ALL SELECT entity_id, 'update', 'n', CAST(bn AS VARCHAR), CAST(an AS VARCHAR) FROM j WHERE bk IS NOT NULL AND ak IS NOT NULL AND bn <> an""",
)
def entity_diff(spark, sf_dir):
    return D.entity_changes(*_parts(spark, sf_dir), "k", ["quantity", "n"])


@query("st8_apply_delta", f"WITH {PARTS} SELECT k, quantity FROM a")
def apply_delta(spark, sf_dir):
    """Round trip: the difference applied to the snapshot before gives the one after."""
    before, after = _parts(spark, sf_dir)
    return D.apply(before, D.differences(before, after, ["k"], "quantity"), ["k"], "quantity")


EDGES = """b AS (SELECT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, l_returnflag AS edge_type, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem WHERE l_partkey % 10 < 8 AND l_linenumber <= 3 GROUP BY ALL),
a AS (SELECT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, l_returnflag AS edge_type, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem WHERE l_partkey % 10 >= 2 AND l_linenumber <= 4 GROUP BY ALL)"""


@query(
    "j10_relation_diff",
    f"""WITH {EDGES} SELECT src, dst, edge_type, CASE WHEN b.weight IS NULL THEN 'add' WHEN a.weight IS NULL THEN 'remove' ELSE 'update_weight' END AS kind, b.weight AS before, a.weight AS after
FROM b FULL JOIN a USING (src, dst, edge_type) WHERE b.weight IS DISTINCT FROM a.weight""",
)
def relation_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey") % 10
    edges = [F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"), F.col("l_returnflag").alias("edge_type")]
    weight = F.sum("l_quantity").cast("long").alias("weight")
    before = rows.filter((key < 8) & (F.col("l_linenumber") <= 3)).groupBy(*edges).agg(weight)
    after = rows.filter((key >= 2) & (F.col("l_linenumber") <= 4)).groupBy(*edges).agg(weight)
    return D.relation_changes(before, after)


@query(
    "j11_registry_diff",
    """WITH b AS (SELECT o_orderpriority AS registry_type, CAST(o_orderkey AS VARCHAR) AS entry_id, o_orderstatus AS state FROM orders WHERE o_orderkey % 10 < 8),
a AS (SELECT o_orderpriority AS registry_type, CAST(o_orderkey AS VARCHAR) AS entry_id, CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 10 >= 2)
SELECT registry_type, entry_id, CASE WHEN b.state IS NULL THEN 'add' WHEN a.state IS NULL THEN 'remove' ELSE 'state_change' END AS kind, b.state AS before, a.state AS after FROM b FULL JOIN a USING (registry_type, entry_id) WHERE b.state IS DISTINCT FROM a.state""",
)
def registry_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("registry_type"), F.col("o_orderkey").cast("string").alias("entry_id"), F.col("o_orderstatus").alias("state"), "o_orderkey", "o_custkey")
    after = rows.filter("o_orderkey % 10 >= 2").withColumn("state", F.when(F.col("o_custkey") % 3 == 0, "F").otherwise(F.col("state")))
    return D.registry_changes(rows.filter("o_orderkey % 10 < 8"), after)


@query(
    "j12_field_diff",
    f"""WITH {TR}, c AS (SELECT episode_id, tick, action_type AS channel, CAST(sum(d) OVER (PARTITION BY episode_id, action_type ORDER BY tick) AS BIGINT) AS value FROM tr), b AS (SELECT episode_id, channel, arg_max(value, tick) AS value FROM c WHERE tick < 10 GROUP BY ALL),
a AS (SELECT episode_id, channel, arg_max(value, tick) AS value FROM c WHERE tick < 20 AND channel <> 'view' GROUP BY ALL)
SELECT episode_id, channel, CASE WHEN b.value IS NULL THEN 'add' WHEN a.value IS NULL THEN 'remove' ELSE 'update' END AS kind, b.value AS before, a.value AS after FROM b FULL JOIN a USING (episode_id, channel) WHERE b.value IS DISTINCT FROM a.value""",
)
def field_diff(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("episode_id", "action_type").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    c = transitions(spark, sf_dir).select("episode_id", "tick", F.col("action_type").alias("channel"), F.sum("d").over(w).alias("value"))
    before = c.filter("tick < 10").groupBy("episode_id", "channel").agg(F.max_by("value", "tick").alias("value"))
    after = c.filter("tick < 20 and channel <> 'view'").groupBy("episode_id", "channel").agg(F.max_by("value", "tick").alias("value"))
    return D.differences(before, after, ["episode_id", "channel"], "value")


@query(
    "st13_population_diff",
    f"""WITH {TR}, s AS (SELECT episode_id, list(DISTINCT agent_id) FILTER (tick < 3) AS b, list(DISTINCT agent_id) FILTER (tick BETWEEN 2 AND 5) AS a FROM tr GROUP BY 1)
SELECT episode_id, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS births, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS deaths FROM s""",
)
def population_diff(spark, sf_dir):
    s = transitions(spark, sf_dir).groupBy("episode_id").agg(F.collect_set(F.when(F.col("tick") < 3, F.col("agent_id"))).alias("b"), F.collect_set(F.when(F.col("tick").between(2, 5), F.col("agent_id"))).alias("a"))
    births, deaths = D.population_changes(F.col("b"), F.col("a"))
    return s.select("episode_id", F.array_join(births, ",").alias("births"), F.array_join(deaths, ",").alias("deaths"))


@query(
    "st11_replayed_state",
    f"""WITH {TR} SELECT episode_id, action_type AS channel, arg_max(energy_after, tick) AS value FROM tr WHERE tick <= 7 GROUP BY ALL""",
)
def replayed_state(spark, sf_dir):
    """The snapshot after a tick, from the initial state and the change log."""
    rows = transitions(spark, sf_dir)
    changes = rows.select("episode_id", "tick", F.col("action_type").alias("channel"), F.lit("update").alias("kind"), F.col("energy_after").alias("after"))
    initial = rows.limit(0).select("episode_id", F.col("action_type").alias("channel"), F.col("energy_after").alias("value"))
    return D.at_tick(D.replay(initial, changes, ["channel"]), 7, ["channel"]).select("episode_id", "channel", "value")


# -- sets -------------------------------------------------------------------
@query("so1_union_all", f"WITH {CF} SELECT policy_id, count(*) AS n FROM both_rows GROUP BY 1")
def union_all(spark, sf_dir):
    return with_branches(transitions(spark, sf_dir)).groupBy("policy_id").agg(F.count("*").alias("n"))


@query("so2_except_intersect", f"WITH {TR}, a AS (SELECT DISTINCT seed, agent_id FROM tr WHERE tick < 5), b AS (SELECT DISTINCT seed, agent_id FROM tr WHERE tick BETWEEN 5 AND 9) SELECT seed, agent_id, 'gone' AS what FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT seed, agent_id, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def except_intersect(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    a, b = (rows.filter(c).select("seed", "agent_id").distinct() for c in ("tick < 5", "tick between 5 and 9"))
    return a.exceptAll(b).withColumn("what", F.lit("gone")).unionByName(a.intersect(b).withColumn("what", F.lit("both")))


@query("so3_distinct_legal", f"WITH {TR} SELECT episode_id, action_type, min(tick) AS first_tick FROM tr GROUP BY ALL")
def distinct_legal(spark, sf_dir):
    return transitions(spark, sf_dir).groupBy("episode_id", "action_type").agg(F.min("tick").alias("first_tick"))


@query(
    "so4_contract_errors",
    f"""WITH {TR}, s AS (SELECT episode_id, list(DISTINCT action_type) FILTER (tick < 4) AS o, list(DISTINCT action_type) FILTER (tick >= 2 AND tick < 8) AS c FROM tr GROUP BY 1)
SELECT episode_id, array_to_string(list_concat(list_transform(list_sort(list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(c, []), x))), lambda x: concat('missing:', x)), list_transform(list_sort(list_filter(coalesce(c, []), lambda x: NOT list_contains(coalesce(o, []), x))), lambda x: concat('extra:', x))), ',') AS errors FROM s""",
)
def contract_errors(spark, sf_dir):
    s = transitions(spark, sf_dir).groupBy("episode_id").agg(F.collect_set(F.when(F.col("tick") < 4, F.col("action_type"))).alias("o"), F.collect_set(F.when(F.col("tick").between(2, 7), F.col("action_type"))).alias("c"))
    return s.select("episode_id", F.array_join(R.contract_errors(F.col("o"), F.col("c")), ",").alias("errors"))


@query(
    "so5_joint_subset",
    f"""WITH {TR}, s AS (SELECT episode_id, tick // 4 AS step, list(DISTINCT agent_id) AS active, count(*) AS n, count(DISTINCT agent_id) AS d FROM tr GROUP BY ALL) SELECT episode_id, step, list_contains(active, 'e0') AND list_contains(active, 'e1') AS complete, n = d AS unique_agents FROM s""",
)
def joint_subset(spark, sf_dir):
    from ..operators.joint import complete, unique_agents

    s = transitions(spark, sf_dir).groupBy("episode_id", F.floor(F.col("tick") / 4).alias("step")).agg(F.collect_list("agent_id").alias("agents"))
    return s.select("episode_id", "step", complete(F.array(F.lit("e0"), F.lit("e1")), F.col("agents")).alias("complete"), unique_agents(F.col("agents")).alias("unique_agents"))


# -- functions --------------------------------------------------------------
@query(
    "f2_record_hash",
    f"""WITH {TR} SELECT episode_id, tick, concat('sha256:', sha256(concat('D11:ProposalRow4:seedi', seed, '8:agent_ids', octet_length(encode(agent_id)), ':', agent_id, '2:ok', CASE WHEN outcome_code = 'ok' THEN 'T' ELSE 'F' END, '4:pair(2:i', tick, 'i', d, '6:paramsM1:s4:kinds', octet_length(encode(action_type)), ':', action_type, '4:noneN'))) AS hash FROM tr""",
)
def record_hash(spark, sf_dir):
    kind = T.StructType(
        [
            T.StructField("seed", T.LongType()),
            T.StructField("agent_id", T.StringType()),
            T.StructField("ok", T.BooleanType()),
            T.StructField("pair", T.ArrayType(T.LongType())),
            T.StructField("params", T.MapType(T.StringType(), T.StringType())),
            T.StructField("none", T.LongType()),
        ]
    )
    rows = transitions(spark, sf_dir)
    record = F.struct(
        "seed", "agent_id", (F.col("outcome_code") == "ok").alias("ok"), F.array("tick", "d").alias("pair"), F.create_map(F.lit("kind"), F.col("action_type")).alias("params"), F.lit(None).cast("long").alias("none")
    )
    rows = rows.withColumn("r", record)
    return rows.select("episode_id", "tick", C.hash_of(C.encode(F.col("r"), kind, "ProposalRow")).alias("hash"))


@query("f3_action_sequence_hash", f"WITH {TR} SELECT episode_id, concat('sha256:', sha256(concat(string_agg(action_type, chr(0) ORDER BY tick), chr(0)))) AS hash FROM tr GROUP BY 1")
def action_sequence_hash(spark, sf_dir):
    s = transitions(spark, sf_dir).groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tick", "action_type"))), lambda x: x["action_type"]).alias("a"))
    return s.select("episode_id", CFO.action_sequence_hash(F.col("a")).alias("hash"))


@query(
    "f4_checkpoint_checksum",
    f"""WITH {TR} SELECT episode_id, tick, concat('sha256:', sha256(concat('0.1.0', chr(0), 'world', chr(0), '1', chr(0), tick, chr(0), state_before_hash, chr(0), action_type, chr(0), 'text', chr(0), 'main', chr(1), 'v', seed))) AS checksum FROM tr""",
)
def checkpoint_checksum(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    rng = F.create_map(F.lit("main"), F.concat(F.lit("v"), F.col("seed").cast("string")))
    checksum = CFO.checkpoint_checksum(F.lit("0.1.0"), F.lit("world"), F.lit("1"), F.col("tick"), F.col("state_before_hash"), F.col("action_type").cast("binary"), F.lit("text"), rng)
    return rows.select("episode_id", "tick", checksum.alias("checksum"))


@query(
    "f5_derived_seeds",
    f"""WITH {TR}, t AS (SELECT seed, tick, sha256(concat('M5:s12:episode_seedi', seed, 's17:parent_episode_ids', octet_length(encode(episode_id)), ':', episode_id, 's6:streams3:rngs8:protocols5:0.1.0s9:fork_ticki', tick)) AS c, sha256(concat('M3:s12:episode_seedi', seed, 's5:scopes13:policy:randoms8:protocols5:0.1.0')) AS e FROM tr WHERE tick > 0 AND tick % 5 = 0)
SELECT seed, tick, CAST(CAST(concat('0x', substr(c, 1, 16)) AS UBIGINT) AS VARCHAR) AS continuation_seed, CAST(CAST(concat('0x', substr(e, 1, 16)) AS UBIGINT) AS VARCHAR) AS policy_seed FROM t""",
)
def derived_seeds(spark, sf_dir):
    rows = transitions(spark, sf_dir).filter("tick > 0 and tick % 5 = 0")
    version = F.lit("0.1.0")
    return rows.select(
        "seed", "tick", C.continuation_seed(version, F.col("seed"), F.col("episode_id"), F.col("tick"), F.lit("rng")).cast("string").alias("continuation_seed"),
        C.episode_scope_seed(version, F.col("seed"), F.lit("policy:random")).cast("string").alias("policy_seed"),
    )


@query("f6_fingerprints", f"WITH {TR} SELECT episode_id, tick, CASE WHEN tick % 2 = 0 THEN '' ELSE concat('sha256:', sha256(concat('exo', chr(0), 's', seed, chr(0), 'main', chr(0), 't', tick, chr(0)))) END AS fingerprint FROM tr")
def fingerprints(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    bundle = F.when(F.col("tick") % 2 == 1, F.create_map(F.lit("main"), text("t", "tick"), F.lit("exo"), text("s", "seed")))
    return rows.select("episode_id", "tick", CFO.fingerprint(bundle).alias("fingerprint"))


@query(
    "f7_prompt_hashes",
    """WITH h AS (SELECT conv_id, turn, concat('sha256:', sha256('system')) AS s, concat('sha256:', sha256(concat('contract', conv_id))) AS c, concat('sha256:', sha256(role)) AS o, concat('sha256:', sha256(text)) AS u FROM conversations)
SELECT conv_id, turn, u AS user_message_hash, concat('sha256:', sha256(concat(s, c, o, u))) AS combined_prompt_hash FROM h""",
)
def prompt_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = R.prompt_hashes(F.lit("system"), F.concat(F.lit("contract"), F.col("conv_id").cast("string")), R.text_hash(F.col("role")), F.col("text"))
    return rows.select("conv_id", "turn", found["user_message_hash"].alias("user_message_hash"), found["combined_prompt_hash"].alias("combined_prompt_hash"))


@query(
    "f8_config_hash",
    f"""WITH {TR} SELECT episode_id, tick, concat('sha256:', sha256(concat('{{"fallback_mode": "noop", "max_retries": ', tick % 3, ', "max_tokens": 256, "model": "', action_type, '", "temperature": 0.0}}'))) AS config_hash,
concat('sha256:', sha256(concat('[{{"action_type": "', action_type, '", "params": {{"a": "', tick, '", "b": "x"}}}}, {{"action_type": "rest", "params": {{}}}}]'))) AS space_hash FROM tr""",
)
def config_hash(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    config = M.inference_config_hash(F.col("action_type"), F.lit("0.0"), F.lit(256), F.col("tick") % 3, F.lit("noop"))
    kind = "struct<action_type:string,params:map<string,string>>"
    actions = F.array(F.struct("action_type", F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("tick").cast("string")).alias("params")).cast(kind), F.struct(F.lit("rest").alias("action_type"), F.create_map().cast("map<string,string>").alias("params")).cast(kind))
    return rows.select("episode_id", "tick", config.alias("config_hash"), M.action_space_hash(actions).alias("space_hash"))


@query("f10_hash_bucket", f"WITH {TR}, h AS (SELECT DISTINCT agent_id AS name, sha256(agent_id) AS h FROM tr UNION SELECT DISTINCT action_type, sha256(action_type) FROM tr) SELECT name, CAST(('0x' || substr(h, 63, 2))::INTEGER % 32 AS BIGINT) AS bucket FROM h")
def hash_bucket(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    names = rows.select(F.col("agent_id").alias("name")).union(rows.select("action_type")).distinct()
    return names.select("name", C.bucket_of(F.col("name"), 32).alias("bucket"))


@query("f11_episode_family", f"WITH {CF} SELECT episode_id, regexp_replace(episode_id, '_cf_t[0-9]+_b[0-9]+$', '') AS family, regexp_matches(episode_id, '_cf_t[0-9]+_b[0-9]+$') AS is_branch FROM both_rows")
def episode_family(spark, sf_dir):
    from ..operators.splits import family, is_branch

    return with_branches(transitions(spark, sf_dir)).select("episode_id", family(F.col("episode_id")).alias("family"), is_branch(F.col("episode_id")).alias("is_branch"))


FORBIDDEN_LIST = ", ".join(f"'{w}'" for w in sorted(R.FORBIDDEN))


@query("f12_forbidden_scan", f"SELECT doc_id, array_to_string(list_filter([{FORBIDDEN_LIST}], lambda w: contains(coalesce(text, ''), w)), ',') AS hits FROM documents")
def forbidden_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(R.forbidden_hits(F.col("text")), ",").alias("hits"))


@query(
    "f13_parse_status",
    f"""WITH {TR}, s AS (SELECT episode_id, tick, tick % 5 AS k FROM tr) SELECT episode_id, tick, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'not_dict' WHEN 3 THEN 'json_decode_error' ELSE 'no_content' END AS status FROM s""",
)
def parse_status(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    k = F.col("tick") % 5
    text = F.when(k == 0, '{"action_type": "rest"}').when(k == 1, '```json\n{"action_type": "rest"}\n```').when(k == 2, "[1, 2]").when(k == 3, "I would rest {").otherwise(None)
    return rows.select("episode_id", "tick", R.parse_status(text).alias("status"))


@query("f15_file_name", f"WITH {TR} SELECT episode_id, tick, concat('t', lpad(CAST(tick AS VARCHAR), 10, '0'), '.json') AS name FROM tr")
def file_name(spark, sf_dir):
    return transitions(spark, sf_dir).select("episode_id", "tick", F.format_string("t%010d.json", F.col("tick")).alias("name"))


@query("f20_round_half_even", f"WITH {TR} SELECT episode_id, tick, round_even(d / 200.0, 0) AS rounded, round_even(d / 1000.0, 1) AS tenth FROM tr")
def round_half_even(spark, sf_dir):
    return transitions(spark, sf_dir).select("episode_id", "tick", F.rint(F.col("d") / 200.0).alias("rounded"), F.bround(F.col("d") / F.lit(1000.0), 1).alias("tenth"))


@query(
    "f23_feature_slices",
    """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS e, label FROM embeddings) SELECT vec_id, e[3] AS x2, CAST(0 AS DOUBLE) AS blanked, e[20] AS x19, list_sum(e[5:12]) AS slice_sum, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS arg_max FROM v""",
)
def feature_slices(spark, sf_dir):
    layout = X.Layout((("a", 4), ("b", 8), ("c", 52)))
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").withColumn("e", e)
    start, end = layout.range("b")
    blank = X.without_slice(F.col("e"), start, end)
    part = F.aggregate(layout.cut(F.col("e"), "b"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.element_at(blank, 3).alias("x2"), F.element_at(blank, 6).alias("blanked"), F.element_at(blank, 20).alias("x19"), part.alias("slice_sum"), X.arg_max(F.col("e")).alias("arg_max"))


@query(
    "f24_action_vector",
    f"""WITH {TR} SELECT episode_id, tick, CAST(action_type = 'click' AS DOUBLE) AS x0, CAST(action_type = 'purchase' AS DOUBLE) AS x1, CAST(action_type = 'view' AS DOUBLE) AS x2, CAST(agent_id = 'e0' AS DOUBLE) AS x3, CAST(agent_id = 'e1' AS DOUBLE) AS x4, CAST(5 + 2 * CAST(tick % 2 = 0 AS INTEGER) AS BIGINT) AS width FROM tr""",
)
def action_vector(spark, sf_dir):
    actions = F.array(*map(F.lit, ("click", "purchase", "view")))
    agents = F.array(*map(F.lit, ("e0", "e1")))
    rows = transitions(spark, sf_dir)
    state = F.when(F.col("tick") % 2 == 0, X.zeros(2))
    v = X.vector(X.one_hot(F.array_position(actions, F.col("action_type")) - 1, 3), X.one_hot(F.array_position(agents, F.col("agent_id")) - 1, 2), state)
    rows = rows.withColumn("v", v)
    return rows.select("episode_id", "tick", *[F.element_at("v", i + 1).alias(f"x{i}") for i in range(5)], F.size("v").cast("long").alias("width"))


def _hex(h, at):
    """16 hexadecimal digits of a hash as a number, in SQL."""
    return f"CAST(concat('0x', substr({h}, {at}, 16)) AS UBIGINT) % 1000"


#: A SHA-256 modulo 1000, by its four 64-bit parts; 616 is 2 ** 64 modulo 1000.
MOD_1000 = f"(((({_hex('h', 1)}) * 616 + {_hex('h', 17)}) % 1000 * 616 + {_hex('h', 33)}) % 1000 * 616 + {_hex('h', 49)}) % 1000"


def _low(text, buckets):
    """A text's bucket, for a power of two up to 256, in SQL."""
    return f"(CAST(concat('0x', substr(sha256({text}), 63, 2)) AS INTEGER) % {buckets})"


@query(
    "f25_joint_action",
    f"""WITH {TR}, s AS (SELECT *, sha256(concat('n', tick)) AS h FROM tr), n AS (SELECT *, ({MOD_1000}) / 1000.0 AS share FROM s)
SELECT episode_id, tick, """
    + ", ".join(
        f"CAST(CASE WHEN agent_id = '{a}' THEN {v} ELSE 0 END AS DOUBLE) AS x{5 * i + j}"
        for i, a in enumerate(("e0", "e1"))
        for j, v in enumerate(("CAST(action_type = 'click' AS INTEGER)", "CAST(action_type = 'view' AS INTEGER)", "share", "1", "1"))
    )
    + " FROM n",
)
def joint_action(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    executed = F.create_map(F.col("agent_id"), F.struct(F.col("action_type"), F.create_map(F.lit("target_node"), F.concat(F.lit("n"), F.col("tick").cast("string")), F.lit("target_agent"), F.lit("e1")).alias("params")))
    rows = rows.withColumn("x", X.joint_action(executed, ("e0", "e1"), ("click", "view")))
    return rows.select("episode_id", "tick", *[F.element_at("x", i + 1).alias(f"x{i}") for i in range(10)])


@query(
    "f27_state_blocks",
    f"""WITH {TR}, b AS (SELECT *, {_low("CAST(energy_after AS VARCHAR)", 8)} AS f0, 8 + {_low("action_type", 8)} % 4 AS f1, ({_low("agent_id", 4)} + {_low("action_type", 4)} + {_low("'did'", 4)}) % 4 AS g, {_low("outcome_code", 8)} % 4 AS r FROM tr)
SELECT episode_id, tick, concat(f0, ',', f1) AS fields, CAST(d AS DOUBLE) AS e0, CAST({_low("agent_id", 8)} AS DOUBLE) AS e1, CAST(0 AS DOUBLE) AS e2, CAST(tick AS DOUBLE) AS e3, CAST({_low("action_type", 8)} AS DOUBLE) AS e4, CAST(0 AS DOUBLE) AS e5,
{", ".join(f"CASE WHEN g = {i} THEN 1.5 ELSE 0.0 END::DOUBLE AS g{i}" for i in range(4))}, CAST(r AS VARCHAR) AS registries, CAST(1 AS DOUBLE) AS p0, CAST(0 AS DOUBLE) AS p2 FROM b""",
)
def state_blocks(spark, sf_dir):
    """All five blocks of a state; blocks of marks as the places of their ones."""
    marks = lambda block: F.array_join(F.filter(F.transform(block, lambda x, i: F.when(x == 1.0, i)), lambda i: i.isNotNull()), ",")
    rows = transitions(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    edges = F.array(F.struct(F.col("agent_id").alias("src"), F.col("action_type").alias("dst"), F.lit("did").alias("edge_type"), F.lit(1.5).alias("weight")))
    rows = rows.select(
        "episode_id", "tick", X.field_block(F.create_map(F.lit("energy"), text("energy_after"), F.lit("kind"), F.col("action_type")), 12, 8).alias("fields"),
        X.entity_block(F.array(F.array(text("d"), F.col("agent_id")), F.array(text("tick"), F.col("action_type"))), 6, 8).alias("e"), X.graph_block(edges, 4).alias("g"),
        X.registry_block(F.array("outcome_code"), 4, 8).alias("registries"), X.population_block(F.array("agent_id"), 3).alias("p"),
    )
    places = [F.element_at(b, i + 1).alias(f"{b}{i}") for b, n in (("e", range(6)), ("g", range(4)), ("p", (0, 2))) for i in n]
    return rows.select("episode_id", "tick", marks("fields").alias("fields"), marks("registries").alias("registries"), *places)


@query("f30_numeric_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def numeric_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    fields = X.numeric_fields(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type"))))
    return rows.select("event_id", F.element_at(fields, "k").alias("k"))


@query(
    "f31_param_types",
    f"""WITH {TR} SELECT episode_id, tick, CASE tick % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' WHEN 3 THEN 'null' ELSE 'string' END AS kind FROM tr""",
)
def param_types(spark, sf_dir):
    k = F.col("tick") % 5
    value = F.when(k == 0, F.col("tick").cast("string")).when(k == 1, "1.5").when(k == 2, "true").when(k == 3, "null").otherwise('"node"')
    return transitions(spark, sf_dir).select("episode_id", "tick", R.type_name(value).alias("kind"))


@query("f39_exogenous_hash", f"WITH {TR} SELECT episode_id, tick, CASE WHEN action_type = 'signup' THEN concat('sha256:', sha256(concat('(2:i', tick, 's6:signup'))) ELSE 'none' END AS exogenous_hash FROM tr")
def exogenous_hash(spark, sf_dir):
    text = F.concat(F.lit("(2:i"), F.col("tick").cast("string"), F.lit("s"), C.sized(F.col("action_type")))
    found = F.when(F.col("action_type") == "signup", C.hash_of(text))
    return transitions(spark, sf_dir).select("episode_id", "tick", F.coalesce(found, F.lit("none")).alias("exogenous_hash"))


# -- telemetry --------------------------------------------------------------
ATTEMPTS = """att AS (SELECT conv_id AS decision_id, turn AS attempt_index, turn * 2.0 AS started_at, turn * 2.0 + (octet_length(encode(text)) % 100) / 10.0 AS finished_at, (octet_length(encode(text)) % 100) * 100.0 AS latency_ms, (turn % 4) * 500.0 AS retry_backoff_ms,
  octet_length(encode(text)) AS input_tokens, length(text) % 50 AS output_tokens, turn % 2 AS cached_tokens, CASE turn % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'fake' ELSE 'mock' END AS effective_backend, turn % 3 = 2 AS mock_call, CASE WHEN conv_id % 2 = 0 THEN 'real' ELSE 'fake' END AS requested_backend,
  CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'LLMAuthError' END AS error_category, CASE conv_id % 3 WHEN 0 THEN 'fallback' ELSE 'llm' END AS final_origin FROM conversations),
de AS (SELECT decision_id, count(*) AS attempt_count, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(cached_tokens) AS BIGINT) AS total_cached_tokens, CAST(sum(retry_backoff_ms) AS DOUBLE) AS retry_backoff_total_ms,
  CAST(greatest(0.0, max(finished_at) - arg_min(started_at, attempt_index)) * 1000 AS DOUBLE) AS total_latency_ms, CASE WHEN bool_or(effective_backend = 'mock') THEN 'mock' WHEN bool_or(effective_backend = 'fake') THEN 'fake' ELSE 'real' END AS effective_backend,
  count(*) FILTER (mock_call) AS mock_calls, bool_or(coalesce(error_category = 'LLMAuthError', false)) AS auth_error, arg_max(requested_backend, attempt_index) AS requested_backend, arg_max(final_origin, attempt_index) AS final_origin FROM att GROUP BY 1)"""


def attempts(spark, sf_dir):
    """Conversation turns read as inference attempts."""
    turn, size = F.col("turn"), F.octet_length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("decision_id"), turn.alias("attempt_index"), (turn * 2.0).alias("started_at"), (turn * 2.0 + (size % 100) / 10.0).alias("finished_at"), ((size % 100) * 100.0).alias("latency_ms"),
        ((turn % 4) * 500.0).alias("retry_backoff_ms"), size.alias("input_tokens"), (F.length("text") % 50).alias("output_tokens"), (turn % 2).alias("cached_tokens"),
        F.when(turn % 3 == 0, "real").when(turn % 3 == 1, "fake").otherwise("mock").alias("effective_backend"), (turn % 3 == 2).alias("mock_call"),
        F.when(F.col("conv_id") % 2 == 0, "real").otherwise("fake").alias("requested_backend"), F.when((F.col("conv_id") % 5 == 0) & (turn == 0), "LLMAuthError").alias("error_category"),
        F.when(F.col("conv_id") % 3 == 0, "fallback").otherwise("llm").alias("final_origin"),
    )


@query("ag21_decisions", f"WITH {ATTEMPTS} SELECT * FROM de")
def decisions(spark, sf_dir):
    return M.decisions(attempts(spark, sf_dir))


@query("ag23_latency_split", f"WITH {ATTEMPTS} SELECT (SELECT avg(latency_ms) FROM att) AS provider_per_attempt_ms, sum(retry_backoff_total_ms) AS retry_backoff_total_ms, avg(total_latency_ms) AS decision_end_to_end_ms, coalesce(avg(total_latency_ms) FILTER (final_origin = 'fallback'), 0) AS fallback_decision_ms, coalesce(avg(total_latency_ms) FILTER (final_origin = 'llm'), 0) AS successful_llm_origin_ms FROM de")
def latency_split(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    return M.latency_split(M.decisions(rows), rows)


@query("ag24_effective_backend", f"WITH {ATTEMPTS} SELECT decision_id, CASE WHEN count(*) FILTER (mock_call) > 0 THEN 'mock' WHEN bool_or(effective_backend = 'fake') THEN 'fake' WHEN bool_and(effective_backend = 'real') THEN 'real' ELSE max(requested_backend) END AS backend, count(*) FILTER (mock_call) AS mock_calls FROM att GROUP BY 1")
def effective_backend(spark, sf_dir):
    return M.effective_backend(attempts(spark, sf_dir))


@query("ag25_fallback_gate", f"WITH {ATTEMPTS} SELECT avg(CAST(final_origin = 'fallback' AS INTEGER)) AS fallback_rate, CAST(0.5 AS DOUBLE) AS fallback_rate_max, avg(CAST(final_origin = 'fallback' AS INTEGER)) <= 0.5 AS ok FROM de")
def fallback_gate(spark, sf_dir):
    return M.fallback_gate(M.decisions(attempts(spark, sf_dir)), "smoke")


@query(
    "dp19_evidence",
    f"""WITH {ATTEMPTS} SELECT decision_id, CASE WHEN requested_backend = 'real' THEN CASE WHEN effective_backend <> 'real' THEN 'backend_not_real' WHEN mock_calls > 0 THEN 'mock_calls' WHEN auth_error THEN 'auth_error' WHEN final_origin = 'fallback' THEN 'fallback' END END AS reason FROM de""",
)
def evidence(spark, sf_dir):
    return M.decisions(attempts(spark, sf_dir)).select("decision_id", M.evidence_violation("evidence").alias("reason"))
