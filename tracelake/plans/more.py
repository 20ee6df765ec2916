"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import counterfactual as CFO
from ..operators import delta as D
from ..operators import joins as J
from ..operators import joint as JT
from ..operators import predicates as P
from ..operators import prompts as R
from ..operators import records as REC
from ..operators import splits as S
from ..operators import telemetry as M
from ..registry import query, table
from ..sources import environments as ENV
from ..trajectory import CF, EP, TR, branches, episodes, split_of, transitions, with_branches
from .engine import flawed, moved
from .tables import ATTEMPTS, PARTS, _parts, attempts

STEPS = f"{TR}, g AS (SELECT episode_id, tick // 4 AS step, list_sort(list(DISTINCT agent_id)) AS agents, min(agent_id) AS first_agent, arg_max(agent_id, tick) AS last_agent FROM tr GROUP BY ALL)"


def _steps(spark, sf_dir):
    rows = transitions(spark, sf_dir).groupBy("episode_id", F.floor(F.col("tick") / 4).alias("step"))
    return rows.agg(F.collect_set("agent_id").alias("agents"), F.max_by("agent_id", "tick").alias("last_agent")).withColumn("candidates", F.map_from_arrays("agents", F.transform("agents", lambda a: F.lit("act"))))


@query("pf2_first_agent", f"WITH {STEPS} SELECT episode_id, step, first_agent FROM g")
def first_agent(spark, sf_dir):
    return _steps(spark, sf_dir).select("episode_id", "step", P.first_agent(F.col("candidates")).alias("first_agent"))


@query("pf5_candidate_rank", f"WITH {STEPS} SELECT episode_id, step, CAST(CASE WHEN len(agents) <= 1 THEN 0 ELSE list_position(agents, last_agent) END AS BIGINT) AS rank FROM g")
def candidate_rank(spark, sf_dir):
    return _steps(spark, sf_dir).select("episode_id", "step", P.candidate_rank(F.col("candidates"), F.col("last_agent")).alias("rank"))


@query("pf10_finite", f"WITH {TR}, x AS (SELECT seed, CASE tick % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE ELSE CAST(d AS DOUBLE) END AS v FROM tr) SELECT seed, count(*) FILTER (v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)) AS n FROM x GROUP BY seed")
def finite(spark, sf_dir):
    k = F.col("tick") % 4
    v = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, F.col("d").cast("double"))
    return transitions(spark, sf_dir).withColumn("v", v).groupBy("seed").agg(F.count_if(P.finite(F.col("v"))).alias("n"))


@query("pf16_counterfactual_rows", f"WITH {CF} SELECT policy_id = 'counterfactual_branch' OR regexp_matches(episode_id, '_cf_t[0-9]+_b[0-9]+$') AS branch, count(*) AS n FROM both_rows GROUP BY 1")
def counterfactual_rows(spark, sf_dir):
    return with_branches(transitions(spark, sf_dir)).groupBy(P.is_counterfactual(F.col("policy_id"), F.col("episode_id")).alias("branch")).agg(F.count("*").alias("n"))


@query("j5_same_keys", f"WITH {STEPS}, n AS (SELECT *, lead(agents) OVER (PARTITION BY episode_id ORDER BY step) AS nxt FROM g) SELECT episode_id, step, agents = nxt AS same FROM n WHERE nxt IS NOT NULL")
def same_keys(spark, sf_dir):
    from pyspark.sql import Window

    rows = _steps(spark, sf_dir).withColumn("nxt", F.lead("candidates").over(Window.partitionBy("episode_id").orderBy("step")))
    return rows.filter("nxt is not null").select("episode_id", "step", J.same_keys(F.col("candidates"), F.col("nxt")).alias("same"))


@query("j7_undeclared_policies", f"WITH {CF} SELECT DISTINCT policy_id FROM both_rows WHERE policy_id NOT IN ('random', 'adversarial')")
def undeclared_policies(spark, sf_dir):
    from ..operators.dataset import undeclared_policies as found

    return found(with_branches(transitions(spark, sf_dir)), spark.createDataFrame([("random",), ("adversarial",)], "policy_id string"))


@query(
    "ag22_all_decisions",
    f"WITH {ATTEMPTS.replace(' FROM conversations)', ' FROM conversations WHERE turn >= 2)', 1)}, a AS (SELECT DISTINCT conv_id AS decision_id FROM conversations) SELECT a.decision_id, coalesce(attempt_count, 0) AS attempt_count, coalesce(de.effective_backend, 'real') AS effective_backend, coalesce(mock_calls, 0) AS mock_calls FROM a LEFT JOIN de USING (decision_id)",
)
def all_decisions(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    every = rows.select("decision_id").distinct().select("decision_id", F.lit("real").alias("requested_backend"), F.lit("llm").alias("final_origin"))
    return M.with_decisions(every, rows.filter("attempt_index >= 2")).select("decision_id", "attempt_count", "effective_backend", "mock_calls")


@query(
    "sl2_change_order",
    f"""WITH {PARTS}, j AS (SELECT CAST(coalesce(b.k, a.k) AS VARCHAR) AS entity_id, CASE WHEN b.k IS NULL THEN 'add' WHEN a.k IS NULL THEN 'remove' ELSE 'update' END AS kind FROM b FULL JOIN a ON a.k = b.k WHERE b.k IS NULL OR a.k IS NULL OR a.quantity <> b.quantity)
SELECT entity_id, kind FROM j ORDER BY CASE kind WHEN 'remove' THEN 0 WHEN 'add' THEN 2 ELSE 1 END, entity_id LIMIT 20""",
)
def change_order(spark, sf_dir):
    """The first of a change list in its order (a report of twenty)."""
    found = D.entity_changes(*_parts(spark, sf_dir), "k", ["quantity"])
    return found.orderBy(V.change_order(F.col("kind")), "entity_id").limit(20).select("entity_id", "kind")


@query("sl5_planner", f"WITH {TR} SELECT episode_id, tick, CASE WHEN d % 7 >= d % 5 AND d % 7 >= d % 3 THEN 'a' WHEN d % 5 >= d % 3 THEN 'b' ELSE 'c' END AS choice FROM tr")
def planner(spark, sf_dir):
    actions = F.array(*[F.struct(F.lit(n).alias("action_type"), (F.col("d") % k).alias("score")) for n, k in (("a", 7), ("b", 5), ("c", 3))])
    return transitions(spark, sf_dir).select("episode_id", "tick", V.best_action(actions).alias("choice"))


@query("sl6_first_violations", f"WITH {EP}, k AS (SELECT split, CAST(seed % 4 AS VARCHAR) AS key FROM ep) SELECT 'group' AS kind, key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM k GROUP BY key HAVING count(DISTINCT split) > 1 ORDER BY key LIMIT 20")
def first_violations(spark, sf_dir):
    rows = episodes(transitions(spark, sf_dir)).withColumn("split", split_of(F.col("seed")))
    return S.crossings(rows, {"group": F.col("seed") % 4}).orderBy("kind", "key").limit(20).withColumn("splits", F.array_join("splits", ","))


@query("f14_error_status", f"WITH {TR} SELECT episode_id, tick, CASE tick % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'json_decode_error' WHEN 2 THEN 'not_dict' ELSE 'no_content' END AS status FROM tr")
def error_status(spark, sf_dir):
    k = F.col("tick") % 4
    error = F.when(k == 1, "json_decode_error: line 1").when(k == 2, "json_not_object: got list").when(k == 3, "empty")
    return transitions(spark, sf_dir).select("episode_id", "tick", R.error_status(error, k == 0).alias("status"))


@query(
    "f16_references",
    f"""WITH {TR} SELECT episode_id, tick, CASE tick % 6 WHEN 0 THEN agent_id WHEN 1 THEN CAST(energy_before AS VARCHAR) WHEN 2 THEN CAST(d AS VARCHAR) WHEN 3 THEN CAST(d AS VARCHAR) WHEN 4 THEN 'plain' END AS value FROM tr""",
)
def references(spark, sf_dir):
    k = F.col("tick") % 6
    text = F.when(k == 0, "$entity.id").when(k == 1, "$entity.energy").when(k == 2, "$param.amount").when(k == 3, "$amount").when(k == 4, "plain").otherwise("$missing")
    params, entity = (F.create_map(F.lit(n), F.col(c).cast("string")) for n, c in (("amount", "d"), ("energy", "energy_before")))
    return transitions(spark, sf_dir).select("episode_id", "tick", V.resolve(text, F.col("agent_id"), params, entity).alias("value"))


@query("f19_rounded", f"WITH {TR} SELECT episode_id, tick, round_even(d / 300.0, 12) + 0.0 AS x FROM tr")
def rounded(spark, sf_dir):
    return transitions(spark, sf_dir).select("episode_id", "tick", V.rounded(F.col("d") / F.lit(300.0)).alias("x"))


@query("f28_nested_arithmetic", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) + 2.5 AS a, CAST(embedding[34] AS DOUBLE) + 2.5 AS b, CAST(7 AS DOUBLE) AS c FROM embeddings")
def nested_arithmetic(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").withColumn("e", e).withColumn("m", F.array(F.slice("e", 1, 32), F.slice("e", 33, 32)))
    rows = rows.withColumn("added", V.add_nested(F.col("m"), F.lit(2.5))).withColumn("put", V.set_nested(F.col("m"), F.lit(7.0)))
    return rows.select("vec_id", F.col("added")[0][0].alias("a"), F.col("added")[1][1].alias("b"), F.col("put")[1][31].alias("c"))


@query("f32_scalar_params", f"WITH {TR} SELECT episode_id, tick, CASE tick % 3 WHEN 0 THEN '\"[1, 2]\"' WHEN 1 THEN '1.5' ELSE 'true' END AS value FROM tr")
def scalar_params(spark, sf_dir):
    k = F.col("tick") % 3
    params = F.create_map(F.lit("p"), F.when(k == 0, "[1, 2]").when(k == 1, "1.5").otherwise("true"))
    return transitions(spark, sf_dir).select("episode_id", "tick", F.element_at(R.scalar_params(params), "p").alias("value"))


@query("f33_sorted_json", f"""WITH {TR} SELECT episode_id, tick, concat('{{"a":"', action_type, '","b":"', tick, '"}}') AS json FROM tr""")
def sorted_json(spark, sf_dir):
    entries = F.create_map(F.lit("b"), F.col("tick").cast("string"), F.lit("a"), F.col("action_type"))
    return transitions(spark, sf_dir).select("episode_id", "tick", V.sorted_json(entries).alias("json"))


@query("f35_rule_counts", f"WITH {TR} SELECT count(*) AS present, count(*) AS version, count(*) AS receipts_complete, count(*) FILTER (event_id % 89 <> 5) AS outcome_codes, count(*) AS grounded, count(*) AS tick, count(*) AS producer FROM tr")
def rule_counts(spark, sf_dir):
    return flawed(transitions(spark, sf_dir)).agg(*[F.count_if(rule).alias(name) for name, rule in REC.schema_rules().items()])


@query("st20_held_fixed", f"WITH {CF} SELECT c.seed, c.tick, c.episode_id, c.event_id % 31 <> 0 AS state_before_hash_fixed, c.agent_id = t.agent_id AS agent_id_fixed, c.event_id % 31 <> 0 AND c.agent_id = t.agent_id AS held_fixed FROM cf c JOIN tr t ON c.seed = t.seed AND c.tick = t.tick")
def held_fixed(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    return CFO.verify_held_fixed(rows, moved(branches(rows)), ["state_before_hash", "agent_id"])


@query("st24_joint_validation", f"WITH {STEPS} SELECT episode_id, step, CASE WHEN list_contains(agents, 'e0') THEN 'act' ELSE 'stay' END AS e0, CASE WHEN list_contains(agents, 'e3') THEN CASE WHEN step % 2 = 0 THEN 'act' ELSE 'noop' END ELSE 'noop' END AS e3 FROM g")
def joint_validation(spark, sf_dir):
    """Agents that propose nothing stay; illegal actions (every other step of e3) become no-ops."""
    active = F.array(F.lit("e0"), F.lit("e3"))
    rows = _steps(spark, sf_dir).withColumn("filled", JT.filled(F.col("candidates"), active, "stay"))
    legal = F.create_map(F.lit("e0"), F.array(F.lit("act"), F.lit("stay")), F.lit("e3"), F.when(F.col("step") % 2 == 0, F.array(F.lit("act"))).otherwise(F.array(F.lit("none"))))
    rows = rows.withColumn("out", JT.legal_or(F.col("filled"), legal))
    return rows.select("episode_id", "step", F.element_at("out", "e0").alias("e0"), F.element_at("out", "e3").alias("e3"))


@query("st27_observed_position", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS vx, CASE WHEN vec_id % 2 = 0 THEN CAST(embedding[4] AS DOUBLE) ELSE 0 END AS vy FROM embeddings")
def observed_position(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").withColumn("o", F.when(F.col("vec_id") % 2 == 0, e).otherwise(F.slice(e, 1, 3)))
    p, v = ENV.position(F.col("o")), ENV.velocity(F.col("o"))
    return rows.select("vec_id", p[0].alias("x"), p[1].alias("y"), v[0].alias("vx"), v[1].alias("vy"))


@query("h11_group_key", f"WITH {CF} SELECT DISTINCT CAST(seed AS VARCHAR) AS group_seed, regexp_replace(episode_id, '_cf_t[0-9]+_b[0-9]+$', '') AS family FROM both_rows")
def group_key(spark, sf_dir):
    return S.group_key(with_branches(transitions(spark, sf_dir))).select("group_seed", "family").distinct()


@query("st14_slot_delta", f"WITH {STEPS}, n AS (SELECT *, CASE WHEN step % 3 = 0 THEN NULL ELSE agents END AS b, CASE WHEN step % 4 = 0 THEN NULL WHEN step % 4 = 1 THEN agents ELSE ['e9'] END AS a FROM g) SELECT episode_id, step, CASE WHEN b IS NULL AND a IS NULL THEN 'absent' WHEN a IS NULL THEN 'cleared' WHEN b IS NULL THEN 'set' WHEN a = b THEN 'same' ELSE 'changed' END AS kind, array_to_string(a, ',') AS after FROM n")
def slot_delta(spark, sf_dir):
    """Events and other whole slots: what became of them, and that applying it gives the slot after."""
    agents = F.array_sort("agents")
    rows = _steps(spark, sf_dir).select("episode_id", "step", F.when(F.col("step") % 3 != 0, agents).alias("b"), F.when(F.col("step") % 4 == 1, agents).when(F.col("step") % 4 != 0, F.array(F.lit("e9"))).alias("a"))
    rows = rows.withColumn("kind", D.slot_delta(F.col("b"), F.col("a")))
    return rows.select("episode_id", "step", "kind", F.array_join(D.apply_slot(F.col("b"), F.col("kind"), F.col("a")), ",").alias("after"))
