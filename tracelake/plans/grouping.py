"""Queries of splits, leakage, coverage, ranking and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping as G
from ..operators import predicates as P
from ..operators import ranking as R
from ..operators import splits as S
from ..operators import windows as W
from ..registry import query, table
from ..trajectory import CF, EP, SPLIT_SQL, TR, branches, episodes, split_of, transitions, with_branches



def _coverage_keys():
    return {"policy_usage": F.col("policy_id"), "action_type": F.col("action_type"), "outcome_code": F.col("outcome_code"), "agent_action": F.col("agent_id")}


COVERAGE_SQL = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {c} AS key, count(*) AS count FROM tr GROUP BY {c}" for d, c in (("policy_usage", "policy_id"), ("action_type", "action_type"), ("outcome_code", "outcome_code"), ("agent_action", "agent_id"))
)


@query("ag1_coverage", f"WITH {TR} {COVERAGE_SQL}")
def coverage(spark, sf_dir):
    return G.coverage(transitions(spark, sf_dir), _coverage_keys())


@query(
    "ag2_recount",
    f"WITH {TR} SELECT 'outcome_code' AS dimension, outcome_code AS key, count(*) AS count FROM tr WHERE outcome_code <> 'ok' GROUP BY ALL UNION ALL SELECT 'agent', agent_id, count(*) FROM tr GROUP BY ALL",
)
def recount(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    return G.coverage(rows, {"outcome_code": F.when(F.col("outcome_code") == "ok", "").otherwise(F.col("outcome_code")), "agent": F.col("agent_id")})


def _leakage_input(spark, sf_dir):
    found = episodes(transitions(spark, sf_dir))
    return found.select("episode_id", split_of(F.col("seed")).alias("split")), found


LEAKAGE_SQL = f"""{EP}, k AS (
  SELECT split, 'seed' AS kind, CAST(seed AS VARCHAR) AS key FROM ep UNION ALL SELECT split, 'scenario', scenario_id FROM ep
  UNION ALL SELECT split, 'world_param', world_parameters_hash FROM ep UNION ALL SELECT split, 'branch_group', branch_group_id FROM ep WHERE branch_group_id IS NOT NULL),
v AS (SELECT kind, key, list_sort(list(DISTINCT split)) AS splits FROM k GROUP BY kind, key HAVING count(DISTINCT split) > 1)"""


@query("ag3_leakage", f"WITH {LEAKAGE_SQL} SELECT kind, key, array_to_string(splits, ',') AS splits, concat(kind, ' ', key, ' appears in splits ', array_to_string(splits, ', ')) AS description FROM v")
def leakage(spark, sf_dir):
    return S.leakage(*_leakage_input(spark, sf_dir)).withColumn("splits", F.array_join("splits", ","))


@query("ag4_leakage_by_kind", f"WITH {LEAKAGE_SQL} SELECT kind, count(*) AS count FROM v GROUP BY kind")
def leakage_by_kind(spark, sf_dir):
    return S.leakage(*_leakage_input(spark, sf_dir)).groupBy("kind").count()


@query(
    "dp5_leakage_report",
    f"WITH {LEAKAGE_SQL}, s AS (SELECT kind, key, splits FROM v WHERE kind IN ('seed', 'branch_group')) SELECT count(*) = 0 AS ok, count(*) AS violation_count, 'seed,branch_group' AS checked FROM s",
)
def leakage_report(spark, sf_dir):
    kinds = ("seed", "branch_group")
    found = S.leakage_report(S.leakage(*_leakage_input(spark, sf_dir), kinds), kinds)
    return found.select("ok", "violation_count", F.array_join("checked_kinds", ",").alias("checked"))


@query(
    "ag5_group_leakage",
    f"""WITH {CF}, s AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'test' ELSE 'train' END AS split, regexp_replace(episode_id, '_cf_t[0-9]+_b[0-9]+$', '') AS family FROM both_rows),
k AS (SELECT split, 'seed' AS kind, CAST(seed AS VARCHAR) AS key FROM s UNION ALL SELECT split, 'family', family FROM s UNION ALL SELECT split, 'fork', concat_ws('|', seed, tick, state_before_hash) FROM s)
SELECT kind, key, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM k GROUP BY kind, key HAVING count(DISTINCT split) > 1""",
)
def group_leakage(spark, sf_dir):
    """A split by row parts seeds, families and fork points; this finds them all."""
    rows = with_branches(transitions(spark, sf_dir)).withColumn("split", F.when(F.col("event_id") % 17 == 0, "test").otherwise("train"))
    return S.group_leakage(rows).withColumn("splits", F.array_join("splits", ","))


@query(
    "ag6_sibling_purity",
    f"""WITH {CF}, s AS (SELECT {SPLIT_SQL} AS split, regexp_replace(episode_id, '_cf_t[0-9]+_b[0-9]+$', '') AS family FROM both_rows)
SELECT family AS key, CAST(count(DISTINCT split) AS BIGINT) AS splits FROM s GROUP BY family""",
)
def sibling_purity(spark, sf_dir):
    rows = with_branches(transitions(spark, sf_dir)).select(S.family(F.col("episode_id")).alias("key"), split_of(F.col("seed")).alias("split"))
    return rows.groupBy("key").agg(F.count_distinct("split").alias("splits"))


@query("ag7_seed_disjointness", f"WITH {EP} SELECT world_parameters_hash AS key, count(DISTINCT split) AS splits, count(*) AS episodes FROM ep GROUP BY 1 HAVING count(DISTINCT split) > 1")
def seed_disjointness(spark, sf_dir):
    rows = episodes(transitions(spark, sf_dir)).withColumn("split", split_of(F.col("seed")))
    found = rows.groupBy(F.col("world_parameters_hash").alias("key")).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("episodes"))
    return found.filter("splits > 1")


@query(
    "ag8_provenance",
    f"""WITH {CF} SELECT regexp_replace(episode_id, '_cf_t[0-9]+_b[0-9]+$', '') AS episode_id, count(DISTINCT seed) AS seeds, count(*) FILTER (policy_id IS NOT NULL AND seed IS NOT NULL) AS complete,
count(*) FILTER (state_after_hash IS NULL) AS without_after FROM both_rows GROUP BY 1""",
)
def provenance(spark, sf_dir):
    rows = with_branches(transitions(spark, sf_dir)).withColumn("episode_id", S.family(F.col("episode_id")))
    return rows.groupBy("episode_id").agg(
        F.count_distinct("seed").alias("seeds"), F.count_if(F.col("policy_id").isNotNull() & F.col("seed").isNotNull()).alias("complete"), F.count_if(F.col("state_after_hash").isNull()).alias("without_after")
    )


@query(
    "ag9_episode_outcomes",
    f"""WITH {CF}, o AS (SELECT episode_id, tick, energy_after - energy_before AS outcome FROM both_rows WHERE NOT contains(episode_id, '_cf_')
UNION ALL SELECT episode_id, min(tick), CAST(sum(d) AS BIGINT) FROM both_rows WHERE contains(episode_id, '_cf_') GROUP BY episode_id) SELECT episode_id, tick, outcome FROM o""",
)
def episode_outcomes(spark, sf_dir):
    rows = with_branches(transitions(spark, sf_dir)).withColumn("receipt_delta", F.col("d")).withColumn("realized_delta", F.col("energy_after") - F.col("energy_before"))
    return R.episode_outcomes(rows)


@query(
    "ag10_mean_delta",
    f"""WITH {TR}, s AS (SELECT *, {SPLIT_SQL} AS split FROM tr), m AS (SELECT action_type, agent_id, avg(d) AS m FROM s WHERE split = 'train' GROUP BY ALL), g AS (SELECT avg(d) AS g FROM s WHERE split = 'train')
SELECT episode_id, tick, coalesce(m, g) AS prediction FROM s LEFT JOIN m USING (action_type, agent_id), g WHERE split = 'test'""",
)
def mean_delta(spark, sf_dir):
    from ..operators.baselines import MeanDelta

    rows = transitions(spark, sf_dir).withColumn("split", split_of(F.col("seed")))
    model = MeanDelta(["action_type", "agent_id"], ["d"]).fit(rows.filter("split = 'train'"))
    return model.predict(rows.filter("split = 'test'")).select("episode_id", "tick", F.col("pred_d").alias("prediction"))


@query("ag11_mode", f"WITH {TR}, c AS (SELECT agent_id, d % 10 AS v, count(*) AS n FROM tr GROUP BY ALL) SELECT agent_id, v FROM c QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY n DESC, v) = 1")
def mode(spark, sf_dir):
    return G.mode_of(transitions(spark, sf_dir).withColumn("v", F.col("d") % 10), "v", ["agent_id"])


@query(
    "ag12_normal_equations",
    f"""WITH {TR}, x AS (SELECT CAST(tick AS DOUBLE) AS x0, CAST(event_id % 4 AS DOUBLE) AS x1, CAST(action_type = 'purchase' AS INTEGER) AS x2, d / 100.0 AS y FROM tr)
SELECT sum(x0 * x0) AS a00, sum(x0 * x1) AS a01, sum(x0 * x2) AS a02, sum(x0) AS a03, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x1) AS a13, CAST(sum(x2 * x2) AS DOUBLE) AS a22, CAST(sum(x2) AS DOUBLE) AS a23,
CAST(count(*) AS DOUBLE) AS a33, sum(x0 * y) AS b0, sum(x1 * y) AS b1, sum(x2 * y) AS b2, sum(y) AS b3 FROM x""",
)
def normal_equations(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    x = [F.col("tick").cast("double"), (F.col("event_id") % 4).cast("double"), (F.col("action_type") == "purchase").cast("double")]
    a, b = G.normal_equations(rows, x, F.col("d") / 100.0)
    values = {f"a{i}{j}": float(a[i, j]) for i in range(4) for j in range(i, 4)} | {f"b{i}": float(b[i]) for i in range(4)}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))


@query(
    "ag13_metrics",
    """SELECT avg(abs(quality - toxic)) AS mae, avg(CAST(round_even(quality * 0.5, 0) = round_even(toxic * 0.5, 0) AS INTEGER)) AS accuracy, count(*) AS n,
avg(CASE WHEN doc_id % 5 > 0 THEN CASE WHEN quality > 0 THEN 1 / log2(doc_id % 5 + 1) ELSE 0 END END) AS ndcg FROM labels""",
)
def metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    rank = F.col("doc_id") % 5
    return rows.agg(
        G.mae(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("mae"), G.accuracy(F.col("quality") * 0.5, F.col("toxic") * 0.5).alias("accuracy"), F.count("*").alias("n"), G.ndcg_proxy(rank, F.col("quality")).alias("ndcg")
    )


RANKED = f"""{CF}, p AS (SELECT *, CAST((event_id * 7 + length(episode_id) * 13 + d) % 101 AS DOUBLE) AS p, CAST(d AS DOUBLE) AS t FROM both_rows),
g AS (SELECT seed, tick, state_before_hash, count(*) AS n, max(t) AS best, sum(abs(t - p)) AS err FROM p GROUP BY ALL HAVING count(*) >= 2),
top AS (SELECT seed, tick, state_before_hash, t AS chosen FROM p QUALIFY row_number() OVER (PARTITION BY seed, tick, state_before_hash ORDER BY p DESC, episode_id) = 1),
pairs AS (SELECT a.t - b.t AS dt, a.p - b.p AS dp FROM p a JOIN p b ON a.seed = b.seed AND a.tick = b.tick AND a.state_before_hash = b.state_before_hash AND a.episode_id < b.episode_id)"""


@query(
    "ag16_ranking_metrics",
    f"""WITH {RANKED}, x AS (SELECT count(*) FILTER (abs(dt) > 1e-9) AS told, count(*) FILTER (abs(dt) > 1e-9 AND dt * dp > 0) AS agree FROM pairs)
SELECT avg(CASE WHEN best - chosen <= 1e-9 THEN 1.0 ELSE 0.0 END) AS ranking_accuracy, CAST(sum(err) / sum(n) AS DOUBLE) AS energy_mae, avg(best - chosen) AS top1_regret,
(SELECT CAST(agree AS DOUBLE) / told FROM x) AS direction_consistency, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_candidates FROM g JOIN top USING (seed, tick, state_before_hash)""",
)
def ranking_metrics(spark, sf_dir):
    return R.evaluate(R.with_prediction(with_branches(transitions(spark, sf_dir))), "d", "pred")


@query("dp18_ranking_groups", f"WITH {CF} SELECT seed, tick, state_before_hash, array_to_string(list_sort(list(episode_id)), '|') AS members, count(*) AS size FROM both_rows GROUP BY seed, tick, state_before_hash HAVING count(*) >= 2")
def ranking_groups(spark, sf_dir):
    found = R.groups(with_branches(transitions(spark, sf_dir)))
    return found.select("seed", "tick", "state_before_hash", F.array_join("members", "|").alias("members"), F.size("members").cast("long").alias("size"))


@query("j14_candidate_pairs", f"""WITH {CF} SELECT a.seed, a.tick, a.state_before_hash, a.episode_id AS a, b.episode_id AS b, CAST(sign(a.d - b.d) AS DOUBLE) AS true_sign,
CAST(sign((a.event_id * 7 + length(a.episode_id) * 13 + a.d) % 101 - (b.event_id * 7 + length(b.episode_id) * 13 + b.d) % 101) AS DOUBLE) AS pred_sign
FROM both_rows a JOIN both_rows b ON a.seed = b.seed AND a.tick = b.tick AND a.state_before_hash = b.state_before_hash AND a.episode_id < b.episode_id""")
def candidate_pairs(spark, sf_dir):
    return R.candidate_pairs(R.with_prediction(with_branches(transitions(spark, sf_dir))), "d", "pred")


@query(
    "ag17_paired_diffs",
    f"""WITH {CF}, m AS (SELECT seed, avg(CASE WHEN policy_id = 'counterfactual_branch' THEN d END) - avg(CASE WHEN policy_id <> 'counterfactual_branch' THEN d END) AS diff FROM both_rows GROUP BY seed),
a AS (SELECT avg(diff) AS mean_diff, count(diff) AS n_pairs FROM m) SELECT mean_diff, avg(CASE WHEN sign(diff) = sign(mean_diff) THEN 1.0 ELSE 0.0 END) AS direction_consistency, n_pairs FROM m, a WHERE diff IS NOT NULL GROUP BY mean_diff, n_pairs""",
)
def paired_diffs(spark, sf_dir):
    return G.paired_stats(_diffs(spark, sf_dir), "diff", boots=200).select("mean_diff", "direction_consistency", "n_pairs")


def _diffs(spark, sf_dir):
    branch = P.is_counterfactual(F.col("policy_id"), F.col("episode_id"))
    rows = with_branches(transitions(spark, sf_dir))
    return rows.groupBy("seed").agg((F.avg(F.when(branch, F.col("d"))) - F.avg(F.when(~branch, F.col("d")))).alias("diff"))


@query(
    "ag18_bootstrap",
    f"""WITH {CF}, m AS (SELECT seed, avg(CASE WHEN policy_id = 'counterfactual_branch' THEN d END) - avg(CASE WHEN policy_id <> 'counterfactual_branch' THEN d END) AS x FROM both_rows GROUP BY seed),
p AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM m WHERE x IS NOT NULL), k AS (SELECT avg(x) AS mean_diff, count(*) AS n FROM p),
r AS (SELECT id // n AS b, CAST(concat('0x', substr(md5(concat('0|', id)), 1, 15)) AS BIGINT) % n AS i FROM (SELECT n, unnest(range(1000 * n)) AS id FROM k)),
c AS (SELECT quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (SELECT avg(x) AS m FROM r JOIN p USING (i) GROUP BY b))
SELECT mean_diff, ci_low, ci_high, (SELECT avg(CASE WHEN sign(x) = sign(mean_diff) THEN 1.0 ELSE 0.0 END) FROM p) AS direction_consistency, n AS n_pairs,
CASE WHEN ci_low > 0 THEN 'PASS' WHEN ci_high < 0 THEN 'NEGATIVE' WHEN abs(mean_diff) < 0.005 THEN 'NULL' ELSE 'INCONCLUSIVE' END AS verdict FROM k, c""",
)
def bootstrap(spark, sf_dir):
    stats = G.paired_stats(_diffs(spark, sf_dir), "diff", boots=1000)
    return stats.withColumn("verdict", G.verdict(F.col("mean_diff"), F.col("ci_low"), F.col("ci_high"), F.col("n_pairs")))


@query(
    "ag19_seed_diffs",
    f"""WITH {TR}, x AS (SELECT seed % 13 AS data_seed, d / 100.0 - 200 AS diff FROM tr)
SELECT data_seed, count(*) AS n_model_seeds, avg(diff) AS mean, coalesce(stddev_samp(diff), 0.0) AS std, min(diff) AS min, max(diff) AS max FROM x GROUP BY data_seed""",
)
def seed_diffs(spark, sf_dir):
    return G.seed_diffs(transitions(spark, sf_dir).select((F.col("seed") % 13).alias("data_seed"), (F.col("d") / 100.0 - 200).alias("diff")))


@query(
    "ag20_verdict",
    f"""WITH {TR}, s AS (SELECT seed, avg(d) / 100 - 245 AS m, min(d) / 100.0 - 150 AS lo, max(d) / 100.0 - 420 AS hi, count(*) AS n FROM tr GROUP BY seed)
SELECT seed, CASE WHEN n = 0 THEN 'INCONCLUSIVE' WHEN lo > 0 THEN 'PASS' WHEN hi < 0 THEN 'NEGATIVE' WHEN abs(m) < 0.005 THEN 'NULL' ELSE 'INCONCLUSIVE' END AS verdict FROM s""",
)
def verdicts(spark, sf_dir):
    s = transitions(spark, sf_dir).groupBy("seed").agg((F.avg("d") / 100 - 245).alias("m"), (F.min("d") / 100.0 - 150).alias("lo"), (F.max("d") / 100.0 - 420).alias("hi"), F.count("*").alias("n"))
    return s.select("seed", G.verdict(F.col("m"), F.col("lo"), F.col("hi"), F.col("n")).alias("verdict"))


@query(
    "ag26_quantity_identity",
    f"""WITH {TR}, t AS (SELECT count(*) AS produced, count(*) FILTER (action_type NOT IN ('error', 'signup')) AS accepted, count(*) FILTER (action_type = 'error') AS quarantined, count(*) FILTER (action_type = 'signup' AND tick % 2 = 0) AS rejected FROM tr)
SELECT produced, accepted, quarantined, rejected, greatest(0, produced - accepted - quarantined - rejected) AS dropped, produced - accepted - quarantined - rejected >= 0 AS ok FROM t""",
)
def quantity_identity(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    kind = F.col("action_type")
    parts = rows.groupBy("episode_id").agg(F.count("*").alias("produced"), F.count_if(~kind.isin("error", "signup")).alias("accepted"), F.count_if(kind == "error").alias("quarantined"), F.count_if((kind == "signup") & (F.col("tick") % 2 == 0)).alias("rejected"))
    return G.quantity_identity(parts)


@query("ag27_split_counts", f"WITH {EP} SELECT split, count(*) AS episodes, CAST(sum(records) AS BIGINT) AS records FROM ep GROUP BY ROLLUP (split)")
def split_counts(spark, sf_dir):
    rows = episodes(transitions(spark, sf_dir)).withColumn("split", split_of(F.col("seed")))
    return rows.rollup("split").agg(F.count("*").alias("episodes"), F.sum("records").cast("long").alias("records"))


UTILITY = f"""{CF}, u AS (SELECT seed, tick, state_before_hash, episode_id, policy_id, agent_id, d / 100.0 + CASE outcome_code WHEN 'ok' THEN 1.0 ELSE 0.0 END - 5 * CAST(energy_after < 2000 AS INTEGER) - 2 * CAST(outcome_code <> 'ok' AS INTEGER) - (event_id % 3) AS scalar FROM both_rows)"""


def _utility(spark, sf_dir):
    rows = with_branches(transitions(spark, sf_dir))
    ok = F.col("outcome_code") == "ok"
    scalar = G.utility(F.col("d") / 100.0, ok.cast("double"), F.col("energy_after") < 2000, (~ok).cast("double"), (F.col("event_id") % 3).cast("double"))
    return rows.withColumn("scalar", scalar)


@query("ag29_utility", f"WITH {UTILITY} SELECT episode_id, tick, scalar FROM u")
def utility(spark, sf_dir):
    return _utility(spark, sf_dir).select("episode_id", "tick", "scalar")


@query(
    "ag28_best_matched_delta",
    f"""WITH {UTILITY}, m AS (SELECT b.seed, b.tick, c.episode_id, c.scalar - b.scalar AS delta FROM u b JOIN u c ON b.seed = c.seed AND b.tick = c.tick AND b.state_before_hash = c.state_before_hash WHERE b.policy_id <> 'counterfactual_branch' AND c.policy_id = 'counterfactual_branch')
SELECT seed, max(delta) AS best_delta, count(*) AS comparisons FROM m GROUP BY seed""",
)
def best_matched_delta(spark, sf_dir):
    from ..operators.joins import matched_utilities

    rows = _utility(spark, sf_dir)
    base, other = rows.filter("policy_id <> 'counterfactual_branch'"), rows.filter("policy_id = 'counterfactual_branch'")
    return matched_utilities(base, other).filter("matched").groupBy("seed").agg(F.max("delta").alias("best_delta"), F.count("*").alias("comparisons"))


@query("ag30_action_histogram", f"WITH {CF} SELECT seed, tick, action_type, episode_id, count(*) OVER (PARTITION BY seed, tick, state_before_hash, action_type) AS type_count FROM cf")
def action_histogram(spark, sf_dir):
    rows = branches(transitions(spark, sf_dir)).withColumn("branch", F.col("episode_id"))
    rows = rows.withColumn("episode_id", F.col("seed").cast("string")).withColumn("agent_id", F.col("state_before_hash"))
    return P.action_histogram(rows).select("seed", "tick", "action_type", F.col("branch").alias("episode_id"), "type_count")


@query("ag31_held_fixed", f"WITH {CF} SELECT seed, tick, count(*) AS branches, count(*) FILTER (energy_before >= 0) AS same_state, count(DISTINCT state_before_hash) = 1 AS held_fixed FROM both_rows WHERE tick > 0 AND tick % 5 = 0 GROUP BY seed, tick")
def held_fixed(spark, sf_dir):
    from ..operators.counterfactual import held_fixed_counts

    return held_fixed_counts(with_branches(transitions(spark, sf_dir)).filter("tick > 0 and tick % 5 = 0"))


@query(
    "ag33_invariants_and",
    f"""WITH {TR}, c AS (SELECT episode_id, CASE WHEN tick % 4 = 0 THEN NULL ELSE outcome_code IN ('ok', 'illegal_action') END AS passed FROM tr) SELECT episode_id, coalesce(bool_and(passed), false) AS ok, count(passed) AS run FROM c GROUP BY episode_id""",
)
def invariants_and(spark, sf_dir):
    rows = transitions(spark, sf_dir).withColumn("passed", F.when(F.col("tick") % 4 != 0, F.col("outcome_code").isin(*P.OUTCOME_CODES)))
    return rows.groupBy("episode_id").agg(G.overall(F.col("passed")).alias("ok"), F.count("passed").alias("run"))


@query("ag34_vocabulary", f"WITH {TR} SELECT array_to_string(list_sort(list(DISTINCT action_type)), ',') AS actions, array_to_string(list_sort(list(DISTINCT agent_id)), ',') AS agents FROM tr")
def vocabulary(spark, sf_dir):
    rows = transitions(spark, sf_dir)
    return rows.agg(F.array_join(F.array_sort(F.collect_set("action_type")), ",").alias("actions"), F.array_join(F.array_sort(F.collect_set("agent_id")), ",").alias("agents"))


@query("ag36_manifest", f"WITH {TR} SELECT episode_id, count(*) AS record_count, min(tick) AS first_tick, max(tick) AS last_tick, arg_min(state_before_hash, tick) AS first_hash, arg_max(state_after_hash, tick) AS last_hash FROM tr GROUP BY episode_id")
def manifest(spark, sf_dir):
    return G.manifest(transitions(spark, sf_dir))


@query("dp2_episode_split", f"WITH {EP} SELECT split, episode_id FROM ep WHERE records > 1")
def episode_split(spark, sf_dir):
    rows = episodes(transitions(spark, sf_dir))
    seeds = rows.select("seed", split_of(F.col("seed")).alias("split")).distinct()
    return S.grouped_split(rows.filter("records > 1"), seeds).select("split", "episode_id")


@query(
    "dp3_seed_map_split",
    f"""WITH {EP}, m AS (SELECT episode_id, seed, CASE WHEN seed % 3 = 0 THEN split END AS explicit FROM ep), r AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS g FROM (SELECT DISTINCT seed FROM m WHERE explicit IS NULL)),
n AS (SELECT count(*) AS n, greatest(1, CAST(round_even(count(*) * 0.8, 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) AS v FROM r)
SELECT episode_id, coalesce(explicit, CASE WHEN g < t THEN 'train' WHEN g < t + v THEN 'val' ELSE 'test' END) AS split FROM m LEFT JOIN r USING (seed), n""",
)
def seed_map_split(spark, sf_dir):
    rows = episodes(transitions(spark, sf_dir))
    known = rows.filter("seed % 3 = 0").select("seed", split_of(F.col("seed")).alias("split")).distinct()
    return S.seed_map_split(rows, known).select("episode_id", "split")


@query(
    "dp16_treatments",
    f"""WITH {CF}, c AS (SELECT * FROM both_rows WHERE policy_id <> 'counterfactual_branch'), n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY tick) AS i, count(*) OVER (PARTITION BY episode_id) AS n FROM c)
SELECT 'A_small' AS treatment, count(*) AS samples, count(DISTINCT episode_id) AS episodes FROM n WHERE i <= greatest(1, ceil(0.25 * n)) UNION ALL SELECT 'B_random', count(*), count(DISTINCT episode_id) FROM c WHERE policy_id = 'random'
UNION ALL SELECT 'C_transition', count(*), count(DISTINCT episode_id) FROM c UNION ALL SELECT 'D_counterfactual', count(*), count(DISTINCT episode_id) FROM both_rows""",
)
def treatments(spark, sf_dir):
    from ..operators.treatments import build

    rows = with_branches(transitions(spark, sf_dir))
    found = build(rows, rows.filter("policy_id = 'random'"))
    found.pop("D_matched")
    out = None
    for name, df in found.items():
        one = df.agg(F.lit(name).alias("treatment"), F.count("*").alias("samples"), F.count_distinct("episode_id").alias("episodes"))
        out = one if out is None else out.unionByName(one)
    return out


@query("dp17_matched_sample", f"""WITH {CF} SELECT episode_id, tick FROM both_rows ORDER BY sha256(concat('20260729|', episode_id, '|', tick)), episode_id, tick LIMIT 500""")
def matched_sample(spark, sf_dir):
    from ..operators.treatments import downsample

    return downsample(with_branches(transitions(spark, sf_dir)), 500, 20260729).select("episode_id", "tick")


@query("w3_horizon_per_split", f"WITH {TR}, s AS (SELECT *, {SPLIT_SQL} AS split FROM tr) SELECT episode_id, tick, split, CAST(coalesce(sum(d) OVER (PARTITION BY split, episode_id ORDER BY tick ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS BIGINT) AS horizon FROM s WHERE split <> 'train'")
def horizon_per_split(spark, sf_dir):
    rows = transitions(spark, sf_dir).withColumn("split", split_of(F.col("seed"))).filter("split <> 'train'")
    return W.horizon(rows, "d").select("episode_id", "tick", "split", "horizon")
