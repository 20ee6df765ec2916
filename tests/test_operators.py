"""Operators on hand-made rows, each with a case that it must reject."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from tracelake.operators import baselines as B
from tracelake.operators import features as X
from tracelake.operators import grouping as G
from tracelake.operators import joint as JT
from tracelake.operators import policies as PO
from tracelake.operators import predicates as P
from tracelake.operators import prompts as R
from tracelake.operators import quality as Q
from tracelake.operators import ranking as K
from tracelake.operators import records as REC
from tracelake.operators import splits as S
from tracelake.operators import telemetry as M
from tracelake.operators import treatments as TR
from tracelake.operators import windows as W
from tracelake.trajectory import transitions


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


FORKS = [("seed44_run2", 44, 2, "hA"), ("seed44_run2_cf_t2_b0", 44, 2, "hA"), ("seed44_run2_cf_t2_b1", 44, 2, "hA"), ("seed44_run2", 44, 3, "hB")]


@pytest.fixture()
def forks(spark):
    return spark.createDataFrame(FORKS, "episode_id string, seed long, tick long, state_before_hash string")


def test_groups(forks):
    found = K.groups(forks).collect()
    assert len(found) == 1 and len(found[0].members) == 3


def test_perfect_predictions(forks):
    rows = forks.withColumn("t", F.length("episode_id").cast("double") + F.col("tick"))
    r = K.evaluate(rows, "t", "t").first()
    assert (r.ranking_accuracy, r.energy_mae, r.top1_regret, r.n_groups, r.n_candidates) == (1.0, 0.0, 0.0, 1, 3)
    worst = K.evaluate(rows.withColumn("p", -F.col("t")), "t", "p").first()
    assert worst.ranking_accuracy == 0 and worst.direction_consistency == 0


def test_ranking_of_nothing(forks):
    r = K.evaluate(forks.withColumn("t", F.lit(1.0)).limit(0), "t", "t").first()
    assert math.isnan(r.ranking_accuracy) and math.isnan(r.energy_mae) and r.n_groups == 0


def test_family_and_split(spark, forks):
    seeds = spark.createDataFrame([(44, "train")], "seed long, split string")
    assert S.grouped_split(forks, seeds).count() == 4
    with pytest.raises(ValueError):
        S.grouped_split(forks, seeds, "row")
    with pytest.raises(Exception, match="no split for seed"):
        S.grouped_split(forks, seeds.limit(0)).collect()


def test_a_row_split_leaks(forks):
    clean = forks.withColumn("split", F.lit("train"))
    assert S.group_leakage(clean).count() == 0
    bad = forks.withColumn("split", F.when(F.col("episode_id").contains("_b1"), "test").otherwise("train"))
    assert {r.kind for r in S.group_leakage(bad).collect()} == {"seed", "family", "fork"}
    assert S.sibling_leakage(bad).count() == 1


@pytest.mark.parametrize("share, kept", [(0.25, 1), (0.5, 2), (1.0, 4)])
def test_first_share(spark, share, kept):
    rows = spark.createDataFrame([("e", t) for t in range(4)], "episode_id string, tick long")
    assert W.first_share(rows, share).count() == kept
    with pytest.raises(ValueError):
        W.first_share(rows, 0)


def test_treatments(spark):
    rows = spark.createDataFrame([("e1", t, "random") for t in range(8)] + [("e1_cf_t2_b0", 2, "counterfactual_branch")], "episode_id string, tick long, policy_id string")
    found = {k: v.count() for k, v in TR.build(rows, rows.filter("policy_id = 'random'")).items()}
    assert found == {"A_small": 2, "B_random": 8, "C_transition": 8, "D_counterfactual": 9, "D_matched": 8}
    with pytest.raises(Exception, match="branch in the random set"):
        TR.build(rows, rows)["B_random"].collect()


def test_floored_energy_is_the_fold(spark, sf_dir):
    rows = transitions(spark, sf_dir).withColumn("delta", F.col("d") % 1000 - 600)
    found = W.floored_energy(rows, "delta", 700).select("episode_id", "tick", "delta", "energy").orderBy("episode_id", "tick").collect()
    energy, episode, floored = 0, None, 0
    for r in found:
        energy = 700 if r.episode_id != episode else energy
        episode = r.episode_id
        floored += energy + r.delta < 0
        energy = max(0, energy + r.delta)
        assert r.energy == energy
    assert floored


def test_paired_stats(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "x double")
    r = G.paired_stats(rows, "x", boots=300).first()
    assert (r.mean_diff, r.direction_consistency, r.n_pairs) == (2.0, 1.0, 3) and 1 <= r.ci_low <= 2 <= r.ci_high <= 3
    one_row = G.paired_stats(rows.limit(1), "x").first()
    assert one_row.ci_low == one_row.ci_high == 1.0
    none = G.paired_stats(rows.limit(0), "x").first()
    assert math.isnan(none.mean_diff) and none.n_pairs == 0


@pytest.mark.parametrize("mean, low, high, n, higher, expected", [(1.0, 0.5, 2.0, 5, True, "PASS"), (1.0, 0.5, 2.0, 5, False, "NEGATIVE"), (-1.0, -2.0, -0.5, 5, True, "NEGATIVE"), (0.001, -1.0, 1.0, 5, True, "NULL"), (0.5, -1.0, 1.0, 5, True, "INCONCLUSIVE"), (0.0, 0.0, 0.0, 0, True, "INCONCLUSIVE")])
def test_verdicts(spark, mean, low, high, n, higher, expected):
    assert one(spark, v=G.verdict(F.lit(mean), F.lit(low), F.lit(high), F.lit(n), higher)).v == expected


def test_mode_takes_the_smallest(spark):
    assert G.mode_of(spark.createDataFrame([(3,), (1,), (3,), (1,), (2,)], "v int"), "v").first().v == 1


def test_rounding_is_half_even(spark):
    r = spark.createDataFrame([(0.5, 0.0), (1.5, 2.0), (2.5, 2.0)], "a double, b double").agg(G.accuracy(F.col("a"), F.col("b")).alias("x")).first()
    assert r.x == 1.0


def test_ridge_penalises_the_bias(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    full = np.hstack([x, np.ones((200, 1))])
    expected = np.linalg.solve(full.T @ full + 5 * np.eye(4), full.T @ y)
    assert G.ridge(rows, [F.col(c) for c in "abc"], F.col("y"), 5.0) == pytest.approx(expected)
    model = B.Ridge([F.col(c) for c in "abc"], "y", 1e-9).fit(rows)
    assert B.errors(model.predict(rows), "y")[0] < 1e-6
    clipped = B.Ridge([F.col(c) for c in "abc"], "y", clip=(0, 5)).fit(rows).predict(rows)
    assert {r.pred_y for r in clipped.collect()} <= set(map(float, range(6)))


def test_baselines(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], "h" + str(i % 3), float(i)) for i in range(12)], "i int, k string, h string, y double")
    assert {r.pred_y for r in B.Persistence(["y"]).fit(rows).predict(rows).collect()} == {0.0}
    mean = B.MeanDelta(["k"], ["y"]).fit(rows.filter("k = 'a'"))
    assert {(r.k, r.pred_y) for r in mean.predict(rows).collect()} == {("a", 5.0), ("b", 5.0)}
    oracle = B.Oracle(B.MeanDelta(["k"], ["y"]), ["h", "k"], ["y"], "i").fit(rows)
    assert {(r.h, r.k, r.pred_y) for r in oracle.predict(rows).collect()} == {(f"h{i % 3}", "ab"[i % 2], float(i)) for i in range(6, 12)}
    blind = B.WithoutAction(B.MeanDelta(["k"], ["y"]), "k", "none").fit(rows).predict(rows)
    assert {r.pred_y for r in blind.collect()} == {5.5} and {r.k for r in blind.collect()} == {"a", "b"}
    shuffled = B.permuted(rows, "k", ["i"], 1)
    assert sorted(r.k for r in shuffled.collect()) == ["a"] * 6 + ["b"] * 6 and sorted(r.i for r in shuffled.collect()) == list(range(12))


def test_boosted_trees(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i % 7), float((i % 10) * 2)) for i in range(200)], "a double, b double, y double")
    model = B.Boosted(["a", "b"], "y", trees=5).fit(rows)
    assert B.errors(model.predict(rows), "y")[0] < 1.0


ATTEMPT = "decision_id string, attempt_index int, started_at double, finished_at double, latency_ms double, retry_backoff_ms double, input_tokens int, output_tokens int, cached_tokens int, effective_backend string, mock_call boolean, requested_backend string, error_category string, final_origin string"


def attempts(spark, *rows):
    return spark.createDataFrame(rows, ATTEMPT)


def test_decisions(spark):
    a = attempts(
        spark,
        ("d", 0, 10.0, 11.0, 1000.0, 0.0, 5, 1, 0, "real", False, "real", None, "llm"),
        ("d", 1, 12.0, 15.0, 3000.0, 500.0, 7, 2, 1, "mock", True, "real", None, "llm"),
        ("c", 0, 5.0, 4.0, 0.0, 0.0, 1, 1, 1, "real", False, "real", None, "llm"),
    )
    found = {r.decision_id: r for r in M.decisions(a).collect()}
    d = found["d"]
    assert (d.total_input_tokens, d.total_output_tokens, d.total_cached_tokens, d.total_latency_ms, d.effective_backend, d.mock_calls) == (12, 3, 1, 5000.0, "mock", 1)
    assert found["c"].total_latency_ms == 0
    every = spark.createDataFrame([("d", "real", "llm"), ("none", "fake", "declined")], "decision_id string, requested_backend string, final_origin string")
    empty = {r.decision_id: r for r in M.with_decisions(every, a).collect()}["none"]
    assert (empty.attempt_count, empty.effective_backend, empty.total_latency_ms) == (0, "fake", 0.0)


@pytest.mark.parametrize("row, reason", [
    (("real", 0, False, "llm"), None), (("fake", 0, False, "llm"), "backend_not_real"), (("real", 1, False, "llm"), "mock_calls"),
    (("real", 0, True, "llm"), "auth_error"), (("real", 0, False, "fallback"), "fallback"),
])
def test_evidence(spark, row, reason):
    df = spark.createDataFrame([("d", "real", *row)], "decision_id string, requested_backend string, effective_backend string, mock_calls int, auth_error boolean, final_origin string")
    assert df.select(M.evidence_violation("evidence").alias("r")).first().r == reason
    assert df.select(M.evidence_violation("smoke").alias("r")).first().r is None
    if reason:
        with pytest.raises(M.EvidenceError):
            M.require_evidence(df, "evidence")
    else:
        M.require_evidence(df, "evidence")


def test_fallback_rate(spark):
    df = spark.createDataFrame([("fallback",), ("llm",), ("fallback",)], "final_origin string")
    assert not M.fallback_gate(df, "smoke").first().ok and M.fallback_gate(df, "dev").first().ok and M.fallback_gate(df.limit(0), "evidence").first().ok


@pytest.mark.parametrize("text, status", [('{"a": 1}', "ok"), ('```json\n{"a": 1}\n```', "ok"), ("```\n{}\n```  ", "ok"), ("[1]", "not_dict"), ("3", "not_dict"), ("{a", "json_decode_error"), ("rest", "json_decode_error"), ("", "no_content"), (None, "no_content")])
def test_parse_status(spark, text, status):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(R.parse_status(F.col("t")).alias("s")).first().s == status


def test_forbidden(spark):
    df = spark.createDataFrame([('{"token": 1, "x": "checkpoint"}',), ("fine",), (None,)], "t string")
    assert [r.h for r in df.select(R.forbidden_hits(F.col("t")).alias("h")).collect()] == [["checkpoint", "token"], [], []]
    assert [r.h for r in df.select(R.forbidden_keys(F.col("t")).alias("h")).collect()] == [["token"], [], []]


def test_config_hash(spark):
    import hashlib

    text = json.dumps({"model": "m", "temperature": 0.5, "max_tokens": 3, "max_retries": 1, "fallback_mode": "noop"}, sort_keys=True)
    found = one(spark, h=M.inference_config_hash(F.lit("m"), F.lit("0.5"), F.lit(3), F.lit(1), F.lit("noop"))).h
    assert found == "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_receipts(spark):
    rows = spark.createDataFrame([("go", True), ("go", False), ("fly", True)], "action_type string, legal boolean")
    actions = spark.createDataFrame([("go", 0.5)], "action_type string, cost double")
    assert sorted((r.action_type, r.outcome_code, r.energy_delta) for r in P.receipts_for(rows, actions).collect()) == [("fly", "unrecognized_intent", 0.0), ("go", "illegal_action", 0.0), ("go", "ok", -0.5)]
    assert {r.outcome_code for r in P.receipts_for(rows, actions, closed=False).filter("action_type = 'fly'").collect()} == {"ok"}


def test_policies(spark):
    legal = [("a", {}), ("a", {"n": 3}), ("b", {})]
    assert PO.adversarial(None, "e", legal, None, 0) == ("b", {})
    assert PO.adversarial(None, "e", legal[1:], None, 0) == ("b", {})
    assert PO.planner()(None, "e", legal, None, 0) == ("a", {"n": 3})
    assert PO.scripted("b")(None, "e", legal, None, 0) == ("b", {}) and PO.scripted("x")(None, "e", legal, None, 0) == ("a", {})
    assert PO.frozen_replay({(2, "e"): ("z", {})})(None, "e", legal, None, 2) == ("z", {}) and PO.random_choice(None, "e", [], None, 0) is None
    answers = iter(["no json", '{"action_type": "b"}'])
    assert PO.from_model(lambda prompt: next(answers))(None, "e", legal, None, 0) == ("b", {})
    assert PO.from_model(lambda prompt: "[]")(None, "e", legal, None, 0) == ("a", {})


def test_joint(spark):
    df = spark.createDataFrame([({"e0": "go"}, ["e0", "e1"])], "p map<string,string>, active array<string>")
    assert df.select(JT.filled(F.col("p"), F.col("active"), "stay").alias("f")).first().f == {"e0": "go", "e1": "stay"}
    with pytest.raises(Exception, match="no proposal"):
        df.select(JT.filled(F.col("p"), F.col("active"), "error").alias("f")).collect()
    legal = F.create_map(F.lit("e0"), F.array(F.lit("rest")))
    assert df.select(JT.legal_or(F.col("p"), legal).alias("f")).first().f == {"e0": "noop"}


def test_features(spark):
    r = one(
        spark, hot=X.one_hot(F.lit(1), 3), none=X.one_hot(F.lit(7), 3), v=X.vector(F.array(F.lit(1.0)), F.lit(None).cast("array<double>"), F.array(F.lit(2.0))), am=X.arg_max(F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0))),
        pop=X.population_block(F.array(F.lit("a"), F.lit("b")), 3), nums=X.numeric_fields(F.create_map(F.lit("a"), F.lit("1.5"), F.lit("b"), F.lit("x"))),
        ent=X.entity_block(F.array(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3"))), 4, 8), exo=X.exogenous_block(F.create_map(F.lit("z"), F.lit("2"), F.lit("a"), F.lit("1")), 8),
    )
    assert (r.hot, r.none, r.v, r.am, r.pop, r.nums, r.ent, r.exo) == ([0, 1, 0], [0, 0, 0], [1, 2], 1, [2, 0, 0], {"a": 1.5}, [1, 2, 3, 0], [1, 2])
    layout = X.legacy_layout(4, 2)
    assert layout.width == 10 and layout.range("agent") == (5, 7)
    with pytest.raises(KeyError):
        layout.range("nothing")


@pytest.fixture()
def recs(spark, sf_dir):
    return REC.records(transitions(spark, sf_dir)).cache()


def status(df):
    return df.first().status


def test_gates_pass_on_clean_records(spark, recs):
    assert status(Q.q0_schema(recs)) == status(Q.q1_traceability(recs)) == status(Q.q2_structure(recs)) == status(Q.q4_provenance(recs)) == "pass"
    assert status(Q.q0_schema(recs.limit(0))) == status(Q.q1_traceability(recs.limit(0))) == "fail"


@pytest.mark.parametrize("column, value, gate", [
    ("schema_version", "9", Q.q0_schema), ("producer_id", "", Q.q0_schema), ("tick", -1, Q.q0_schema), ("state_after_hash", "sha256:x", Q.q1_traceability), ("state_before_hash", None, Q.q0_schema),
])
def test_gates_fail_on_one_flaw(recs, column, value, gate):
    bad = recs.withColumn(column, F.when(F.col("tick") == 3, F.lit(value)).otherwise(F.col(column)).cast(recs.schema[column].dataType))
    assert status(gate(bad)) == "fail"


def test_orphans_and_wrong_hashes(recs):
    without = recs.withColumn("candidate_actions", F.map_filter("candidate_actions", lambda k, v: F.col("tick") != 2))
    r = Q.traceability(without).first()
    assert r.orphans > 0 and status(Q.q1_traceability(without)) == "fail"
    other = recs.withColumn("candidate_actions", F.transform_values("candidate_actions", lambda k, v: v.withField("proposer", F.when(F.col("tick") == 2, "someone").otherwise(v["proposer"]))))
    assert Q.traceability(other).first().mismatches > 0
    assert Q.traceability(recs.union(recs.filter("tick = 2"))).first().repeated_ticks > 0


def test_delta_must_fit_capabilities(recs):
    bad = recs.withColumn("state_delta", F.col("state_delta").withField("event_log", F.array().cast("array<struct<kind:string,tick:bigint>>")))
    assert status(Q.q2_structure(bad)) == "fail"
    late = recs.withColumn("state_delta", F.col("state_delta").withField("meta_after", F.struct(F.lit(0).cast("long").alias("tick"))))
    assert status(Q.q2_structure(late)) == "fail"


def test_provenance(spark, recs):
    bad = recs.withColumn("provenance", F.col("provenance").withField("seed", F.when(F.col("tick") == 1, F.lit("other")).otherwise(F.col("provenance.seed"))))
    assert status(Q.q4_provenance(bad)) == "fail"
    declared = recs.groupBy(F.col("provenance.episode_id").alias("episode_id")).agg(F.count("*").alias("record_count"))
    assert status(Q.q4_provenance(recs, declared)) == "pass" and status(Q.q4_provenance(recs, declared.limit(1))) == "fail"


def test_vacuous_and_inconsistent_leakage(spark):
    rows = spark.createDataFrame([("train", "e1", 1), ("test", "e2", 2)], "split string, episode_id string, seed long")
    report = lambda ok, n, kinds, by: spark.createDataFrame([(ok, n, by, kinds)], "ok boolean, violation_count long, by_kind map<string,long>, checked_kinds array<string>")
    assert status(Q.q5_leakage(report(True, 0, ["seed"], {}), rows)) == "pass"
    assert status(Q.q5_leakage(report(True, 0, [], {}), rows)) == "fail"
    assert status(Q.q5_leakage(report(True, 0, ["seed"], {"seed": 1}), rows)) == "fail"
    assert status(Q.q5_leakage(report(True, 0, ["seed"], {}), rows.withColumn("seed", F.lit(1)))) == "fail"


def test_quantity_and_summary(spark):
    rows = spark.createDataFrame([(5, 3, 1, 1), (4, 4, 0, 0)], "produced long, accepted long, quarantined long, rejected long")
    assert status(Q.q8_quantity(G.quantity_identity(rows))) == "pass"
    assert status(Q.q8_quantity(G.quantity_identity(rows.withColumn("produced", F.lit(9).cast("long"))))) == "fail"
    gates = Q.report(Q.q8_quantity(G.quantity_identity(rows)), Q.skipped(spark, "Q9", "off"))
    assert Q.summary(gates).first().ok


def test_slots(spark):
    r = one(spark, a=REC.slot_triple(F.lit(False), F.lit(None), F.lit(None)), b=REC.slot_triple(F.lit(True), F.lit(True), F.lit(3)), c=REC.slot_triple(F.lit(True), F.lit(False), F.lit(3)), d=REC.slot_triple(F.lit(True), F.lit(None), F.lit(None)))
    assert (r.a, r.b, r.c, r.d) == (True, False, True, False)
