"""Decision loops, contracts, datasets, materialised rows and the server wrapper."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import dataset as DS
from tracelake.operators import decide as D
from tracelake.operators import materialize as MT
from tracelake.operators import simulate as S
from tracelake.operators import telemetry as M
from tracelake.operators.policies import random_choice
from tracelake.operators.world import World
from tracelake.sources import environments as E
from tracelake.sources import scenarios, sinks, spec


no_wait = lambda seconds: None  # noqa: E731  workers get it by value


def test_attempts_of_one_decision():
    answers = iter(["{", "[1]", '```json\n{"action_type": "b"}\n```'])
    tries = D.one("p" * 40, ["a", "b"], lambda p: next(answers), 2, no_wait)
    assert [t["parse_status"] for t in tries] == ["json_decode_error", "not_dict", "ok"]
    assert [t["disposition"] for t in tries] == ["retry", "retry", "success"] and [t["retry_backoff_ms"] for t in tries] == [0, 500, 1000]
    assert tries[0]["input_tokens"] == 10

    def fails(prompt):
        raise TimeoutError

    tries = D.one("p", ["a"], fails, 1, no_wait)
    assert [(t["error_category"], t["disposition"]) for t in tries] == [("TimeoutError", "retry"), ("TimeoutError", "give_up")]
    assert D.one("p", [], fails, 1, no_wait) == []


def test_decide(spark):
    asked = spark.createDataFrame([("d1", "{}", ["go", "rest"]), ("d2", "{}", ["rest"]), ("d3", "{}", [])], "decision_id string, prompt string, legal array<string>")
    tries = D.decide(asked, D.constant("go"), retries=1, wait=no_wait).cache()
    assert sorted(map(tuple, D.chosen(tries).collect())) == [("d1", "go", "llm"), ("d2", "rest", "fallback")]
    assert {r.decision_id: r.attempt_count for r in M.decisions(tries).collect()} == {"d1": 1, "d2": 2}
    declined = D.decide(asked.filter("decision_id = 'd2'"), D.constant("go"), 0, "decline", wait=no_wait)
    assert [tuple(r) for r in D.chosen(declined).collect()] == [("d2", None, "declined")]


def test_contract():
    world = World(spec.compile_spec(scenarios.RELIEF))
    world.reset(4)
    seen = D.observation(world, "e1")
    assert "energy" in seen["focal_agent"]["own"] and all(set(e["columns"]) <= {"x", "y", "node", "alive"} for e in seen["visible_entities"]) and len(seen["visible_entities"]) == 2
    declared = D.contract(seen)
    assert D.contract_faults(seen, declared) == []
    assert D.contract_faults(seen, declared | {"action_schema": declared["action_schema"][1:] + [{"action_type": "FLY"}], "scenario_id": "other"}) == ["scenario_id", f"missing:{declared['action_schema'][0]['action_type']}", "extra:FLY"]
    assert json.loads(D.message(seen))["scenario_contract"] == declared
    kinds = D.contract(seen | {"legal_actions": [{"action_type": "A", "params": {"b": True, "i": 1, "f": 1.0, "s": "", "n": None, "l": []}}]})["action_schema"][0]["params_schema"]
    assert kinds == {"b": "boolean", "i": "integer", "f": "number", "s": "string", "n": "null", "l": "string"}


def test_dataset(spark, tmp_path):
    found = DS.build(spark, scenarios.RELIEF, spark.range(12).withColumnRenamed("id", "seed"), DS.Config(ticks=11))
    gates = {r.key: (r.status, r.evidence) for r in found.gates.collect()}
    assert sorted(gates) == [f"Q{i}" for i in range(10)]
    assert {k for k, (s, _) in gates.items() if s != "pass"} == set(), gates
    DS.write(found, str(tmp_path / "d"))
    by = {r.split: r.n for r in spark.read.parquet(str(tmp_path / "d/transitions")).groupBy("split").agg(F.count_distinct("episode_id").alias("n")).collect()}
    assert by == {"train": 10, "val": 1, "test": 1}
    assert DS.undeclared_policies(found.steps, spark.createDataFrame([("random",)], "policy_id string")).count() == 3
    assert DS.record_closure(found.steps, found.episodes.limit(2)).count() == 10
    sinks.write_report(found.gates, str(tmp_path / "gates"))
    assert spark.read.json(str(tmp_path / "gates")).count() == 10


def test_joint_branches(spark):
    compiled = spec.compile_spec(scenarios.RELIEF)
    rows = S.joint_rollout(spark, compiled, spark.range(4).withColumnRenamed("id", "seed"), 7, random_choice).cache()
    assert all(r.ok for r in S.replay(rows, compiled).collect())
    states = {(r.seed, r.tick): r.state_before_hash for r in rows.collect()}
    found = S.joint_branch(rows, compiled).collect()
    assert found and all(r.state_before_hash == states[r.seed, r.tick] and r.tick == 5 for r in found)


def test_states_and_training_rows(spark):
    steps = spark.createDataFrame([("e", t) for t in range(4)], "episode_id string, tick long")
    initial = spark.createDataFrame([("e", "a", "1"), ("e", "b", "2")], "episode_id string, key string, value string")
    changes = spark.createDataFrame([("e", 0, "a", "5"), ("e", 2, "b", None), ("e", 2, "c", "x")], "episode_id string, tick long, key string, value string")
    found = {r.tick: (r.before, r.after) for r in MT.states(steps, initial, changes).collect()}
    assert found == {0: ({"a": "1", "b": "2"}, {"a": "5", "b": "2"}), 1: ({"a": "5", "b": "2"},) * 2, 2: ({"a": "5", "b": "2"}, {"a": "5", "c": "x"}), 3: ({"a": "5", "c": "x"},) * 2}
    with pytest.raises(Exception, match="no initial state"):
        MT.states(steps, initial.limit(0), changes).collect()
    full = steps.withColumn("executed", F.create_map(F.lit("e0"), F.struct(F.lit("go").alias("action_type"), F.create_map(F.lit("target_agent"), F.lit("e1")).alias("params")))).withColumn("exogenous", F.create_map(F.lit("rain"), F.lit("2")))
    rows = MT.training_rows(full, initial, changes, ("e0", "e1"), ("go", "rest"), 16, 8).orderBy("tick").collect()
    assert len(rows) == 4 and rows[1].state_before == rows[1].state_after != rows[0].state_before
    assert rows[0].joint_action == [1.0, 0.0, 0.0, 1.0, 1.0] + [0.0] * 5 and rows[0].exogenous == [2.0]


def test_server():
    server = E.Server(World(spec.compile_spec(scenarios.RELIEF)), "e0")
    with pytest.raises(RuntimeError):
        server.step(0)
    first = server.reset(3)
    state, reward, ended, truncated, info = server.step(99)
    assert info == {"rejected": True} and state == first and not ended and not truncated
    state, reward, *_, info = server.step(0)
    assert state["tick"] == 1 and info["outcome_code"] == "ok" and reward <= 0
    assert E.external_params_hash({"a": 1, "b": 2}) == E.external_params_hash({"b": 2, "a": 1})
