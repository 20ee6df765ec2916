"""Specifications, worlds, rollouts, replay and branches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import policies as PO
from tracelake.operators import simulate as S
from tracelake.operators.world import World
from tracelake.sources import environments as E
from tracelake.sources import scenarios, spec


@pytest.fixture(scope="module")
def relief():
    return spec.compile_spec(scenarios.RELIEF)


def test_specs_compile(tmp_path, relief):
    assert spec.compile_spec(scenarios.RING)["time"]["deterministic"] is True
    (tmp_path / "a.json").write_text(json.dumps(scenarios.RING))
    assert spec.load(tmp_path / "a.json") == json.loads(json.dumps(scenarios.RING))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(json.loads(json.dumps(scenarios.RING))))
    assert spec.load(tmp_path / "a.yaml") == json.loads(json.dumps(scenarios.RING))
    (tmp_path / "a.txt").write_text("")
    with pytest.raises(spec.SpecError):
        spec.load(tmp_path / "a.txt")
    assert spec.params_hash(relief) == spec.params_hash(spec.compile_spec(scenarios.RELIEF)) != spec.params_hash(spec.compile_spec(scenarios.RING))


@pytest.mark.parametrize("number", sorted(scenarios.FAULTY))
def test_each_check_speaks_and_is_silent(number, relief):
    found = spec.semantic_issues(scenarios.FAULTY[number])
    assert number in {i.check_id for i in found}
    assert not [i for i in spec.semantic_issues(scenarios.RELIEF) if i.severity == "error"]
    errors = [i for i in found if i.severity == "error"]
    if errors:
        with pytest.raises(spec.SpecError):
            spec.compile_spec(scenarios.FAULTY[number])


def test_all_specs_at_once(spark):
    """Spark and one specification alone give the same issues; shape errors keep the meaning checks off."""
    specs = scenarios.FAULTY | {"ring": scenarios.RING, "relief": scenarios.RELIEF, "shapeless": {k: v for k, v in scenarios.RING.items() if k != "space"}}
    found = sorted((r.spec, r.check_id, r.severity, r.message, r.location) for r in spec.issues_frame(spark, specs).collect())
    expected = sorted((name, i.check_id, i.severity, i.message, i.location) for name, data in specs.items() for i in spec.schema_issues(data) or spec.semantic_issues(data))
    assert found == expected
    assert [i.location for i in spec.semantic_issues(scenarios.FAULTY["5"]) if i.check_id == "5"] == ["termination.stop_conditions[0]"] * 2


def test_rules_in_detail():
    """What each rule leaves alone."""
    def ring(*effects, **more):
        return scenarios.RING | {"actions": {"actions": [{"action_type": "A", "effects": list(effects)}]}} | more

    ids = lambda data: [i.check_id for i in spec.semantic_issues(data)]
    energy = {"target": "entity", "field": "energy", "value": 1}
    assert ids(ring(energy | {"op": "sub"}, energy | {"op": "add"})) == []
    assert ids(ring({"target": "field", "field": "reward", "op": "set", "value": "$NEXT.energy"})) == []
    assert ids(ring({"op": "add"})) == ["2"] and ids(ring({"target": "entity"})) == ["2"] and ids(ring({"target": "meta", "op": "add"})) == ["2", "8"]
    assert ids(ring(energy | {"op": "add"}, time={"max_ticks": 20_000}, termination={"stop_conditions": []})) == ["4"]
    assert ids(ring(energy | {"op": "add"}, termination={"stop_conditions": [{"kind": "custom"}, {"kind": "threshold", "field": "x", "op": ">", "value": 0}]})) == ["5"]
    need = {"kind": "registry_unowned", "registry_type": "$kind"}
    owned = {"actions": {"actions": [{"action_type": "A", "effects": [], "preconditions": [need]}]}}
    assert ids(scenarios.RELIEF | owned) == []
    assert ids(scenarios.RELIEF | {"actions": {"actions": [{"action_type": "A", "effects": [{"target": "entity", "op": "remove"}, {"target": "relation", "op": "remove"}]}]}}) == []


def test_default_parameters(relief):
    from tracelake.operators import effects

    world = World(relief)
    world.reset(1)
    s = world.state
    s["entities"]["e0"]["node"] = "south"
    moment = effects.Moment(s, relief, "e0", {}, world.actions["PUMP"])
    assert effects.default(moment, "entry_id", None) == "pump1" and effects.default(moment, "target_node", None) == "bridge"
    s["registries"][0]["state"] = "destroyed"
    s["entities"]["e1"]["alive"] = False
    assert effects.default(moment, "entry_id", None) == "pump2" and effects.default(moment, "target_agent", None) == "e2"
    s["registries"][1]["state"] = "destroyed"
    assert effects.default(moment, "entry_id", None) == "pump1"
    assert [effects.default(moment, n, k) for n, k in (("amount", None), ("a", {"dtype": "int"}), ("b", {"dtype": "float"}), ("c", {}))] == [1.0, 1, 1.0, ""]
    assert effects.Moment(s, relief, "e0", {"a": 3}).read("$param.a") == effects.Moment(s, relief, "e0", {"a": 3}).read("$a") == 3
    assert moment.read("$entity.id") == "e0" and moment.read("$entity.node") == "south" and moment.read(5) == 5
    world.step([("e0", "CALL", {"dst": "e1", "src": "e2"}), ("nobody", "REST", {})])
    assert ["e2", "e1", "radio", 1.0] in world.state["edges"]


@pytest.mark.parametrize("change", [{"termination": {"stop_conditions": []}}, {"space": {"type": "discrete"}}, {"time": {"max_ticks": "many"}}, {"extra": {}}, {"entities": {"columns": [{"name": "x"}], "initial_count": 1}}])
def test_shape_errors(change):
    assert spec.schema_issues(scenarios.RING | change)


def test_missing_section():
    assert spec.schema_issues({k: v for k, v in scenarios.RING.items() if k != "space"})


def test_capabilities(relief):
    caps = spec.capabilities(relief)
    assert caps["population"] and caps["events"] and caps["transition_mode"] == "stochastic"
    assert not spec.capabilities(spec.compile_spec(scenarios.RING))["fields"]


def test_floor_deaths_and_strictness(relief):
    world = World(relief)
    world.reset(1)
    world.state["entities"]["e0"]["energy"] = 0.2
    world.step([("e0", "PUMP", {"entry_id": "pump1"})])
    assert world.state["entities"]["e0"]["energy"] == 0.0 and world.state["died"] == ["e0"] and world.state["deaths"] == 1
    assert "e0" not in world.state["alive"]
    strict = World(relief, strict=True)
    strict.reset(1)
    strict.state["entities"]["e0"]["energy"] = 0.2
    strict.step([("e0", "PUMP", {"entry_id": "pump1"})])
    assert strict.state["entities"]["e0"]["energy"] == 0.2
    assert strict.receipt("e0", "PUMP", {"entry_id": "pump1"})[0] == "illegal_action" and strict.receipt("e0", "FLY", {})[0] == "unrecognized_intent"


def test_effects(relief):
    world = World(relief)
    world.reset(3)
    world.step([("e0", "PUMP", {"entry_id": "pump1"}), ("e1", "CALL", {"target_agent": "e2"})])
    assert world.state["registries"][0]["owner_id"] == "e0" and ["e1", "e2", "radio", 1.0] in world.state["edges"]
    assert not world.allowed(world.actions["PUMP"], "e1", {"entry_id": "pump1"})
    world.step([], {"kind": "resource_spawn", "payload": {"rate": 2.0}})
    assert world.state["fields"]["supplies"] == [[2.0, 2.0], [2.0, 2.0]] and world.state["fields"]["water_level"] == 1.5


@pytest.mark.parametrize("twister", [False, True])
def test_snapshots_restore_exactly(relief, twister):
    world = World(relief, twister=twister)
    world.reset(9)
    for _ in range(3):
        world.step([("e0", "REST", {})], world.exogenous())
    saved, before = world.snapshot(), world.hash()
    ahead = []
    for _ in range(4):
        world.step([("e1", "WALK", {"target_node": "north"})], world.exogenous())
        ahead.append(world.hash())
    world.restore(saved)
    assert world.hash() == before
    again = []
    for _ in range(4):
        world.step([("e1", "WALK", {"target_node": "north"})], world.exogenous())
        again.append(world.hash())
    assert ahead == again


def test_rollout_is_a_chain_and_replays(spark, relief):
    seeds = spark.range(6).withColumnRenamed("id", "seed")
    rows = S.rollout(spark, relief, seeds, 10).cache()
    by = {}
    for r in rows.collect():
        by.setdefault(r.episode_id, []).append(r)
    for steps in by.values():
        steps.sort(key=lambda r: r.tick)
        assert all(a.state_after_hash == b.state_before_hash for a, b in zip(steps, steps[1:], strict=False))
    again = S.rollout(spark, relief, seeds.repartition(5), 10)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, again.collect()))
    replayed = S.replay(rows, relief).collect()
    assert len(replayed) == 30 and all(r.ok for r in replayed)
    forged = rows.withColumn("action_type", F.when(F.col("tick") == 1, "REST").otherwise(F.col("action_type"))).withColumn("state_after_hash", F.when(F.col("tick") == 3, "x").otherwise(F.col("state_after_hash")))
    assert not all(r.ok for r in S.replay(forged, relief).collect())
    moved = rows.withColumn("seed", F.col("seed") + 100)
    assert {(r.anchored, r.ok) for r in S.replay(moved, relief).collect()} == {(False, False)}


def test_branches_start_where_the_parent_was(spark, relief):
    rows = S.rollout(spark, relief, spark.range(5).withColumnRenamed("id", "seed"), 12).cache()
    found = S.branch(rows, relief).collect()
    parent = {(r.seed, r.tick): r for r in rows.collect()}
    assert found
    for r in found:
        p = parent[r.seed, r.tick]
        assert r.error is None and r.state_before_hash == p.state_before_hash and r.exogenous == p.exogenous and r.action_type != p.action_type and r.tick % 5 == 0 and r.tick > 0


def test_matched_policies(spark, relief):
    policies = {k: PO.BUILT_IN[k] for k in ("scripted", "random")}
    found = S.matched_utilities(spark, relief, spark.range(3).withColumnRenamed("id", "seed"), policies, "scripted", 4)
    pairs = S.compare_policies(found, "scripted").collect()
    assert len(pairs) == 12 and all(r.matched for r in pairs)
    with pytest.raises(ValueError):
        S.matched_utilities(spark, relief, spark.range(1).withColumnRenamed("id", "seed"), {"scripted": PO.scripted()}, "scripted")


def test_additive_fields_need_no_fold(spark, relief):
    rows = S.rollout(spark, relief, spark.range(4).withColumnRenamed("id", "seed"), 10).cache()
    found = {(r.episode_id, r.tick): r.water_level for r in S.field_by_prefix(rows, relief, "water_level").collect()}
    for episode in {k[0] for k in found}:
        world = World(relief)
        steps = sorted((r for r in rows.collect() if r.episode_id == episode), key=lambda r: r.tick)
        world.reset(steps[0].seed)
        for r in steps:
            world.step([(r.agent_id, r.action_type, json.loads(r.params))], json.loads(r.exogenous) if r.exogenous else None)
            assert found[episode, r.tick] == pytest.approx(world.state["fields"]["water_level"])


def test_environments(spark):
    seeds = spark.createDataFrame([(1,), (2,)], "seed long")
    found = E.run_single(seeds, E.Counter, lambda seed, tick, observation, n: (seed + tick) % 3)
    rows = sorted(map(tuple, found.select("seed", "tick", "action", "reward", "terminated").collect()))
    assert any(r[2] == 2 and r[3] == 0.0 for r in rows) and sum(r[4] for r in rows) == 2
    legal = found.filter("action < 2")
    closed = E.counter_closed_form(legal.select("seed", "tick", "action"))
    assert sorted((r.seed, r.tick, float(r.value), r.terminated) for r in closed.collect()) == [(r[0], r[1], r[3], r[4]) for r in rows if r[2] < 2]
    assert E.restores_exactly(E.Counter, [0, 1, 1, 0])

    class Forgetful(E.Counter):
        def load(self, saved):
            pass

    assert not E.restores_exactly(Forgetful, [0, 1])
    with pytest.raises(TypeError):
        E.discrete_actions(object())


def test_parallel_environment(spark):
    class Pair:
        def reset(self, seed=0):
            self.t = 0
            return {"b": [0.0], "a": [0.0]}

        def step(self, actions):
            self.t += 1
            ended = {"a": self.t >= 2, "b": self.t >= 3}
            return {a: [float(self.t)] for a in actions}, {a: float(v) for a, v in actions.items()}, {a: ended[a] for a in actions}, {}, {}

    found = E.run_parallel(spark.createDataFrame([(5,)], "seed long"), Pair, lambda seed, tick, agent, observation: tick).collect()
    assert sorted((r.tick, r.agent_id, r.terminated) for r in found) == [(0, "a", False), (0, "b", False), (1, "a", True), (1, "b", False), (2, "b", True)]
