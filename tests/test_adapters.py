"""External environments, transports and checkpoints."""

from __future__ import annotations

import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from tracelake.operators import checkpoints as CP
from tracelake.operators import counterfactual as CFO
from tracelake.operators import decide as DE
from tracelake.operators import simulate as S
from tracelake.operators import transport as TP
from tracelake.operators.world import World
from tracelake.sources import adapters as A
from tracelake.sources import environments as E
from tracelake.sources import scenarios, spec


class Space:
    def __init__(self, n):
        self.n = n


class Gym:
    """A single-agent environment with the newer reset."""

    action_space = Space(3)

    def reset(self, seed=None):
        self.x, self.steps = float(seed), 0
        return [self.x, 1.0, 2.0], {"seed": seed}

    def step(self, action):
        self.x += action
        self.steps += 1
        return [self.x, 1.0, 2.0], float(action), self.x >= 10, self.steps >= 6, {"x": self.x}

    def save(self):
        return {"x": self.x, "steps": self.steps}

    def load(self, saved):
        self.__dict__.update(saved)


class Pair:
    """A parallel environment: a ends after two steps, b after three; action 2 breaks it."""

    def action_space(self, agent):
        return Space(3)

    def reset(self, seed=None):
        self.t, self.agents = 0, ["a", "b"]
        return {"a": [0.0], "b": [1.0, 2.0, 3.0, 4.0, 5.0]}, {}

    def step(self, actions):
        if 2 in actions.values():
            raise RuntimeError("broken")
        self.t += 1
        ended = {"a": self.t >= 2, "b": False}
        cut = {"a": False, "b": self.t >= 3}
        now, self.agents = self.agents, [a for a in self.agents if not ended[a] and not cut[a]]
        return {a: [float(self.t)] for a in now}, {a: float(actions[a]) for a in now}, ended, cut, {a: {"t": self.t, "odd": {1}} for a in now}


def test_single():
    world = A.Single(Gym())
    with pytest.raises(RuntimeError):
        world.view()
    first = world.reset(3)
    assert first == {"tick": 0, "entities": {"agent_0": {"kind": "agent", "position": [3.0, 1.0], "velocity": [2.0, 0.0], "observation": [3.0, 1.0, 2.0], "alive": True}}}
    assert world.legal("agent_0") == [0, 1, 2] and world.legal("other") == []
    saved, before = world.save(), world.hash()
    done = world.step({"agent_0": 2})
    assert done["receipts"]["agent_0"] == {"outcome_code": "ok", "success": True, "energy_delta": 0.0, "diagnostics": {"reward": 2.0, "termination": False, "truncation": False}}
    assert (done["state_before_hash"], done["state_after_hash"]) == (before, world.hash()) and world.steps() == 1
    rejected = world.step({"agent_0": 9})
    assert rejected["receipts"]["agent_0"]["outcome_code"] == "illegal_action" and rejected["receipts"]["agent_0"]["diagnostics"]["rejected"]
    world.load(saved)
    assert world.hash() == before


def test_client_and_capabilities():
    world = A.Client(A.CounterClient())
    world.reset(0)
    assert json.loads(world.step({"agent_0": 1})["maps"]["rewards_by_agent"]) == {"agent_0": 2.0} and world.steps() == 2
    assert A.capability("mpe2/simple_tag_v3")["exact_restore"] and not A.capability("other")["exact_restore"]
    assert A.capability("other", E.Counter)["exact_restore"]

    class Forgetful(E.Counter):
        def load(self, saved):
            pass

    assert not A.capability("mpe2/simple_tag_v3", Forgetful, (0, 1))["exact_restore"]


def test_joint_steps():
    world = A.Parallel(Pair())
    world.reset(1)
    assert world.joint({"a": 1}) == ({"a": 1, "b": A.STAY}, {"a": "ok", "b": "ok"})
    assert world.joint({"a": 7, "b": True}) == ({"a": 0, "b": 0}, {"a": "illegal_action", "b": "illegal_action"})
    for proposals, missing in (({"a": 1}, "error"), ({"c": 1}, "noop"), ({}, "guess")):
        with pytest.raises(ValueError):
            world.joint(proposals, missing)
    seen = world.observe_agent("a")
    assert seen["others"] == [{"agent_id": "b", "position": [1.0, 2.0], "alive": True}] and "velocity" in seen["own"]
    world.step({"a": 1, "b": 1})
    done = world.step({"a": 1, "b": 0})
    maps = {k: json.loads(v) for k, v in done["maps"].items()}
    assert maps["terminations_by_agent"] == {"a": True, "b": False} and maps["rewards_by_agent"] == {"a": 1.0, "b": 0.0} and maps["active_agents_after"] == ["b"]
    assert maps["infos_digest_by_agent"]["a"] == A.digest({"t": 2, "odd": {1}})
    assert world.agents() == ["b"] and not world.view()["entities"]["a"]["alive"] and world.legal("a") == []
    failed = world.step({"b": 2})
    assert "broken" in failed["error"] and failed["receipts"]["b"]["outcome_code"] == "unknown_failure" and world.agents() == ["b"]
    world.step({"b": 1})
    assert world.agents() == []


def test_runs(spark):
    seeds = spark.createDataFrame([(1,), (4,)], "seed long")
    rows = A.run(seeds, lambda: A.Parallel(Pair()), lambda seed, tick, agent, seen: 1 if agent == "b" else None).collect()
    assert sorted((r.seed, r.tick, r.agent_id, r.action, r.alive) for r in rows) == [(s, t, a, int(a == "b"), (a, t) not in (("a", 1), ("b", 2))) for s in (1, 4) for t, a in ((0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "b"))]
    by = {(r.seed, r.tick): r for r in rows}
    assert by[1, 0].state_after_hash == by[1, 1].state_before_hash
    assert json.loads(by[4, 1].terminations_by_agent) == {"a": True, "b": False}
    single = A.run(seeds, lambda: A.Single(Gym()), lambda seed, tick, agent, seen: 9 if tick == 0 else 2).collect()
    assert sorted((r.seed, r.tick, r.outcome_code) for r in single if r.tick < 2) == [(s, t, "ok" if t else "illegal_action") for s in (1, 4) for t in (0, 1)]
    living = spark.createDataFrame([("agent", "a", ["a"]), ("agent", "b", ["a"]), ("landmark", "a", ["a"]), ("agent", "a", None)], "kind string, id string, active array<string>")
    assert [r.x for r in living.select(A.alive(F.col("kind"), F.col("id"), F.col("active")).alias("x")).collect()] == [True, False, False, False]


def test_external_scenario():
    package = A.scenario("own", {"n": 2}, Pair)
    assert package["params_hash"] != A.scenario("own", {"n": 3}, Pair)["params_hash"] and not package["capabilities"]["exact_restore"]
    world = package["make"]()
    world.reset(0)
    assert world.agents() == ["a", "b"]
    with pytest.raises(ValueError):
        A.scenario("unknown", {})
    assert A.scenario("simple_tag", {})["capabilities"]["exact_restore"]


GOOD = json.dumps({"choices": [{"message": {"content": '{"action_type": "go"}'}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}).encode()


def test_transport(monkeypatch):
    where = TP.Endpoint("http://host/v1/", "m", "TEST_KEY", system="be brief")
    with pytest.raises(TP.LLMAuthError, match="TEST_KEY"):
        TP.ask(where, "x", lambda *a: (200, GOOD))
    monkeypatch.setenv("TEST_KEY", " , secret1,secret2")
    asked = []

    def good(url, body, headers, seconds):
        asked.append((url, json.loads(body), headers, seconds))
        return 200, GOOD

    assert TP.ask(where, "hello", good) == TP.Reply('{"action_type": "go"}', 7, 3, "stop")
    url, body, headers, seconds = asked[0]
    assert url == "http://host/v1/chat/completions" and headers["Authorization"] == "Bearer secret1" and seconds == 30.0
    assert body == {"model": "m", "messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "hello"}], "temperature": 0.0, "max_tokens": 256, "stream": False}
    for status, error in ((401, TP.LLMAuthError), (403, TP.LLMAuthError), (429, TP.LLMRateLimitError), (500, TP.LLMServerError), (503, TP.LLMServerError), (404, TP.LLMClientError)):
        with pytest.raises(TP.LLMClientError) as caught:
            TP.ask(where, "x", lambda *a, s=status: (s, b"secret body"))
        assert type(caught.value) is error and "secret" not in str(caught.value)
    for raw in (b"\xff", b"[]", b"{}", b'{"choices": []}', b'{"choices": 5}'):
        with pytest.raises(TP.LLMProtocolError):
            TP.ask(where, "x", lambda *a, r=raw: (200, r))
    assert TP.ask(where, "x", lambda *a: (200, b'{"choices": [{}]}')).text == ""

    def fails(error):
        def send(*args):
            raise error

        return send

    for error, kind in ((TimeoutError(), TP.LLMTimeoutError), (urllib.error.URLError(TimeoutError()), TP.LLMTimeoutError), (urllib.error.URLError(ConnectionRefusedError()), TP.LLMClientError)):
        with pytest.raises(TP.LLMClientError) as caught:
            TP.ask(where, "x", fails(error))
        assert type(caught.value) is kind


def test_tries_over_a_transport(monkeypatch):
    """An error is an attempt with its class name; the tokens are the provider's."""
    monkeypatch.setenv("TEST_KEY", "k")
    answers = [(429, b""), (200, b"nothing"), (200, GOOD)]
    client = TP.make_client(TP.Endpoint("http://host", "m", "TEST_KEY"), lambda *a: answers.pop(0))()
    waits = []
    tries = DE.one("prompt", ["go"], client, 3, waits.append)
    assert [t["error_category"] for t in tries] == ["LLMRateLimitError", "LLMProtocolError", None] and waits == [0.5, 1.0]
    assert (tries[2]["action_type"], tries[2]["input_tokens"], tries[2]["output_tokens"]) == ("go", 7, 3)
    assert DE.one("abcdefgh", ["go"], DE.echo()(), 0)[0]["output_tokens"] == 20


@pytest.fixture(scope="module")
def relief():
    return spec.compile_spec(scenarios.RELIEF)


def test_checkpoints(spark, relief):
    records = S.rollout(spark, relief, spark.range(3).withColumnRenamed("id", "seed"), 9).cache()
    rows = CP.checkpoints(records, relief, 4).cache()
    assert sorted((r.seed, r.tick) for r in rows.collect()) == sorted({(r.seed, r.tick) for r in records.collect() if r.tick % 4 == 0})
    before = {(r.seed, r.tick): r.state_before_hash for r in records.collect()}
    assert all(r.state_hash == before[r.seed, r.tick] for r in rows.collect())
    c = F.col
    by_plan = CFO.checkpoint_checksum(c("schema_version"), c("world_id"), c("world_version"), c("tick"), c("state_hash"), c("payload"), c("payload_codec"), c("rng_bundle"))
    assert rows.filter(by_plan != c("checksum")).count() == 0
    assert {r.ok for r in CP.restored(rows, relief).collect()} == {True}
    forged = rows.withColumn("payload", F.expr("cast(replace(cast(payload as string), '\"births\": 0', '\"births\": 1') as binary)"))
    assert {r.message for r in CP.restored(forged, relief).collect()} == {"the checksum does not fit"}
    assert {r.message for r in CP.restored(rows.withColumn("payload_codec", F.lit("pickle")), relief).collect()} == {"unknown codec pickle"}


@pytest.mark.parametrize("twister", [False, True])
def test_checkpoint_of_a_world(relief, twister):
    world = World(relief, twister=twister)
    world.reset(5)
    world.step([("e0", "REST", {})], world.exogenous())
    row = CP.take(world)
    ahead = [world.exogenous() for _ in range(20)]
    assert CP.restore(world, row) == "" and [world.exogenous() for _ in range(20)] == ahead
    wrong = row | {"state_hash": "sha256:other"}
    assert CP.restore(world, wrong | {"checksum": CP.checksum(wrong)}).startswith("the restored state")


def test_branch_fingerprints(spark, relief):
    records = S.rollout(spark, relief, spark.range(3).withColumnRenamed("id", "seed"), 12)
    rows = S.branch(records, relief).collect()
    forks = {}
    for r in rows:
        forks.setdefault((r.seed, r.fork_tick), set()).add(r.fingerprint_before)
        assert r.fingerprint_after == r.fingerprint_before  # a step draws nothing from the event stream
    assert all(len(f) == 1 for f in forks.values())
    assert S.no_branches(records).count() == 0 and S.no_branches(records).columns == S.branch(records, relief).columns


def test_whole_dataset_is_written(spark, relief, tmp_path):
    from tracelake.operators import dataset as DS

    made = DS.build(spark, scenarios.RELIEF, spark.range(6).withColumnRenamed("id", "seed"), DS.Config(ticks=6))
    DS.write(made, str(tmp_path / "d"))
    read = lambda name: spark.read.json(str(tmp_path / "d" / name))
    documents = {r.name: json.loads(r.value) for r in read("documents").collect()}
    assert documents["capabilities"] == json.loads(json.dumps(spec.capabilities(relief))) and documents["world_parameters"]["time"]["max_ticks"] == 60 and documents["schema"]["type"] == "struct"
    counts = {r.split: r.record_count for r in read("split_manifests").collect()}
    assert sum(counts.values()) == made.steps.count() and set(counts) <= {"train", "val", "test"}
    assert spark.read.text(str(tmp_path / "d/card")).filter("value like '# Dataset relief'").count() == 1


def test_loader(spark, sf_dir):
    from tracelake.operators import loader
    from tracelake.operators import records as R
    from tracelake.trajectory import episodes, split_of, transitions

    rows = transitions(spark, sf_dir)
    splits = episodes(rows).select("episode_id", split_of(F.col("seed")).alias("split")).filter("split <> 'val'")
    found = loader.load(R.records(rows), splits, rows.filter("tick % 2 = 0").select("episode_id", "tick", F.col("d").cast("double").alias("outcome")))
    plain = {(r.episode_id, r.tick): r.d / 100 for r in rows.collect()}
    known = {r.episode_id: r.split for r in splits.collect()}
    out = {(r.episode_id, r.tick): r for r in found.collect()}
    assert set(out) == {k for k in plain if k[0] in known}
    for (e, t), r in out.items():
        assert r.split == known[e] and r.horizon == pytest.approx(sum(plain.get((e, t + k), 0) for k in (1, 2, 3))) and r.outcome == (round(plain[e, t] * 100) if t % 2 == 0 else 0)
    assert {r.split for r in loader.load(R.records(rows), splits, split="test").collect()} == {"test"}


def test_schema_document():
    assert spec.packaged_schema() == json.loads(json.dumps(spec.json_schema()))
    assert spec.params_hash({"time": {"a": {3, 1, 2}}}) == spec.params_hash({"time": {"a": {2, 3, 1}}}) == spec.params_hash({"time": {"a": [1, 2, 3]}})
    assert spec.params_hash({"time": (1, 2)}) == spec.params_hash({"time": [1, 2]})
