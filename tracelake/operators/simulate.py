"""Rollout, replay, branches and matched utilities: one task's fold for each episode."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .policies import BUILT_IN
from .world import HashRandom, World

TRANSITION = (
    "episode_id string, seed long, tick long, agent_id string, action_type string, params string, policy_id string, outcome_code string, receipt_delta double, "
    "realized_delta double, died boolean, exogenous string, state_before_hash string, state_after_hash string"
)


#: Rows that a task hands over at once.
BATCH = 5000


def _energy(world: World, agent: str) -> float:
    return float(world.state["entities"].get(agent, {}).get("energy") or 0.0)


def _row(world: World, episode: str, seed: int, agent: str, action: tuple[str, dict], policy: str, event: Mapping | None, before: str | None = None) -> dict:
    """One step of one agent, as a row; before is the state's hash, if it is known from the step before."""
    before, energy, tick = before or world.hash(), _energy(world, agent), world.state["tick"]
    code, delta = world.receipt(agent, *action)
    world.step([(agent, *action)], event)
    return {
        "episode_id": episode, "seed": seed, "tick": tick, "agent_id": agent, "action_type": action[0], "params": json.dumps(action[1], sort_keys=True), "policy_id": policy, "outcome_code": code,
        "receipt_delta": delta, "realized_delta": _energy(world, agent) - energy, "died": agent in world.state["died"], "exogenous": json.dumps(event, sort_keys=True) if event else None,
        "state_before_hash": before, "state_after_hash": world.hash(),
    }


def _episode(spec: Mapping, seed: int, ticks: int, policies: Mapping[str, Callable], strict: bool) -> list[dict]:
    world, rows, names = World(spec, strict), [], list(policies)
    world.reset(seed)
    rngs = {p: HashRandom(seed, f"policy:{p}") for p in names}
    for tick in range(ticks):
        alive = world.state["alive"] if world.caps["population"] else list(world.state["entities"])
        if not alive:
            break
        agent, policy = alive[tick % len(alive)], names[tick % len(names)]
        event = world.exogenous()
        action = policies[policy](world, agent, world.legal(agent), rngs[policy], tick) or ("noop", {})
        rows.append(_row(world, f"seed{seed}_run0", seed, agent, action, policy, event, rows[-1]["state_after_hash"] if rows else None))
    return rows


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _per_seed(episode: Callable[[int], list[dict]], schema: str) -> Callable:
    """A task's function: the rows of all its seeds' episodes, some BATCH of them at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        for part in parts:
            for seed in part["seed"]:
                rows += episode(int(seed))
                if len(rows) >= BATCH:
                    yield _frame(rows, schema)
                    rows = []
        yield _frame(rows, schema)

    return run


def dealt(seeds: DataFrame) -> DataFrame:
    """Seeds over as many tasks as the session's shuffles have: few bytes, but long work each, so sizes must not decide."""
    return seeds.select("seed").repartition(int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seed")


def rollout(spark: SparkSession, spec: Mapping, seeds: DataFrame, ticks: int, policies: Mapping[str, Callable] | None = None, strict: bool = False) -> DataFrame:
    """One episode for each seed of a frame (column seed), a task for a share of them."""
    policies = policies or {k: BUILT_IN[k] for k in ("random", "scripted", "adversarial")}

    return dealt(seeds).mapInPandas(_per_seed(lambda seed: _episode(spec, seed, ticks, policies, strict), TRANSITION), TRANSITION)


def spawned(seeds: DataFrame, spec: Mapping) -> DataFrame:
    """The entities of each seed's world before its first step, a column for each of theirs."""
    kinds = {"int": "long", "float": "double", "bool": "boolean", "str": "string"}
    schema = "seed long, entity_id string, " + ", ".join(f"`{c['name']}` {kinds[c['dtype']]}" for c in spec["entities"]["columns"])
    fit = {c["name"]: float if c["dtype"] == "float" else lambda v: v for c in spec["entities"]["columns"]}

    def episode(seed: int) -> list[dict]:
        world = World(spec)
        world.reset(seed)
        return [{"seed": seed, "entity_id": e, **{k: fit[k](v) for k, v in row.items()}} for e, row in world.state["entities"].items()]

    return dealt(seeds).mapInPandas(_per_seed(episode, schema.replace("`", "")), schema)


def after_step(seeds: DataFrame, spec: Mapping, actions: Sequence[tuple[str, str, dict | None]]) -> DataFrame:
    """What one step of the given actions (agent, type, parameters, or None for the default ones) does in each seed's world without an event:
    energies and nodes, the first registry entry's owner, the first field and the number of edges."""
    schema = "seed long, entity_id string, energy double, node string, owner string, water_level double, edges int"

    def episode(seed: int) -> list[dict]:
        world = World(spec)
        world.reset(seed)
        world.step([(agent, kind, dict(world.legal(agent))[kind] if params is None else params) for agent, kind, params in actions])
        s = world.state
        rest = {"owner": s["registries"][0]["owner_id"], "water_level": s["fields"]["water_level"], "edges": len(s["edges"])}
        return [{"seed": seed, "entity_id": e, "energy": round(row["energy"], 9), "node": row["node"]} | rest for e, row in s["entities"].items()]

    return dealt(seeds).mapInPandas(_per_seed(episode, schema), schema)


def joint_rollout(spark: SparkSession, spec: Mapping, seeds: DataFrame, ticks: int, policy: Callable, missing: str = "noop") -> DataFrame:
    """All agents act at each tick; a row for each agent, all with the tick's state hashes."""

    def episode(seed: int) -> list[dict]:
        world, rows = World(spec), []
        world.reset(seed)
        rng = HashRandom(seed, "policy:joint")
        for tick in range(ticks):
            alive = list(world.state["alive"])
            if not alive:
                break
            event = world.exogenous()
            actions = [(a, *(policy(world, a, world.legal(a), rng, tick) or (missing, {}))) for a in alive]
            before, energy = world.hash(), {a: _energy(world, a) for a in alive}
            codes = {a: world.receipt(a, kind, params) for a, kind, params in actions}
            world.step(actions, event)
            after = world.hash()
            for a, kind, params in actions:
                rows.append({
                    "episode_id": f"seed{seed}_joint", "seed": seed, "tick": tick, "agent_id": a, "action_type": kind, "params": json.dumps(params, sort_keys=True), "policy_id": "joint", "outcome_code": codes[a][0],
                    "receipt_delta": codes[a][1], "realized_delta": _energy(world, a) - energy[a], "died": a in world.state["died"], "exogenous": json.dumps(event, sort_keys=True) if event else None,
                    "state_before_hash": before, "state_after_hash": after,
                })
        return rows

    return dealt(seeds).mapInPandas(_per_seed(episode, TRANSITION), TRANSITION)


REPLAY = "episode_id string, tick long, anchored boolean, expected string, actual string, ok boolean"


def replay(records: DataFrame, spec: Mapping, first: int = 5, strict: bool = False) -> DataFrame:
    """The first ticks of each episode run again with the recorded actions and events; anchored on the first state."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tick", "agent_id"])
        world, rows = World(spec, strict), []
        world.reset(int(group["seed"].iloc[0]))
        anchored = world.hash() == group["state_before_hash"].iloc[0]
        for n, (tick, step) in enumerate(group.groupby("tick", sort=True)):
            if n >= first or not anchored:
                break
            event = step["exogenous"].iloc[0]
            world.step([(r.agent_id, r.action_type, json.loads(r.params)) for r in step.itertuples()], json.loads(event) if event else None)
            actual, expected = world.hash(), step["state_after_hash"].iloc[0]
            rows.append({"episode_id": step["episode_id"].iloc[0], "tick": tick, "anchored": True, "expected": expected, "actual": actual, "ok": actual == expected})
        if not anchored:
            rows.append({"episode_id": group["episode_id"].iloc[0], "tick": int(group["tick"].iloc[0]), "anchored": False, "expected": group["state_before_hash"].iloc[0], "actual": None, "ok": False})
        return _frame(rows, REPLAY)

    return records.groupBy("episode_id").applyInPandas(run, REPLAY)


BRANCH = TRANSITION + ", fork_tick long, error string, fingerprint_before string, fingerprint_after string"


def fingerprint(world: World) -> str:
    """Of the world's generators, as counterfactual.fingerprint() gives it for a bundle of one entry."""
    return "sha256:" + hashlib.sha256(f"exogenous\0{json.dumps(world.snapshot()['exo'])}\0".encode()).hexdigest()


def no_branches(records: DataFrame, spec: Mapping | None = None) -> DataFrame:
    """The brancher that makes none."""
    return records.sparkSession.createDataFrame([], BRANCH)


def branch(records: DataFrame, spec: Mapping, every: int = 5, most: int = 2, steps: int = 1) -> DataFrame:
    """At every so many ticks, up to most legal alternatives of other action types than the recorded one, each from the same state.

    The fork's event is held fixed in the alternative's first step, and the
    generators are those of the fork: their fingerprints before and after the
    step say so. An alternative that fails gives a row with its error; the parent goes on
    from its own snapshot.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        world, rows = World(spec), []
        group = group.sort_values("tick")
        world.reset(int(group["seed"].iloc[0]))
        for r in group.itertuples():
            event = json.loads(r.exogenous) if r.exogenous else None
            if r.tick > 0 and r.tick % every == 0:
                fork, seen = world.snapshot(), {r.action_type}
                for kind, params in world.legal(r.agent_id):
                    if kind in seen or len(seen) > most:
                        continue
                    name = f"{r.episode_id}_cf_t{r.tick}_b{len(seen) - 1}"
                    seen.add(kind)
                    try:
                        for k in range(steps):
                            before = fingerprint(world)
                            row = _row(world, name, int(r.seed), r.agent_id, (kind, params), "counterfactual_branch", event if k == 0 else None)
                            rows.append(row | {"fork_tick": r.tick, "error": None, "fingerprint_before": before, "fingerprint_after": fingerprint(world)})
                    except Exception as e:  # an alternative must not end the parent
                        rows.append({"episode_id": name, "seed": int(r.seed), "tick": r.tick, "agent_id": r.agent_id, "action_type": kind, "fork_tick": r.tick, "error": repr(e)})
                    world.restore(fork)
            world.step([(r.agent_id, r.action_type, json.loads(r.params))], event)
        return _frame(rows, BRANCH)

    return records.groupBy("episode_id").applyInPandas(run, BRANCH)


def joint_branch(records: DataFrame, spec: Mapping, every: int = 5, most: int = 2) -> DataFrame:
    """At every so many ticks, alternatives of the first agent's action while all others do what they did; distinct by parameters."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        world, rows = World(spec), []
        group = group.sort_values(["tick", "agent_id"])
        world.reset(int(group["seed"].iloc[0]))
        for tick, step in group.groupby("tick", sort=True):
            event = step["exogenous"].iloc[0]
            event = json.loads(event) if event else None
            actions = [(r.agent_id, r.action_type, json.loads(r.params)) for r in step.itertuples()]
            if tick > 0 and tick % every == 0:
                fork, (focal, *own), n = world.snapshot(), actions[0], 0
                seen = {json.dumps(own, sort_keys=True)}
                for kind, params in world.legal(focal):
                    key = json.dumps([kind, params], sort_keys=True)
                    if key in seen or n == most:
                        continue
                    seen.add(key)
                    before, energy, at_fork = world.hash(), _energy(world, focal), fingerprint(world)
                    code, delta = world.receipt(focal, kind, params)
                    world.step([(focal, kind, params), *actions[1:]], event)
                    rows.append({
                        "episode_id": f"{step['episode_id'].iloc[0]}_cf_t{tick}_b{n}", "seed": int(step["seed"].iloc[0]), "tick": tick, "agent_id": focal, "action_type": kind, "params": json.dumps(params, sort_keys=True),
                        "policy_id": "counterfactual_branch", "outcome_code": code, "receipt_delta": delta, "realized_delta": _energy(world, focal) - energy, "died": focal in world.state["died"],
                        "exogenous": json.dumps(event, sort_keys=True) if event else None, "state_before_hash": before, "state_after_hash": world.hash(), "fork_tick": tick, "error": None, "fingerprint_before": at_fork, "fingerprint_after": fingerprint(world),
                    })
                    n += 1
                    world.restore(fork)
            world.step(actions, event)
        return _frame(rows, BRANCH)

    return records.groupBy("episode_id").applyInPandas(run, BRANCH)


UTILITY = "seed long, tick long, agent_id string, policy_id string, action_type string, outcome_code string, state_before_hash string, exogenous_hash string, state_after_hash string, scalar double"


def matched_utilities(spark: SparkSession, spec: Mapping, seeds: DataFrame, policies: Mapping[str, Callable], baseline: str, horizon: int = 5) -> DataFrame:
    """Every policy from the same state and event at each tick; the baseline's action is the one that the world goes on with."""
    from ..functions.canonical import hash_value
    from .world import frozen

    if len(policies) < 2 or baseline not in policies or horizon <= 0:
        raise ValueError("two policies, one of them the baseline, and a positive horizon are needed")

    def episode(seed: int) -> list[dict]:
        world, rows = World(spec), []
        world.reset(seed)
        rngs = {p: HashRandom(seed, f"policy:{p}") for p in policies}
        for tick in range(horizon):
            alive = [e for e, row in world.state["entities"].items() if row.get("alive", True)]
            if not alive:
                break
            agent, event = alive[tick % len(alive)], world.exogenous()
            fork, taken = world.snapshot(), {}
            exo = hash_value(frozen(event)) if event else "none"
            for name, policy in policies.items():
                world.restore(fork)
                taken[name] = policy(world, agent, world.legal(agent), rngs[name], tick) or ("noop", {})
                r = _row(world, "", seed, agent, taken[name], name, event)
                others = len([d for d in world.state["died"] if d != agent])
                scalar = r["receipt_delta"] + r["realized_delta"] + (1.0 if r["outcome_code"] == "ok" else -2.0) - (5.0 if r["died"] else 0.0) - others
                rows.append({k: r[k] for k in ("seed", "tick", "agent_id", "action_type", "outcome_code", "state_before_hash", "state_after_hash")} | {"policy_id": name, "exogenous_hash": exo, "scalar": scalar})
            world.restore(fork)
            world.step([(agent, *taken[baseline])], event)
        return rows

    return dealt(seeds).mapInPandas(_per_seed(episode, UTILITY), UTILITY)


def compare_policies(outcomes: DataFrame, baseline: str) -> DataFrame:
    """Each other policy against the baseline at the same seed and tick; matched if state, event and agent are the same."""
    key = ["seed", "tick"]
    same = ["agent_id", "state_before_hash", "exogenous_hash"]
    b = outcomes.filter(F.col("policy_id") == baseline).select(*key, *[F.col(c).alias(f"b_{c}") for c in same], F.col("scalar").alias("baseline_utility"))
    c = outcomes.filter(F.col("policy_id") != baseline)
    matched = F.lit(True)
    for s in same:
        matched = matched & F.col(s).eqNullSafe(F.col(f"b_{s}"))
    both = c.join(b, key)
    return both.select(*key, "policy_id", "baseline_utility", F.col("scalar").alias("candidate_utility"), (F.col("scalar") - F.col("baseline_utility")).alias("delta"), matched.alias("matched"))


def additive_fields(spec: Mapping, channel: str, actions: Sequence[str]) -> dict[str, float] | None:
    """The change of a scalar field by each action type if all effects on it are constant additions, else None."""
    out = dict.fromkeys(actions, 0.0)
    for action in spec["actions"]["actions"]:
        for effect in action.get("effects", ()):
            if effect.get("target") == "field" and effect.get("field") == channel:
                if effect.get("op") not in ("add", "sub") or not isinstance(effect.get("value"), (int, float)):
                    return None
                out[action["action_type"]] = out.get(action["action_type"], 0.0) + (effect["value"] if effect["op"] == "add" else -effect["value"])
    return out


def field_by_prefix(records: DataFrame, spec: Mapping, channel: str) -> DataFrame:
    """A scalar field after each tick as a running sum: no fold is needed where effects only add."""
    changes = additive_fields(spec, channel, [a["action_type"] for a in spec["actions"]["actions"]])
    if changes is None:
        raise ValueError(f"effects on {channel} are not all constant additions")
    from pyspark.sql import Window

    step = F.lit(0.0)
    for kind, value in changes.items():
        step = F.when(F.col("action_type") == kind, value).otherwise(step)
    event = F.from_json("exogenous", "kind string, payload struct<rate: double, field: string>")
    spawned = (event["kind"] == "resource_spawn") | ((event["kind"] == "hazard_escalation") & (F.coalesce(event["payload"]["field"], F.lit("hazard_level")) == channel))
    step = step + F.when(F.coalesce(spawned, F.lit(False)), F.coalesce(event["payload"]["rate"], F.lit(0.0))).otherwise(0.0)
    w = Window.partitionBy("episode_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return records.select("episode_id", "tick", F.sum(step).over(w).alias(channel))
