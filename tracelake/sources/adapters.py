"""External environments as worlds: single-agent, parallel and client environments behind one interface.

No environment library is needed; what is wrapped is known by what it has.

- Single: reset(seed=) -> observation or (observation, info), step(action)
  -> the five parts, a discrete action_space.
- Parallel: the same with dictionaries by agent, and `agents`, the list of
  those still active.
- Client: a remote environment with reset(seed), step(action) and state().

A world is a fold over ticks, so an episode runs in one task and episodes
are dealt over tasks. All views are plain values: the rows of entities carry
position (observation dimensions 0 and 1), velocity (2 and 3), the whole
observation and whether the agent is alive.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import hash_value
from ..operators.simulate import _per_seed, dealt
from ..operators.world import frozen
from .environments import Counter, discrete_actions, external_params_hash, restores_exactly

#: What a missing or an illegal proposal becomes in a joint step.
STAY = 0

MISSING = ("noop", "stay", "error")

# Environment families whose exact restore has been verified.
RESTORE_VERIFIED = ("mpe2/simple_spread_v3", "mpe2/simple_tag_v3")

#: What outside worlds have: entities alone.
PROFILE = {
    "fields": False, "entities": True, "relations": False, "registries": False, "population": False, "events": False,
    "authority": "rule", "ground_truth": True, "transition_mode": "deterministic",
}


def capability(family: str, make: Callable | None = None, actions: Sequence[int] = (0, 1, 0)) -> dict:
    """The profile of a family. Exact restore is claimed for a listed family, or where make() passes the probe, never for a family alone by name
    if a probe was run and failed."""
    holds = restores_exactly(make, list(actions)) if make is not None else family in RESTORE_VERIFIED
    return PROFILE | {"exact_restore": holds, "executable_deterministic_replay": holds}


def _numbers(observation) -> list[float]:
    if hasattr(observation, "tolist"):
        observation = observation.tolist()
    if isinstance(observation, (list, tuple)):
        return [float(x) for x in observation]
    return [float(observation)] if isinstance(observation, (int, float)) else []


def digest(info: Mapping) -> str:
    """Of an agent's info: SHA-256 over JSON with sorted keys; what JSON lacks is written as text."""
    return "sha256:" + hashlib.sha256(json.dumps(dict(info), sort_keys=True, default=str).encode()).hexdigest()


class External:
    """An environment as a world. Subclasses say how it is reset and stepped; all else is alike."""

    version = "1"

    def __init__(self, env, name: str = "external"):
        self.env, self.name, self.ready = env, name, False

    def _start(self, seed: int) -> tuple[dict, dict]:
        """(observations, infos) by agent"""
        raise NotImplementedError

    def _advance(self, actions: dict[str, int]) -> tuple[dict, dict, dict, dict, dict]:
        """(observations, rewards, terminations, truncations, infos) by agent"""
        raise NotImplementedError

    def agents(self) -> list[str]:
        """Those that are active: an empty list means that all are finished, and none comes back."""
        self._need_reset()
        return sorted(self.active)

    def reset(self, seed: int) -> dict:
        self.observations, self.infos = self._start(seed)
        self.active, self.known, self.tick, self.ready = set(self.observations), sorted(self.observations), 0, True
        return self.view()

    def _need_reset(self) -> None:
        if not self.ready:
            raise RuntimeError("reset comes first")

    def steps(self) -> int:
        """The environment's own step counter, else the number of steps taken."""
        found = getattr(getattr(self.env, "unwrapped", self.env), "steps", None)
        return found if isinstance(found, int) else self.tick

    def view(self) -> dict:
        self._need_reset()
        rows = {}
        for a in self.known:
            x = _numbers(self.observations.get(a, ()))
            whole = x + [0.0] * max(0, 4 - len(x))
            rows[a] = {"kind": "agent", "position": whole[:2], "velocity": whole[2:4], "observation": x, "alive": a in self.active}
        return {"tick": self.steps(), "entities": rows}

    def hash(self) -> str:
        return hash_value(frozen(self.view()))

    def fingerprint(self) -> str:
        """Of the environment's generator, empty if it shows none."""
        bits = getattr(getattr(getattr(self.env, "unwrapped", self.env), "np_random", None), "bit_generator", None)
        return "" if bits is None else digest(bits.state)

    def legal(self, agent: str) -> list[int]:
        return list(range(discrete_actions(self.env))) if agent in self.active else []

    def observe_agent(self, agent: str) -> dict:
        """Own position, velocity and observation; of the others position and life alone."""
        rows = self.view()["entities"]
        return {
            "focal": agent, "own": rows[agent], "others": [{"agent_id": a, "position": r["position"], "alive": r["alive"]} for a, r in rows.items() if a != agent],
            "legal": self.legal(agent), "omitted": ["fields", "relations", "registries", "population", "events"],
        }

    def save(self) -> dict:
        """A checkpoint in memory, for environments that can save themselves."""
        return {"env": self.env.save(), "observations": dict(self.observations), "active": sorted(self.active), "tick": self.tick}

    def load(self, saved: Mapping) -> None:
        self.env.load(saved["env"])
        self.observations, self.infos, self.active, self.tick = dict(saved["observations"]), {}, set(saved["active"]), saved["tick"]

    def joint(self, proposals: Mapping[str, object], missing: str = "noop") -> tuple[dict[str, int], dict[str, str]]:
        """(action, outcome) of every active agent: an illegal proposal becomes STAY and is recorded as such, so does a missing one unless that is an error."""
        if missing not in MISSING:
            raise ValueError(f"missing is one of {MISSING}")
        if unknown := sorted(set(proposals) - self.active):
            raise ValueError(f"agents that are not active: {unknown}")
        gone = sorted(self.active - set(proposals))
        if gone and missing == "error":
            raise ValueError(f"agents without a proposal: {gone}")
        actions, outcomes = {}, {}
        for a in sorted(self.active):
            legal = a not in proposals or (not isinstance(proposals[a], bool) and proposals[a] in self.legal(a))
            actions[a] = int(proposals[a]) if a in proposals and legal else STAY
            outcomes[a] = "ok" if legal else "illegal_action"
        return actions, outcomes

    def step(self, proposals: Mapping[str, object], missing: str = "noop") -> dict:
        """One step of all active agents at once: a receipt for each and the maps by agent that a record keeps.

        A receipt's energy_delta is 0; the reward is in its diagnostics. An
        environment that fails gives every agent an unknown_failure.
        """
        self._need_reset()
        before, tick, active = self.hash(), self.steps(), self.agents()
        prints = [self.fingerprint()]
        actions, outcomes = self.joint(proposals, missing)
        error = None
        try:
            observations, rewards, ended, cut, infos = self._advance(actions)
        except Exception as e:  # what an environment does wrong is a record, not the end of the run
            error, rewards, ended, cut, infos = repr(e), {}, {}, {}, {}
            outcomes = dict.fromkeys(active, "unknown_failure")
        else:
            self.observations |= observations
            self.infos, self.tick = infos, self.tick + 1
            self.active &= {a for a in active if not ended.get(a) and not cut.get(a)}
        by = lambda values, kind: {a: kind(values.get(a, kind())) for a in active}
        maps = {
            "environment_actions_by_agent": actions, "rewards_by_agent": by(rewards, float), "terminations_by_agent": by(ended, bool), "truncations_by_agent": by(cut, bool),
            "infos_digest_by_agent": {a: digest(infos.get(a, {})) for a in active}, "active_agents_before": active, "active_agents_after": self.agents(),
        }
        receipts = {
            a: {
                "outcome_code": outcomes[a], "success": outcomes[a] == "ok", "energy_delta": 0.0,
                "diagnostics": {"reward": maps["rewards_by_agent"][a], "termination": maps["terminations_by_agent"][a], "truncation": maps["truncations_by_agent"][a]} | ({"rejected": True} if outcomes[a] == "illegal_action" else {}),
            }
            for a in active
        }
        return {
            "tick": tick, "state_before_hash": before, "state_after_hash": self.hash(), "receipts": receipts, "maps": {k: json.dumps(v, sort_keys=True) for k, v in maps.items()}, "error": error,
            "fingerprint_before": prints[0], "fingerprint_after": self.fingerprint(),
        }


class Single(External):
    """A single-agent environment; its agent is agent_0."""

    agent = "agent_0"

    def _start(self, seed):
        found = self.env.reset(seed=seed)
        observation, info = found if isinstance(found, tuple) and len(found) == 2 and isinstance(found[1], Mapping) else (found, {})
        return {self.agent: observation}, {self.agent: info}

    def _advance(self, actions):
        parts = self.env.step(actions[self.agent])
        return tuple({self.agent: p} for p in parts)


class Parallel(External):
    def _start(self, seed):
        found = self.env.reset(seed=seed)
        return found if isinstance(found, tuple) else (found, {})

    def legal(self, agent):
        if agent not in self.active:
            return []
        space = getattr(self.env, "action_space", None)
        n = getattr(space(agent), "n", None) if callable(space) else None
        return list(range(n)) if isinstance(n, int) else super().legal(agent)

    def _advance(self, actions):
        parts = self.env.step(actions)
        if len(parts) != 5:
            raise ValueError(f"a parallel step has 5 parts, not {len(parts)}")
        return parts

    def agents(self):
        self._need_reset()
        listed = getattr(self.env, "agents", None)
        return sorted(self.active if listed is None else self.active & set(listed))


class Client(Single):
    """A remote environment: states are dictionaries with tick and observation."""

    def _start(self, seed):
        return {self.agent: self.env.reset(seed).get("observation", ())}, {}

    def _advance(self, actions):
        state, reward, ended, cut, info = self.env.step(actions[self.agent])
        return {self.agent: state.get("observation", ())}, {self.agent: reward}, {self.agent: ended}, {self.agent: cut}, {self.agent: info}

    def steps(self):
        return int(self.env.state().get("tick", self.tick))


class CounterClient(Counter):
    """The tick counter in the manner of a remote environment, within the process."""

    def _said(self) -> dict:
        return {"tick": self.tick, "observation": [float(self.tick)]}

    def reset(self, seed: int = 0):
        super().reset(seed)
        return self._said()

    def step(self, action: int):
        _, reward, ended, cut, info = super().step(action)
        return self._said(), reward, ended, cut, info

    def state(self) -> dict:
        return self._said()


class Counters:
    """Tick counters in the manner of a parallel environment, each agent with an end of its own."""

    n_actions = 2

    def __init__(self, ends: Mapping[str, int]):
        self.each = {a: Counter(end) for a, end in ends.items()}

    def reset(self, seed: int = 0):
        return {a: c.reset(seed) for a, c in self.each.items()}, {}

    def step(self, actions: Mapping[str, int]):
        done = {a: self.each[a].step(x) for a, x in actions.items()}
        return tuple({a: parts[k] for a, parts in done.items()} for k in range(5))


STEPS = (
    "seed long, tick long, agent_id string, action long, outcome_code string, reward double, terminated boolean, truncated boolean, alive boolean, state_before_hash string, state_after_hash string, "
    "rewards_by_agent string, terminations_by_agent string, truncations_by_agent string, infos_digest_by_agent string, active_agents_after string, fingerprint_before string, fingerprint_after string, error string"
)


def run(seeds: DataFrame, make: Callable[[], External], choose: Callable[[int, int, str, dict], object], most: int = 1000, missing: str = "noop") -> DataFrame:
    """A row for each active agent and step of one episode for each seed. choose(seed, tick, agent, what the agent sees) gives its proposal, or None."""

    def episode(seed: int) -> list[dict]:
        world, rows = make(), []
        world.reset(seed)
        for n in range(most):
            agents = world.agents()
            if not agents:
                break
            chosen = {a: choose(seed, n, a, world.observe_agent(a)) for a in agents}
            done = world.step({a: c for a, c in chosen.items() if c is not None}, missing)
            maps = {k: json.loads(v) for k, v in done["maps"].items()}
            for a in agents:
                said = done["receipts"][a]["diagnostics"]
                rows.append(
                    {k: done[k] for k in ("tick", "state_before_hash", "state_after_hash", "fingerprint_before", "fingerprint_after", "error")} | {k: v for k, v in done["maps"].items() if k in STEPS}
                    | {"seed": seed, "agent_id": a, "action": maps["environment_actions_by_agent"][a], "outcome_code": done["receipts"][a]["outcome_code"], "reward": said["reward"], "terminated": said["termination"], "truncated": said["truncation"], "alive": a in maps["active_agents_after"]}
                )
            if done["error"]:
                break
        return rows

    return dealt(seeds).mapInPandas(_per_seed(episode, STEPS), STEPS)


def alive(kind: Column, entity: Column, active: Column) -> Column:
    """Agents that are still active; nothing else is alive."""
    return (kind == "agent") & F.coalesce(F.array_contains(active, entity), F.lit(False))


#: Makers of external scenarios by name: (module, function) of an installed environment library.
FACTORIES = {"simple_spread": ("mpe2.simple_spread_v3", "parallel_env"), "simple_tag": ("mpe2.simple_tag_v3", "parallel_env")}


def scenario(name: str, parameters: Mapping, make: Callable | None = None) -> dict:
    """A package of an external scenario: its family, its parameters, their hash, its capabilities and a maker of its world."""
    if make is None:
        if name not in FACTORIES:
            raise ValueError(f"no factory for {name}; known are {sorted(FACTORIES)}")
        import importlib

        module, function = FACTORIES[name]
        make = lambda: getattr(importlib.import_module(module), function)(**parameters)
    family = FACTORIES[name][0].replace(".", "/") if name in FACTORIES else name
    return {"family": family, "parameters": dict(parameters), "params_hash": external_params_hash({"scenario": name, **parameters}), "capabilities": capability(family), "make": lambda: Parallel(make(), name)}
