"""A rule world: one step at a time, from a compiled specification.

Steps depend on the state before them, so a world is a fold over ticks; the
engine runs one world for each episode and parallelises over episodes.
Randomness comes from hashes of (seed, stream, counter), so an episode is
the same whichever task runs it; twister=True draws from Python's generator.
"""

from __future__ import annotations

import copy
import hashlib
import random
from collections.abc import Mapping

from ..functions.canonical import hash_value
from ..sources.spec import capabilities, params_hash
from . import effects

#: The exogenous stream's seed is the episode's, exclusive-or this number (a fixed value).
EXOGENOUS_SEED = 0x5EEDE05E


class HashRandom:
    """Uniform numbers from SHA-256 of the seed, the stream and a counter; the counter is its whole state."""

    def __init__(self, seed: int, stream: str):
        self.seed, self.stream, self.n = seed, stream, 0

    def random(self) -> float:
        digest = hashlib.sha256(f"{self.seed}|{self.stream}|{self.n}".encode()).digest()
        self.n += 1
        return (int.from_bytes(digest[:8], "big") >> 11) / (1 << 53)

    def uniform(self, low: float, high: float) -> float:
        return low + (high - low) * self.random()

    def randint(self, low: int, high: int) -> int:
        return low + int(self.random() * (high - low + 1))

    def choice(self, items):
        return items[int(self.random() * len(items))]


def frozen(value):
    """Lists as tuples and integers kept apart from floats, for hashing."""
    if isinstance(value, (list, tuple)):
        return tuple(map(frozen, value))
    if isinstance(value, Mapping):
        return {str(k): frozen(v) for k, v in value.items()}
    return value


class World:
    """strict: effects of actions whose preconditions fail don't happen; else any known action's effects do."""

    def __init__(self, spec: Mapping, strict: bool = False, twister: bool = False):
        self.spec, self.strict, self.twister = spec, strict, twister
        self.caps = capabilities(spec)
        self.config = params_hash(spec)
        self.actions = {a["action_type"]: a for a in spec["actions"]["actions"]}

    def reset(self, seed: int) -> None:
        rng = random.Random(seed) if self.twister else HashRandom(seed, "world")
        self.exo_rng = random.Random(seed ^ EXOGENOUS_SEED) if self.twister else HashRandom(seed, "exogenous")
        spec, space = self.spec, self.spec["space"]
        self.state = {
            "tick": 0, "seed": seed, "entities": {}, "alive": [], "births": 0, "deaths": 0, "died": [], "events": [],
            "fields": {}, "registries": [], "edges": [[a, b, "default", 1.0] for a, b in space.get("edges", ())] if self.caps["relations"] else [],
        }
        template = spec["entities"].get("spawn_template", {})
        for i in range(spec["entities"]["initial_count"]):
            self.state["entities"][f"e{i}"] = {c["name"]: self._spawned(c["name"], rng, template, space) for c in spec["entities"]["columns"]}
        for channel in spec["fields"]["channels"] if self.caps["fields"] else ():
            self.state["fields"][channel["name"]] = self._zeros(list(channel.get("shape", ())))
        for e in spec["registries"]["initial_entries"] if self.caps["registries"] else ():
            self.state["registries"].append({"entry_id": str(e["entry_id"]), "registry_type": str(e["registry_type"]), "state": str(e.get("state", "available")), "owner_id": e.get("owner_id")})
        self.state["alive"] = list(self.state["entities"])

    @staticmethod
    def _zeros(shape: list[int]):
        if not shape:
            return 0.0
        if len(shape) == 2:
            return [[0.0] * shape[1] for _ in range(shape[0])]
        n = 1
        for d in shape:
            n *= d
        return [0.0] * n

    @staticmethod
    def _spawned(name: str, rng, template: Mapping, space: Mapping):
        if name == "energy":
            found = list(template.get("energy_range", ()))
            low, high = sorted(map(float, found if len(found) == 2 else (0.0, 10.0)))
            return rng.uniform(low, high)
        if name in ("x", "y"):
            d = "xy".index(name)
            if space["type"] == "discrete":
                shape = space.get("shape", ())
                return rng.randint(0, shape[d] - 1) if d < len(shape) and shape[d] > 0 else 0
            if space["type"] == "continuous":
                bounds = space.get("bounds", ())
                return rng.uniform(*map(float, bounds[d])) if d < len(bounds) else 0.0
            return 0
        if name == "node":
            return rng.choice(space["node_ids"]) if space["type"] == "graph" and space.get("node_ids") else ""
        return True if name == "alive" else 0

    # -- reading -------------------------------------------------------------
    def view(self) -> dict:
        """The state as plain values; slots the world lacks are null."""
        s = self.state
        has = lambda slot, value: value if self.caps[slot] else None
        return {
            "tick": s["tick"], "config": self.config, "entities": s["entities"], "fields": has("fields", s["fields"]), "edges": has("relations", sorted(s["edges"])),
            "registries": has("registries", sorted(s["registries"], key=lambda e: (e["registry_type"], e["entry_id"]))),
            "population": has("population", {"alive": s["alive"], "births": s["births"], "deaths": s["deaths"], "died": s["died"]}), "events": has("events", s["events"]),
        }

    def hash(self) -> str:
        return hash_value(frozen(self.view()))

    def snapshot(self) -> dict:
        """Everything that a later restore needs; plain values, never code."""
        rng = self.exo_rng.getstate() if self.twister else self.exo_rng.n
        return copy.deepcopy({"state": self.state, "exo": rng})

    def restore(self, snapshot: Mapping) -> None:
        snapshot = copy.deepcopy(snapshot)
        self.state = snapshot["state"]
        if self.twister:
            self.exo_rng = random.Random()
            self.exo_rng.setstate(snapshot["exo"])
        else:
            self.exo_rng = HashRandom(self.state["seed"], "exogenous")
            self.exo_rng.n = snapshot["exo"]

    def _moment(self, agent: str, action: Mapping, params: Mapping | None = None) -> effects.Moment:
        return effects.Moment(self.state, self.spec, agent, params or {}, action)

    def allowed(self, action: Mapping, agent: str, params: Mapping) -> bool:
        return effects.allowed(self._moment(agent, action, params))

    def legal(self, agent: str) -> list[tuple[str, dict]]:
        """The actions whose preconditions hold with default parameters, in declared order."""
        out = []
        for name, action in self.actions.items():
            moment = self._moment(agent, action)
            params = {k: effects.default(moment, k, v) for k, v in (action.get("params_schema") or {}).items()}
            if self.allowed(action, agent, params):
                out.append((name, params))
        return out

    def receipt(self, agent: str, action_type: str, params: Mapping) -> tuple[str, float]:
        """(outcome code, energy delta) that validation gives."""
        action = self.actions.get(action_type)
        if action is None:
            return ("unrecognized_intent", 0.0) if self.spec["actions"]["is_closed"] else ("ok", 0.0)
        if not self.allowed(action, agent, params):
            return "illegal_action", 0.0
        return "ok", 0.0 - float(action.get("cost", 0.0))

    # -- writing -------------------------------------------------------------
    def exogenous(self) -> dict | None:
        """One draw for each event with a positive rate; the first that hits happens."""
        hit = None
        for event in self.spec["exogenous"]["events"]:
            rate = float(event.get("rate", 0.0))
            if rate > 0 and self.exo_rng.random() < rate and event.get("kind") and hit is None:
                hit = {"kind": str(event["kind"]), "payload": {k: v for k, v in event.items() if k != "kind"}}
        return hit

    def step(self, actions: list[tuple[str, str, dict]], event: Mapping | None = None) -> None:
        """The event, then each (agent, action type, parameters) in order, the floor under energies, deaths, the next tick."""
        s = self.state
        s["died"], s["events"] = [], []
        if event is not None:
            effects.happen(s, event)
        for agent, kind, params in actions:
            action = self.actions.get(kind)
            if action is not None and (not self.strict or self.allowed(action, agent, params)):
                effects.apply(self._moment(agent, action, params))
        for row in s["entities"].values():
            if row.get("energy") is not None and row["energy"] < 0:
                row["energy"] = 0.0
        if self.caps["population"]:
            for name, row in s["entities"].items():
                if name in s["alive"] and row.get("alive") and (row.get("energy") or 0.0) <= 0:
                    row["alive"] = False
                    s["alive"].remove(name)
                    s["died"].append(name)
                    s["deaths"] += 1
        s["tick"] += 1
