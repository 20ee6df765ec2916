"""External environments as sources: a reset and a step, driven once for each seed.

An environment is any object with reset(seed) -> observation and
step(action) -> (observation, reward, terminated, truncated, info). Parallel
environments take and give dictionaries by agent. No environment library is
needed here; Counter is a small one for tests.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.simulate import dealt

STEPS = "seed long, tick long, agent_id string, action long, reward double, terminated boolean, truncated boolean, observation string"


class Counter:
    """A tick counter: action 0 adds one, action 1 two; the reward is the new tick; it ends at ten."""

    n_actions = 2

    def __init__(self, end: int = 10):
        self.end, self.tick = end, 0

    def reset(self, seed: int = 0):
        self.tick = 0
        return [float(self.tick)]

    def step(self, action: int):
        self.tick += 1 + int(action)
        return [float(self.tick)], float(self.tick), self.tick >= self.end, False, {}

    def save(self) -> dict:
        return {"tick": self.tick}

    def load(self, saved: dict) -> None:
        self.tick = saved["tick"]


def discrete_actions(env) -> int:
    """The number of actions; raises for an action space that isn't discrete."""
    n = getattr(env, "n_actions", None) or getattr(getattr(env, "action_space", None), "n", None)
    if not isinstance(n, int):
        raise TypeError("only discrete action spaces are supported")
    return n


def run_single(seeds: DataFrame, make: Callable, choose: Callable, most: int = 1000) -> DataFrame:
    """One episode for each seed; choose(seed, tick, observation, n) gives an action; illegal ones are rejected and end nothing."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for seed in map(int, part["seed"]):
                env, rows = make(), []
                observation, n = env.reset(seed=seed), discrete_actions(env)
                for tick in range(most):
                    action = choose(seed, tick, observation, n)
                    if not 0 <= action < n:
                        rows.append((seed, tick, "agent_0", action, 0.0, False, False, json.dumps(observation)))
                        continue
                    observation, reward, terminated, truncated, _ = env.step(action)
                    rows.append((seed, tick, "agent_0", action, float(reward), bool(terminated), bool(truncated), json.dumps(observation)))
                    if terminated or truncated:
                        break
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in STEPS.split(", ")])

    return dealt(seeds).mapInPandas(run, STEPS)


def run_parallel(seeds: DataFrame, make: Callable, choose: Callable, most: int = 1000) -> DataFrame:
    """Parallel environments: agents whose list is empty are finished and never come back."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for seed in map(int, part["seed"]):
                env, rows = make(), []
                observations = env.reset(seed=seed)
                for tick in range(most):
                    agents = sorted(observations)
                    if not agents:
                        break
                    actions = {a: choose(seed, tick, a, observations[a]) for a in agents}
                    observations, rewards, terminated, truncated, _ = env.step(actions)
                    for a in agents:
                        rows.append((seed, tick, a, actions[a], float(rewards.get(a, 0.0)), bool(terminated.get(a, True)), bool(truncated.get(a, False)), json.dumps(observations.get(a))))
                    observations = {a: o for a, o in observations.items() if not terminated.get(a) and not truncated.get(a)}
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in STEPS.split(", ")])

    return dealt(seeds).mapInPandas(run, STEPS)


def restores_exactly(make: Callable, actions: list[int], seed: int = 0) -> bool:
    """Whether an environment that is saved, run, loaded and run again gives the same steps: the probe behind an exact-restore claim."""
    env = make()
    if not hasattr(env, "save") or not hasattr(env, "load"):
        return False
    env.reset(seed=seed)
    saved = env.save()
    first = [env.step(a)[:4] for a in actions]
    env.load(saved)
    return first == [env.step(a)[:4] for a in actions]


def position(observation: Column) -> Column:
    """The first two dimensions of an observation array, (0, 0) where they are missing."""
    return F.array(*[F.coalesce(F.try_element_at(observation, F.lit(i)), F.lit(0.0)) for i in (1, 2)])


def velocity(observation: Column) -> Column:
    return F.array(*[F.coalesce(F.try_element_at(observation, F.lit(i)), F.lit(0.0)) for i in (3, 4)])


def counter_closed_form(rows: DataFrame) -> DataFrame:
    """The counter environment without a fold: rows (seed, tick, action) give each step's reward and end."""
    from pyspark.sql import Window

    w = Window.partitionBy("seed").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    value = rows.withColumn("value", F.sum(1 + F.col("action")).over(w))
    return value.filter(F.col("value") - 1 - F.col("action") < 10).withColumn("terminated", F.col("value") >= 10)


class Server:
    """A world behind an environment's five-part step; an action that isn't legal is rejected and nothing advances."""

    def __init__(self, world, agent: str):
        self.world, self.agent, self.ready = world, agent, False

    def actions(self) -> list[tuple[str, dict]]:
        return self.world.legal(self.agent)

    def reset(self, seed: int) -> dict:
        self.world.reset(seed)
        self.ready = True
        return self.state()

    def state(self) -> dict:
        if not self.ready:
            raise RuntimeError("reset comes first")
        row = self.world.state["entities"][self.agent]
        return {"tick": self.world.state["tick"], "agent_id": self.agent, "observation": [float(v) for v in row.values() if isinstance(v, (int, float)) and not isinstance(v, bool)]}

    def step(self, action: int) -> tuple[dict, float, bool, bool, dict]:
        if not self.ready:
            raise RuntimeError("reset comes first")
        legal = self.actions()
        if not 0 <= action < len(legal):
            return self.state(), 0.0, False, False, {"rejected": True}
        code, delta = self.world.receipt(self.agent, *legal[action])
        self.world.step([(self.agent, *legal[action])])
        ended = self.world.caps["population"] and self.agent not in self.world.state["alive"]
        return self.state(), delta, ended, self.world.state["tick"] >= self.world.spec["time"]["max_ticks"], {"outcome_code": code}


def external_params_hash(parameters: dict) -> str:
    """The identity of an external environment's configuration."""
    import hashlib

    return "sha256:" + hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()
