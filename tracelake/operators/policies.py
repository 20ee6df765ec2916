"""Policies: which of the legal actions an agent takes.

A policy gets (world, agent, legal, rng, tick) and returns an action type
and parameters, or None to decline. choose() gives the same choices as
expressions over arrays of legal actions.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Choice = tuple[str, dict] | None


def random_choice(world, agent, legal, rng, tick) -> Choice:
    return rng.choice(legal) if legal else None


def scripted(preferred: str | None = None) -> Callable:
    """The preferred action if it is legal, else the first."""

    def propose(world, agent, legal, rng, tick) -> Choice:
        return next((a for a in legal if a[0] == preferred), legal[0]) if legal else None

    return propose


def frozen_replay(actions: dict[tuple[int, str], tuple[str, dict]]) -> Callable:
    return lambda world, agent, legal, rng, tick: actions.get((tick, agent))


def adversarial(world, agent, legal, rng, tick) -> Choice:
    """The rarest action type's first action; the last action if all types are as rare."""
    if not legal:
        return None
    counts = Counter(a[0] for a in legal)
    if len(counts) == len(legal):
        return legal[-1]
    return next(a for a in legal if counts[a[0]] == min(counts.values()))


def planner(score: Callable | None = None) -> Callable:
    """The action with the highest score, by default its largest numeric parameter; the first of equals."""
    value = score or (lambda action, world: max((v for v in action[1].values() if isinstance(v, (int, float)) and not isinstance(v, bool)), default=0.0))
    return lambda world, agent, legal, rng, tick: max(legal, key=lambda a: value(a, world)) if legal else None


def from_model(complete: Callable[[str], str], retries: int = 1, fallback: str = "first") -> Callable:
    """A policy that asks a language model: a prompt of the legal actions, a JSON answer, retries, then a fallback.

    complete is injected, so that tests need no network.
    """

    def propose(world, agent, legal, rng, tick) -> Choice:
        prompt = json.dumps({"tick": tick, "agent_id": agent, "legal_actions": [{"action_type": t, "params": p} for t, p in legal]}, sort_keys=True)
        for _ in range(retries + 1):
            try:
                answer = json.loads(complete(prompt))
            except ValueError:
                continue
            if isinstance(answer, dict) and (found := next((a for a in legal if a[0] == answer.get("action_type")), None)):
                return found
        return legal[0] if fallback == "first" and legal else None

    return propose


BUILT_IN: dict[str, Callable] = {"random": random_choice, "scripted": scripted(), "adversarial": adversarial, "planner": planner()}


def choose(legal: Column, policy: str, draw: Column | None = None) -> Column:
    """The chosen element of an array of action types: first, last, rarest or random (draw: a number from 0 to 1)."""
    n = F.size(legal)
    if policy == "first":
        found = F.element_at(legal, 1)
    elif policy == "random":
        found = F.element_at(legal, (F.floor(draw * n) + 1).cast("int"))
    elif policy == "adversarial":
        counts = F.transform(legal, lambda a: F.size(F.filter(legal, lambda b: b == a)))
        rarest = F.element_at(legal, F.array_position(counts, F.array_min(counts)).cast("int"))
        found = F.when(F.array_max(counts) == 1, F.element_at(legal, -1)).otherwise(rarest)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return F.when(n > 0, found)


def by_policy(legal: Column, policy_id: Column, draw: Column) -> Column:
    """The choice of the policy that each row names."""
    out = F.lit(None).cast("string")
    for name, rule in (("random", "random"), ("scripted:first", "first"), ("adversarial", "adversarial")):
        out = F.when(policy_id == name, choose(legal, rule, draw)).otherwise(out)
    return out
