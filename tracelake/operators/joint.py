"""Joint actions: all agents of one tick together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("noop", "stay", "error")


def unique_agents(agents: Column) -> Column:
    return F.size(F.array_distinct(agents)) == F.size(agents)


def complete(active: Column, agents: Column) -> Column:
    """Whether every active agent is among the agents."""
    return F.size(F.array_except(active, agents)) == 0


def executed_matches(active: Column, executed: Column) -> Column:
    return F.array_sort(F.array_distinct(active)) == F.array_sort(F.array_distinct(executed))


def filled(proposals: Column, active: Column, missing: str = "noop") -> Column:
    """proposals (map<agent, action>) with an action for every active agent and for no other: missing ones noop, stay, or an error."""
    if missing not in MISSING:
        raise ValueError(f"missing is one of {MISSING}, not {missing!r}")
    lacking = F.raise_error(F.lit("an active agent has no proposal")).cast("string") if missing == "error" else F.lit(missing)
    actions = F.transform(active, lambda a: F.coalesce(F.try_element_at(proposals, a), lacking))
    return F.map_from_arrays(active, actions)


def legal_or(proposals: Column, legal: Column, substitute: str = "noop") -> Column:
    """proposals with illegal actions (not in the agent's list of a map<agent, array>) replaced."""
    return F.transform_values(proposals, lambda agent, action: F.when(F.coalesce(F.array_contains(F.try_element_at(legal, agent), action), F.lit(False)), action).otherwise(substitute))
