"""Projections and predicates over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The closed list of outcome codes (fixed values).
OUTCOME_CODES = (
    "ok",
    "disabled_by_ablation",
    "feature_disabled",
    "unrecognized_intent",
    "illegal_target",
    "illegal_action",
    "insufficient_energy",
    "unknown_failure",
)


def first_agent(executed: Column) -> Column:
    """The first executed agent in text order, null if none."""
    return F.array_min(F.map_keys(executed))


def receipt_of(receipts: Column, agent: Column) -> Column:
    return F.try_element_at(receipts, agent)


def edge_change_count(changes: Column) -> Column:
    return F.coalesce(F.size(changes), F.lit(0))


def candidate_rank(candidates: Column, agent: Column) -> Column:
    """1-based place of the agent among the candidates in text order; 0 with one candidate or none, or if it is missing."""
    n = F.coalesce(F.size(candidates), F.lit(0))
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(F.coalesce(F.array_position(F.array_sort(F.map_keys(candidates)), agent), F.lit(0)))


def energy_updates(changes: Column, agent: Column) -> Column:
    """Energy differences of the agent's update changes, in order."""
    own = F.filter(changes, lambda c: (c["entity_id"] == agent) & (c["column"] == "energy") & (c["kind"] == "update"))
    return F.transform(own, lambda c: c["after"] - c["before"])


def first_energy_change(changes: Column, agent: Column) -> Column:
    """The first matching update, 0 if none (ranking)."""
    return F.coalesce(F.try_element_at(energy_updates(changes, agent), F.lit(1)), F.lit(0.0))


def total_energy_change(changes: Column, agent: Column) -> Column:
    """All matching updates (utility)."""
    return F.coalesce(F.aggregate(energy_updates(changes, agent), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def pick_alive(alive: Column, cursor: Column) -> Column:
    """The alive agent that a round-robin cursor points at, null if none is alive."""
    at = (F.pmod(cursor, F.size(alive)) + 1).cast("int")
    return F.when(F.size(alive) > 0, F.element_at(alive, at))


def is_counterfactual(policy: Column, episode: Column) -> Column:
    from .splits import is_branch

    return (policy == "counterfactual_branch") | is_branch(episode)


#: Rows of a list of definitions at most.
DEFINITIONS = 10_000


def small(definitions: DataFrame, most: int = DEFINITIONS) -> DataFrame:
    """A list of definitions, to be broadcast; its rows are counted first, and a longer list is refused."""
    if definitions.limit(most + 1).count() > most:
        raise ValueError(f"a list of definitions has {most} rows at most")
    return F.broadcast(definitions)


def receipts_for(proposals: DataFrame, actions: DataFrame, closed: bool = True) -> DataFrame:
    """Outcome of each proposal: unknown actions of a closed space are unrecognized, unmet preconditions illegal, else ok at the action's cost.

    actions: action_type, cost, one row each; proposals have action_type and legal (their preconditions hold).
    """
    known = proposals.join(small(actions.select("action_type", F.col("cost").alias("__cost"))), "action_type", "left")
    missing = F.col("__cost").isNull()
    code = F.when(missing, "unrecognized_intent" if closed else "ok").when(~F.col("legal"), "illegal_action").otherwise("ok")
    known = known.withColumn("outcome_code", code).withColumn("success", F.col("outcome_code") == "ok")
    return known.withColumn("energy_delta", F.when(F.col("success") & ~missing, -F.col("__cost")).otherwise(F.lit(0.0))).drop("__cost")


def legal_actions(agents: DataFrame, actions: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Every action of the (small, fixed) definition list that an agent's row allows; conditions by the name of a precondition."""
    defs = small(actions)
    kind = F.lit(None).cast("boolean")
    for name, holds in conditions.items():
        kind = F.when(F.col("precondition") == name, holds).otherwise(kind)
    rows = agents.join(defs, F.lit(True), "inner")
    return rows.filter(F.coalesce(kind, F.lit(True)))


def energy_above(energy: Column, threshold: Column) -> Column:
    return F.coalesce(energy >= threshold, F.lit(False))


def has_edge(pairs: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """The (src, dst) pairs that an edge joins."""
    both = edges.select("src", "dst")
    if not directed:
        both = both.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.join(both.distinct(), ["src", "dst"], "left_semi")


def first_neighbour(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, neighbour: the other end of the first edge (by ord) that touches the node, else the node itself."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "ord", F.lit(0).alias("side"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "ord", F.lit(1).alias("side")))
    first = ends.groupBy("node").agg(F.min_by("neighbour", F.struct("ord", "side")).alias("neighbour"))
    return nodes.join(first, "node", "left").withColumn("neighbour", F.coalesce("neighbour", "node"))


def external_action(text: Column, n: int) -> Column:
    """The integer action of a text if it is one of 0 to n - 1, else null."""
    number = text.try_cast("int")
    return F.when((number >= 0) & (number < n), number)


def public_view(rows: DataFrame, public: Sequence[str], keys: Sequence[str] = ("episode_id", "tick")) -> DataFrame:
    """For each focal agent the others' public columns, ordered by agent; rows: keys, agent_id and attributes."""
    own = rows.select(*keys, F.col("agent_id").alias("focal"), F.struct(*[c for c in rows.columns if c not in (*keys, "agent_id")]).alias("own"))
    seen = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("agent_id", *public))).alias("all"))
    return own.join(seen, list(keys)).withColumn("others", F.filter("all", lambda x: x["agent_id"] != F.col("focal"))).drop("all")


def action_histogram(rows: DataFrame) -> DataFrame:
    """How often each action type is among an agent's legal actions."""
    return rows.withColumn("type_count", F.count("*").over(Window.partitionBy("episode_id", "tick", "agent_id", "action_type")))
