"""Simulated episodes whose course SQL can compute: hash-based draws, the first legal action, and constant costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical as C
from ..operators import joint as JT
from ..operators import policies as PO
from ..operators import predicates as P
from ..operators import simulate as SIM
from ..registry import query, table
from ..sources import scenarios, spec
from ..trajectory import TR, transitions
from .engine import _seeds

FIRST = {"scripted": PO.scripted()}


def _draw(stream: str, n: str) -> str:
    """The n-th draw of a stream of hash-based numbers, in SQL."""
    return f"((CAST(concat('0x', substr(sha256(concat(seed, '|{stream}|', {n})), 1, 16)) AS UBIGINT) // 2048) / 9007199254740992.0)"


_NEXT = "CASE {0} WHEN 'depot' THEN 'north' WHEN 'north' THEN 'depot' WHEN 'bridge' THEN 'north' ELSE 'bridge' END"

#: Agents as they are spawned, the event of every tick, and where an agent's first, second and later walks lead.
START = f"""s AS (SELECT DISTINCT user_id AS seed FROM events),
e AS (SELECT seed, i, 3.0 + 3.0 * {_draw("world", "2 * i")} AS energy, ['depot', 'north', 'south', 'bridge'][CAST(floor({_draw("world", "2 * i + 1")} * 4) AS BIGINT) + 1] AS node FROM s, (SELECT unnest(range(3)) AS i)),
x AS (SELECT seed, t, CASE WHEN {_draw("exogenous", "2 * t")} < 0.3 THEN 'hazard_escalation' WHEN {_draw("exogenous", "2 * t + 1")} < 0.1 THEN 'resource_spawn' END AS event FROM s, (SELECT unnest(range(6)) AS t)),
w AS (SELECT seed, i, 0 AS k, {_NEXT.format("node")} AS target FROM e UNION ALL SELECT seed, i, 1, {_NEXT.format(_NEXT.format("node"))} FROM e UNION ALL SELECT seed, i, 2, {_NEXT.format(_NEXT.format(_NEXT.format("node")))} FROM e UNION ALL SELECT seed, i, 3, {_NEXT.format(_NEXT.format(_NEXT.format(_NEXT.format("node"))))} FROM e)"""


def _relief():
    return spec.compile_spec(scenarios.RELIEF)


def _first(spark, sf_dir, ticks):
    return SIM.rollout(spark, _relief(), _seeds(spark, sf_dir), ticks, FIRST)


def _told(rows, *more):
    near = lambda c: F.round(c, 9).alias(c)
    return rows.select("seed", "tick", "agent_id", "action_type", F.get_json_object("params", "$.target_node").alias("target"), "outcome_code", near("receipt_delta"), near("realized_delta"), F.get_json_object("exogenous", "$.kind").alias("event"), *more)


@query("sc13_spawned", f"WITH {START} SELECT seed, concat('e', i) AS entity_id, energy, node, 0.0::DOUBLE AS cargo, true AS alive FROM e")
def spawned(spark, sf_dir):
    return SIM.spawned(_seeds(spark, sf_dir), _relief())


@query("st3_exogenous", f"WITH {START} SELECT seed, CAST(t AS BIGINT) AS tick, event FROM x")
def exogenous(spark, sf_dir):
    """One draw for each event and tick, the first that hits."""
    return _first(spark, sf_dir, 6).select("seed", "tick", F.get_json_object("exogenous", "$.kind").alias("event"))


@query(
    "st22_first_action",
    f"""WITH {START} SELECT x.seed, CAST(t AS BIGINT) AS tick, concat('e', t % 3) AS agent_id, 'WALK' AS action_type, target, 'ok' AS outcome_code, -0.7::DOUBLE AS receipt_delta, -0.7::DOUBLE AS realized_delta, event
FROM x JOIN w ON w.seed = x.seed AND w.i = t % 3 AND w.k = t // 3""",
)
def first_action(spark, sf_dir):
    """A rollout in which every agent in turn takes its first legal action."""
    return _told(_first(spark, sf_dir, 6))


@query(
    "st23_first_actions",
    f"""WITH {START} SELECT x.seed, CAST(t AS BIGINT) AS tick, concat('e', i) AS agent_id, 'WALK' AS action_type, target, 'ok' AS outcome_code, -0.7::DOUBLE AS receipt_delta, -0.7::DOUBLE AS realized_delta, event
FROM x JOIN w ON w.seed = x.seed AND w.k = t WHERE t < 4""",
)
def first_actions(spark, sf_dir):
    """A joint rollout: all agents take their first legal action at each tick."""
    return _told(SIM.joint_rollout(spark, _relief(), _seeds(spark, sf_dir), 4, PO.scripted()))


@query(
    "st18_first_alternatives",
    f"""WITH {START} SELECT seed, CAST(5 AS BIGINT) AS tick, 'e2' AS agent_id, action_type, NULL::VARCHAR AS target, 'ok' AS outcome_code, cost AS receipt_delta, cost AS realized_delta, event, concat('seed', seed, '_run0_cf_t5_b', b) AS episode_id
FROM x, (VALUES ('PUMP', -1.0::DOUBLE, 0), ('CALL', -0.4::DOUBLE, 1)) v(action_type, cost, b) WHERE t = 5""",
)
def first_alternatives(spark, sf_dir):
    """At a fork of walking agents, the two other actions that are legal first."""
    return _told(SIM.branch(_first(spark, sf_dir, 6), _relief()), "episode_id")


@query("st4_event_fields", f"WITH {START} SELECT concat('seed', seed, '_run0') AS episode_id, CAST(t AS BIGINT) AS tick, round(sum(CASE event WHEN 'hazard_escalation' THEN 0.3 WHEN 'resource_spawn' THEN 0.1 ELSE 0 END) OVER (PARTITION BY seed ORDER BY t)::DOUBLE, 6) AS water_level FROM x")
def event_fields(spark, sf_dir):
    """What events do to a field, as a running sum over walking agents, who do nothing to it."""
    found = SIM.field_by_prefix(_first(spark, sf_dir, 6), _relief(), "water_level")
    return found.select("episode_id", "tick", F.round("water_level", 6).alias("water_level"))


@query("st2_effects", f"WITH {START} SELECT seed, concat('e', i) AS entity_id, round(energy - CASE WHEN i = 0 THEN 1.0 WHEN i = 1 THEN 0.4 ELSE 0.7 END, 9) AS energy, CASE WHEN i = 2 THEN {_NEXT.format('node')} ELSE node END AS node, 'e0' AS owner, -0.5::DOUBLE AS water_level, 5 AS edges FROM e")
def effects(spark, sf_dir):
    """One step of three agents who pump, call and walk: entity, registry, field and relation effects."""
    return SIM.after_step(_seeds(spark, sf_dir), _relief(), [("e0", "PUMP", {"entry_id": "pump1"}), ("e1", "CALL", {"target_agent": "e2"}), ("e2", "WALK", None)])


# -- more functions ---------------------------------------------------------
@query("f1_canonical", f"WITH {TR} SELECT episode_id, tick, concat('(3:i', seed, 'i', tick, 'i', d) AS code, concat('s', octet_length(encode(action_type)), ':', action_type) AS text FROM tr")
def canonical(spark, sf_dir):
    text = F.concat(F.lit("s"), C.sized(F.col("action_type")))
    return transitions(spark, sf_dir).select("episode_id", "tick", C.int_tuple(F.col("seed"), F.col("tick"), F.col("d")).alias("code"), text.alias("text"))


@query("f21_math", f"WITH {TR} SELECT episode_id, tick, greatest(-1.0, least(1.0, d / 10000.0 - 2)) AS clipped, round(log2(tick + 1), 9) AS log, CAST(ceil(d / 100.0) AS BIGINT) AS up, abs(d - 20000) AS size FROM tr")
def math(spark, sf_dir):
    d = F.col("d")
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d / F.lit(10000.0) - 2)).cast("double")
    return transitions(spark, sf_dir).select("episode_id", "tick", clipped.alias("clipped"), F.round(F.log2(F.col("tick") + 1), 9).alias("log"), F.ceil(d / F.lit(100.0)).alias("up"), F.abs(d - 20000).alias("size"))


@query("so6_duplicate_agents", f"WITH {TR}, g AS (SELECT episode_id, tick // 3 AS step, list(agent_id) AS a FROM tr GROUP BY ALL) SELECT episode_id, step, len(a) = len(list_distinct(a)) AS unique_agents FROM g")
def duplicate_agents(spark, sf_dir):
    s = transitions(spark, sf_dir).groupBy("episode_id", F.floor(F.col("tick") / 3).alias("step")).agg(F.collect_list("agent_id").alias("a"))
    return s.select("episode_id", "step", JT.unique_agents(F.col("a")).alias("unique_agents"))


@query(
    "pf12_private_columns",
    f"""WITH {TR}, s AS (SELECT episode_id, tick // 4 AS step, agent_id, max(d) AS position, min(d) AS velocity FROM tr GROUP BY ALL)
SELECT a.episode_id, a.step AS tick, a.agent_id AS focal, a.velocity AS own_velocity, coalesce(string_agg(CASE WHEN b.agent_id IS NOT NULL THEN concat(b.agent_id, ':', b.position) END, ',' ORDER BY b.agent_id), '') AS others
FROM s a LEFT JOIN s b ON a.episode_id = b.episode_id AND a.step = b.step AND a.agent_id <> b.agent_id GROUP BY ALL""",
)
def private_columns(spark, sf_dir):
    """Of the others an agent sees positions, but not velocities."""
    rows = transitions(spark, sf_dir).groupBy("episode_id", F.floor(F.col("tick") / 4).alias("tick"), "agent_id").agg(F.max("d").alias("position"), F.min("d").alias("velocity"))
    found = P.public_view(rows, ["position"])
    said = F.transform("others", lambda o: F.concat(o["agent_id"], F.lit(":"), o["position"].cast("string")))
    return found.select("episode_id", "tick", "focal", F.col("own.velocity").alias("own_velocity"), F.array_join(said, ",").alias("others"))


@query(
    "st6_state_view",
    """WITH e AS (SELECT DISTINCT l_suppkey AS node, concat('p', l_partkey) AS dst, l_returnflag AS edge_type FROM lineitem)
SELECT node, count(*) AS edges, md5(string_agg(concat(dst, '/', edge_type), ',' ORDER BY dst, edge_type)) AS listed FROM e GROUP BY node""",
)
def state_view(spark, sf_dir):
    """Each node's edges in order, as a state lists them."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("edge_type")).distinct()
    s = e.groupBy("node").agg(F.count("*").alias("edges"), F.array_sort(F.collect_list(F.struct("dst", "edge_type"))).alias("l"))
    listed = F.array_join(F.transform("l", lambda x: F.concat(x["dst"], F.lit("/"), x["edge_type"])), ",")
    return s.select("node", "edges", F.md5(listed.cast("binary")).alias("listed"))
