"""Queries of the ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..registry import query
from ..trajectory import CF, EP, TR, branches, episodes, transitions


@query(
    "w1_hash_chain",
    f"""WITH {TR}, l AS (SELECT *, lead(state_before_hash) OVER (PARTITION BY episode_id ORDER BY tick) AS nxt FROM tr)
SELECT episode_id, count(*) AS records, count(*) FILTER (nxt IS NOT NULL) AS links, count(*) FILTER (nxt IS NOT NULL AND nxt <> state_after_hash) AS broken, max(tick) AS last_tick
FROM l GROUP BY episode_id""",
)
def hash_chain(spark, sf_dir):
    return W.chain_links(transitions(spark, sf_dir)).groupBy("episode_id").agg(
        F.count("*").alias("records"), F.count("link_ok").alias("links"), F.count_if(~F.col("link_ok")).alias("broken"), F.max("tick").alias("last_tick")
    )


@query(
    "q0_hash_chain_horizon",
    f"""WITH {TR}, l AS (SELECT *, lead(state_before_hash) OVER w AS nxt, sum(d) OVER (PARTITION BY episode_id ORDER BY tick ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS h FROM tr WINDOW w AS (PARTITION BY episode_id ORDER BY tick))
SELECT episode_id, tick, state_before_hash, state_after_hash, CASE WHEN nxt IS NOT NULL THEN nxt = state_after_hash END AS link_ok, CAST(coalesce(h, 0) AS BIGINT) AS horizon FROM l""",
)
def hash_chain_horizon(spark, sf_dir):
    """The flagship query: does every episode form a closed chain, and what is each step's three-step outcome?"""
    rows = W.horizon(W.chain_links(transitions(spark, sf_dir)), "d")
    return rows.select("episode_id", "tick", "state_before_hash", "state_after_hash", "link_ok", "horizon")


@query(
    "w2_duplicate_ticks",
    f"""WITH {CF}, fam AS (SELECT regexp_replace(episode_id, '_cf_t[0-9]+_b[0-9]+$', '') AS episode_id, tick FROM both_rows)
SELECT episode_id, CAST(count(*) - count(DISTINCT tick) AS BIGINT) AS duplicate_ticks FROM fam GROUP BY episode_id""",
)
def duplicate_ticks(spark, sf_dir):
    from ..operators.splits import family
    from ..trajectory import with_branches

    rows = with_branches(transitions(spark, sf_dir))
    return W.duplicate_ticks(rows.select(family(F.col("episode_id")).alias("episode_id"), "tick"))


@query("w3_horizon", f"""WITH {TR} SELECT episode_id, tick, CAST(coalesce(sum(d) OVER (PARTITION BY episode_id ORDER BY tick ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS BIGINT) AS horizon FROM tr""")
def horizon(spark, sf_dir):
    return W.horizon(transitions(spark, sf_dir), "d").select("episode_id", "tick", "horizon")


@query(
    "w4_first_share",
    f"""WITH {TR}, n AS (SELECT episode_id, tick, row_number() OVER (PARTITION BY episode_id ORDER BY tick) AS i, count(*) OVER (PARTITION BY episode_id) AS n FROM tr)
SELECT episode_id, tick FROM n WHERE i <= greatest(1, ceil(0.25 * n))""",
)
def first_share(spark, sf_dir):
    return W.first_share(transitions(spark, sf_dir), 0.25).select("episode_id", "tick")


@query("w5_replay_sample", f"""WITH {TR} SELECT episode_id, tick, state_after_hash FROM tr QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY tick) <= 5""")
def replay_sample(spark, sf_dir):
    return W.first_rows(transitions(spark, sf_dir), 5).select("episode_id", "tick", "state_after_hash")


@query(
    "w6_alternatives",
    f"""WITH {CF}, f AS (SELECT * FROM cf QUALIFY row_number() OVER (PARTITION BY seed, tick, state_before_hash, action_type ORDER BY episode_id) = 1)
SELECT seed, tick, episode_id, action_type, CAST(row_number() OVER (PARTITION BY seed, tick, state_before_hash ORDER BY episode_id) AS INTEGER) AS alternative FROM f
QUALIFY row_number() OVER (PARTITION BY seed, tick, state_before_hash ORDER BY episode_id) <= 2""",
)
def alternatives(spark, sf_dir):
    return W.alternatives(branches(transitions(spark, sf_dir)), 2).select("seed", "tick", "episode_id", "action_type", "alternative")


@query(
    "w7_joint_alternatives",
    f"""WITH {CF}, p AS (SELECT *, sha256(concat('M1:s5:delta', 'i', d % 3)) AS params_hash FROM cf), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY seed, tick, state_before_hash, params_hash ORDER BY episode_id) = 1)
SELECT seed, tick, episode_id, params_hash, CAST(row_number() OVER (PARTITION BY seed, tick, state_before_hash ORDER BY episode_id) AS INTEGER) AS alternative FROM f
QUALIFY row_number() OVER (PARTITION BY seed, tick, state_before_hash ORDER BY episode_id) <= 2""",
)
def joint_alternatives(spark, sf_dir):
    from pyspark.sql import types as T

    from ..functions.canonical import encode

    rows = branches(transitions(spark, sf_dir))
    text = encode(F.create_map(F.lit("delta"), F.col("d") % 3), T.MapType(T.StringType(), T.LongType()))
    rows = rows.withColumn("params_hash", F.sha2(text.cast("binary"), 256))
    return W.alternatives(rows, 2, "params_hash").select("seed", "tick", "episode_id", "params_hash", "alternative")


@query("w8_round_robin", f"""WITH {TR} SELECT episode_id, tick, CAST((row_number() OVER (PARTITION BY episode_id ORDER BY tick) - 1) % 3 AS INTEGER) AS choice FROM tr""")
def round_robin(spark, sf_dir):
    return W.round_robin(transitions(spark, sf_dir), 3).select("episode_id", "tick", "choice")


RUNS = (
    EP
    + """, r0 AS (SELECT *, lag(branch_group_id) OVER (ORDER BY seed, episode_id) AS prev FROM ep),
r AS (SELECT *, CAST(sum(CASE WHEN branch_group_id IS NULL OR prev IS NULL OR prev <> branch_group_id THEN 1 ELSE 0 END) OVER (ORDER BY seed, episode_id) - 1 AS BIGINT) AS run FROM r0)"""
)


@query("w9_branch_runs", f"WITH {RUNS} SELECT episode_id, branch_group_id, run FROM r")
def branch_runs(spark, sf_dir):
    return W.runs(episodes(transitions(spark, sf_dir)), "branch_group_id", ["seed", "episode_id"]).select("episode_id", "branch_group_id", "run")


@query(
    "w10_ratio_split",
    f"""WITH {RUNS}, n AS (SELECT count(DISTINCT run) AS n FROM r), k AS (SELECT n, greatest(1, CAST(round_even(n * 0.8, 0) AS BIGINT)) AS t FROM n),
v AS (SELECT n, t, CASE WHEN n - t > 1 THEN greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) ELSE 0 END AS v FROM k)
SELECT episode_id, run, CASE WHEN run < t THEN 'train' WHEN run < t + v THEN 'val' ELSE 'test' END AS split FROM r, v""",
)
def ratio_split(spark, sf_dir):
    rows = W.runs(episodes(transitions(spark, sf_dir)), "branch_group_id", ["seed", "episode_id"])
    return W.ratio_split(rows, "run").select("episode_id", "run", "split")


@query(
    "w11_carried_state",
    f"""WITH {TR} SELECT episode_id, tick, last_value(CASE WHEN action_type = 'purchase' THEN energy_after END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS last_purchase_energy FROM tr""",
)
def carried_state(spark, sf_dir):
    rows = transitions(spark, sf_dir).withColumn("change", F.when(F.col("action_type") == "purchase", F.col("energy_after")))
    return W.carried(rows, "change", ["episode_id"], "last_purchase_energy").select("episode_id", "tick", "last_purchase_energy")


@query(
    "w12_agent_cursor",
    f"""WITH {TR} SELECT episode_id, tick, (['e0', 'e1', 'e2', 'e3'])[CAST(tick % 4 AS INTEGER) + 1] AS agent_id FROM tr""",
)
def agent_cursor(spark, sf_dir):
    from ..operators.predicates import pick_alive

    rows = transitions(spark, sf_dir).withColumn("alive", F.array(*map(F.lit, ("e0", "e1", "e2", "e3"))))
    return rows.select("episode_id", "tick", pick_alive(F.col("alive"), F.col("tick")).alias("agent_id"))


@query("w13_branch_schedule", f"WITH {TR} SELECT episode_id, tick, state_before_hash FROM tr WHERE tick > 0 AND tick % 10 = 0")
def branch_schedule(spark, sf_dir):
    return W.schedule(transitions(spark, sf_dir), 10).select("episode_id", "tick", "state_before_hash")


@query(
    "w14_top_prediction",
    f"""WITH {CF}, p AS (SELECT *, (event_id * 7 + length(episode_id) * 13 + d) % 101 AS pred FROM both_rows WHERE tick > 0 AND tick % 5 = 0)
SELECT seed, tick, episode_id, pred FROM p QUALIFY row_number() OVER (PARTITION BY seed, tick, state_before_hash ORDER BY pred DESC, episode_id) = 1""",
)
def top_prediction(spark, sf_dir):
    from ..operators.ranking import with_prediction
    from ..trajectory import with_branches

    rows = with_prediction(with_branches(transitions(spark, sf_dir)).filter((F.col("tick") > 0) & (F.col("tick") % 5 == 0)))
    return W.top_prediction(rows, ["seed", "tick", "state_before_hash"], "pred", "episode_id").select("seed", "tick", "episode_id", "pred")


@query(
    "st5_floored_energy",
    f"""WITH {TR}, x AS (SELECT *, CAST(d % 1000 - 500 AS BIGINT) AS delta FROM tr),
s AS (SELECT episode_id, tick, delta, CAST(1000 + sum(delta) OVER (PARTITION BY episode_id ORDER BY tick) AS BIGINT) AS s FROM x)
SELECT episode_id, tick, CAST(s - least(0, min(s) OVER (PARTITION BY episode_id ORDER BY tick)) AS BIGINT) AS energy,
       CAST(((5 + sum(delta % 3) OVER (PARTITION BY episode_id ORDER BY tick)) % 10 + 10) % 10 AS BIGINT) AS position FROM s""",
)
def toy_world(spark, sf_dir):
    """A ring world whose energy stops at zero, without a fold."""
    rows = transitions(spark, sf_dir).withColumn("delta", F.col("d") % 1000 - 500).withColumn("step", F.col("delta") % 3)
    rows = W.position(W.floored_energy(rows, "delta", 1000), "step", 10, 5)
    return rows.select("episode_id", "tick", "energy", "position")


@query(
    "ag35_cumulative_population",
    f"""WITH {TR}, b AS (SELECT episode_id, tick, CAST(action_type = 'signup' AS INTEGER) AS births, CAST(action_type = 'error' AS INTEGER) AS deaths FROM tr)
SELECT episode_id, tick, CAST(sum(births) OVER w AS BIGINT) AS cumulative_births, CAST(sum(deaths) OVER w AS BIGINT) AS cumulative_deaths FROM b WINDOW w AS (PARTITION BY episode_id ORDER BY tick)""",
)
def cumulative_population(spark, sf_dir):
    rows = transitions(spark, sf_dir).select("episode_id", "tick", (F.col("action_type") == "signup").cast("long").alias("births"), (F.col("action_type") == "error").cast("long").alias("deaths"))
    return W.cumulative(rows, ["births", "deaths"]).select("episode_id", "tick", "cumulative_births", "cumulative_deaths")


@query("w1_long_episodes", f"WITH {TR} SELECT episode_id, tick, energy_after, state_after_hash FROM tr")
def long_episodes(spark, sf_dir):
    """The same transitions where one episode may hold most rows: ranges with carried counts and sums."""
    return transitions(spark, sf_dir, long_episodes=True).select("episode_id", "tick", "energy_after", "state_after_hash")
