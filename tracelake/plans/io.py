"""Queries of sources and sinks as round trips, external environments, samples and simulated invariants."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import checkpoints as CP
from ..operators import features as X
from ..operators import loader
from ..operators import predicates as P
from ..operators import quality as Q
from ..operators import records as R
from ..operators import simulate as SIM
from ..operators.baselines import MeanDelta
from ..registry import query, table
from ..scratch import scratch
from ..sources import adapters as A
from ..sources import environments as ENV
from ..sources import files, scenarios, sinks, spec, spec_rules
from ..trajectory import EP, TR, episodes, split_of, transitions
from .engine import _seeds, flawed, q6_full
from .more import STEPS, _steps
from .tables import _low

RANK = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"


def _splits(spark, sf_dir):
    return episodes(transitions(spark, sf_dir)).select("episode_id", split_of(F.col("seed")).alias("split"))


# -- sources and sinks ------------------------------------------------------
@query("sc2_tolerant_scan", f"WITH {TR} SELECT episode_id, tick FROM tr WHERE event_id % 13 <> 3")
def tolerant_scan(spark, sf_dir):
    """Records as JSON lines, of which some are broken or followed by blank ones."""
    rows = transitions(spark, sf_dir)
    text = F.to_json(F.struct(F.col("tick"), F.struct("episode_id").alias("provenance")))
    lines = rows.select(F.when(F.col("event_id") % 13 == 3, F.concat(F.lit("{"), text)).when(F.col("event_id") % 13 == 5, F.concat(text, F.lit("\n\n"))).otherwise(text).alias("value"))
    path = scratch(spark, "lines")
    lines.write.text(path)
    return files.json_lines(spark, path).select(F.col("provenance.episode_id").alias("episode_id"), "tick")


@query("sc5_splits", f"WITH {EP} SELECT episode_id, split FROM ep")
def splits(spark, sf_dir):
    """sk7 as well: the split of every episode, written as JSON objects and read back."""
    path = scratch(spark, "splits")
    sinks.write_splits(_splits(spark, sf_dir), path, 40)
    return files.splits(spark, path)


@query("sc6_manifest_totals", f"WITH {TR} SELECT count(*) FILTER (event_id % 89 <> 5) AS record_count, count(*) FILTER (event_id % 89 = 5) AS quarantine_count FROM tr")
def manifest_totals(spark, sf_dir):
    bad = F.col("event_id") % 89 == 5
    path = scratch(spark, "manifests")
    transitions(spark, sf_dir).groupBy("episode_id").agg(F.count_if(~bad).alias("record_count"), F.count_if(bad).alias("quarantine_count")).write.json(path)
    return files.manifest_totals(spark, path, lines=True)


@query(
    "sk1_recorder",
    f"""WITH {EP} SELECT 'records' AS place, split AS what, count(*) AS n FROM tr JOIN ep USING (episode_id) WHERE event_id % 89 <> 5 GROUP BY split
UNION ALL SELECT '_quarantine', 'validation_failed: outcome_codes', count(*) FROM tr WHERE event_id % 89 = 5 HAVING count(*) > 0""",
)
def recorder(spark, sf_dir):
    """Valid records by split, the others with their reason, appended in two batches and read back."""
    rows = flawed(transitions(spark, sf_dir)).withColumn("split", split_of(F.col("provenance.seed").cast("long")))
    path = scratch(spark, "records")
    for batch in (0, 1):
        sinks.write_records(rows.filter(F.col("tick") % 2 == batch), path)
    good = spark.read.parquet(f"{path}/records").groupBy(F.lit("records").alias("place"), F.col("split").alias("what"))
    bad = spark.read.parquet(f"{path}/_quarantine").groupBy(F.lit("_quarantine").alias("place"), F.col("reason").alias("what"))
    return good.agg(F.count("*").alias("n")).unionByName(bad.agg(F.count("*").alias("n")))


@query("sk3_manifest_file", f"WITH {TR} SELECT episode_id, count(*) AS record_count, min(tick) AS first_tick, max(tick) AS last_tick, arg_min(state_before_hash, tick) AS first_hash, arg_max(state_after_hash, tick) AS last_hash FROM tr GROUP BY episode_id")
def manifest_file(spark, sf_dir):
    path = scratch(spark, "manifest")
    sinks.write_manifests(transitions(spark, sf_dir), path)
    return spark.read.json(path)


@query("sk5_split_copy", f"WITH {EP} SELECT split, count(DISTINCT episode_id) AS episode_count, count(*) AS record_count, min(tick) AS first_tick, max(tick) AS last_tick FROM tr JOIN ep USING (episode_id) GROUP BY split")
def split_copy(spark, sf_dir):
    """Records copied by split, and the manifest of each copy."""
    path = scratch(spark, "split-copy")
    transitions(spark, sf_dir).withColumn("split", split_of(F.col("seed"))).write.partitionBy("split").parquet(path)
    return sinks.split_manifest(spark.read.parquet(path))


@query("sk12_report", f"WITH {TR} SELECT 'Q0' AS key, 'Schema' AS name, CASE WHEN count(*) FILTER (event_id % 89 = 5) > 0 THEN 'fail' ELSE 'pass' END AS status, concat(count(*) FILTER (event_id % 89 <> 5), '/', count(*), ' records schema-valid') AS evidence FROM tr UNION ALL SELECT 'Q6', 'Coverage', 'pass', '0 keys with fewer counts in the report than in the data'")
def report(spark, sf_dir):
    path = scratch(spark, "report")
    sinks.write_report(Q.report(Q.q0_schema(flawed(transitions(spark, sf_dir))), q6_full(spark, sf_dir)), path)
    return spark.read.json(path)


@query("j19_line_provenance", f"WITH {EP} SELECT episode_id, tick, row_number() OVER (ORDER BY {RANK}, episode_id, tick) AS line FROM tr JOIN ep USING (episode_id)")
def line_provenance(spark, sf_dir):
    """The line of every record in the sorted JSON lines: its file's lines before it, and its place there."""
    rows = R.records(transitions(spark, sf_dir)).withColumn("split", split_of(F.col("provenance.seed").cast("long")))
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(rows, path)
    found = files.numbered_lines(spark, path).select(F.col("provenance.episode_id").alias("episode_id"), "tick", "source_file", "source_line")
    sizes = sorted((r.source_file, r.n) for r in found.groupBy("source_file").agg(F.count("*").alias("n")).collect())  # as many as shuffle partitions
    before = spark.createDataFrame([(name, sum(n for _, n in sizes[:i])) for i, (name, _) in enumerate(sizes)], "source_file string, before long")
    return found.join(before, "source_file").select("episode_id", "tick", (F.col("before") + F.col("source_line")).alias("line"))


# -- environments -----------------------------------------------------------
def _act(seed, n, agent, seen):
    return (seed * 7 + n * 3 + (agent == "b")) % 2


def _counted(act: str, end: int) -> str:
    """Steps of the tick counter up to its end, in SQL."""
    return f"SELECT seed, n, {act} AS action, sum(1 + {act}) OVER (PARTITION BY seed ORDER BY n) AS v, {end} AS ending FROM (SELECT DISTINCT seed, unnest(range(12)) AS n FROM tr)"


COUNTED = f"{TR}, a AS ({_counted('CAST(seed * 7 + n * 3 AS BIGINT) % 2', 10)}), b AS ({_counted('CAST(seed * 7 + n * 3 + 1 AS BIGINT) % 2', 6)})"


@query("sc10_single_environment", f"WITH {COUNTED} SELECT seed, n AS tick, action, CAST(v AS DOUBLE) AS reward, v >= ending AS terminated, 'ok' AS outcome_code FROM a WHERE v - 1 - action < ending")
def single_environment(spark, sf_dir):
    found = A.run(_seeds(spark, sf_dir), lambda: A.Single(ENV.Counter()), _act)
    return found.select("seed", "tick", "action", "reward", "terminated", "outcome_code")


@query("sc12_client_environment", f"WITH {COUNTED} SELECT seed, v - 1 - action AS tick, action, CAST(v AS DOUBLE) AS reward, v < ending AS alive FROM a WHERE v - 1 - action < ending")
def client_environment(spark, sf_dir):
    """The remote counter's own tick is the state's."""
    found = A.run(_seeds(spark, sf_dir), lambda: A.Client(A.CounterClient()), _act)
    return found.select("seed", "tick", "action", "reward", "alive")


@query(
    "sc11_parallel_environment",
    f"""WITH {COUNTED}, u AS (SELECT 'a' AS agent_id, * FROM a WHERE v - 1 - action < ending UNION ALL SELECT 'b', * FROM b WHERE v - 1 - action < ending)
SELECT seed, n AS tick, agent_id, action, CAST(v AS DOUBLE) AS reward, v >= ending AS terminated, v < ending AS alive,
concat('{{', string_agg(concat('"', agent_id, '": ', CAST(v AS DOUBLE)), ', ' ORDER BY agent_id) OVER w, '}}') AS rewards_by_agent, concat('{{', string_agg(concat('"', agent_id, '": ', v >= ending), ', ' ORDER BY agent_id) OVER w, '}}') AS terminations_by_agent
FROM u WINDOW w AS (PARTITION BY seed, n)""",
)
def parallel_environment(spark, sf_dir):
    """st25 as well: one step of all agents, and its maps by agent."""
    found = A.run(_seeds(spark, sf_dir), lambda: A.Parallel(A.Counters({"a": 10, "b": 6})), _act)
    return found.select("seed", "tick", "agent_id", "action", "reward", "terminated", "alive", "rewards_by_agent", "terminations_by_agent")


@query("st26_alive", f"WITH {STEPS} SELECT tr.episode_id, tick, event_id % 3 <> 0 AND g.agents[1] <> agent_id AS alive FROM tr JOIN g ON g.episode_id = tr.episode_id AND g.step = tick // 4")
def alive(spark, sf_dir):
    """Agents that are still active: here all of a step but its first."""
    rows = transitions(spark, sf_dir).withColumn("step", F.floor(F.col("tick") / 4))
    steps = _steps(spark, sf_dir).select("episode_id", "step", F.array_sort("agents").alias("agents"))
    kind = F.when(F.col("event_id") % 3 == 0, "landmark").otherwise("agent")
    rows = rows.join(steps, ["episode_id", "step"])
    return rows.select("episode_id", "tick", A.alive(kind, F.col("agent_id"), F.slice("agents", 2, 9)).alias("alive"))


# -- samples and features ---------------------------------------------------
@query(
    "dp24_samples",
    f"""WITH {EP}, s AS (SELECT tr.*, split FROM tr JOIN ep USING (episode_id) WHERE seed_ok) SELECT episode_id, tick, split, action_type, d AS cents, CAST(coalesce(sum(d) OVER (PARTITION BY episode_id ORDER BY tick ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS BIGINT) AS horizon_cents, CASE WHEN event_id % 3 <> 0 THEN d ELSE 0 END AS outcome FROM s""".replace(
        "WHERE seed_ok", "WHERE ep.seed % 7 <> 3"
    ),
)
def loaded_samples(spark, sf_dir):
    """Records of declared episodes with their split, targets, horizon and outcome."""
    rows = transitions(spark, sf_dir)
    known = episodes(rows).filter("seed % 7 <> 3").select("episode_id", split_of(F.col("seed")).alias("split"))
    outcomes = rows.filter("event_id % 3 <> 0").select("episode_id", "tick", F.col("d").alias("outcome"))
    found = loader.load(R.records(rows), known, outcomes)
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return found.select("episode_id", "tick", "split", "action_type", cents("energy_delta").alias("cents"), cents("horizon").alias("horizon_cents"), F.col("outcome").cast("long").alias("outcome"))


@query(
    "dp23_mean_delta",
    f"""WITH {EP}, s AS (SELECT tr.*, split FROM tr JOIN ep USING (episode_id)), k AS (SELECT action_type, agent_id, avg(d) AS m FROM s WHERE split = 'train' AND action_type <> 'signup' GROUP BY ALL), g AS (SELECT coalesce(avg(d), 0) AS m FROM s WHERE split = 'train' AND action_type <> 'signup')
SELECT episode_id, tick, coalesce(k.m, g.m) AS prediction FROM s LEFT JOIN k USING (action_type, agent_id), g WHERE split <> 'train'""",
)
def mean_delta(spark, sf_dir):
    """j15 as well: training means by action and agent, the overall mean for what training lacks."""
    rows = transitions(spark, sf_dir).withColumn("split", split_of(F.col("seed")))
    model = MeanDelta(["action_type", "agent_id"], ["d"]).fit(rows.filter("split = 'train' and action_type <> 'signup'"))
    return model.predict(rows.filter("split <> 'train'")).select("episode_id", "tick", F.col("pred_d").alias("prediction"))


@query("dp26_feature_matrix", f"WITH {TR} SELECT episode_id, tick, CAST(tick AS DOUBLE) AS x_tick, CAST(CASE action_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS BIGINT) AS action, CAST(substr(agent_id, 2) AS BIGINT) AS agent, CAST(d AS DOUBLE) AS param, CAST(11 AS BIGINT) AS width FROM tr")
def feature_matrix(spark, sf_dir):
    """The layout of tick, one-hot action and agent, and three parameter columns, read back by its parts."""
    layout, rows = X.legacy_layout(3, 4), transitions(spark, sf_dir)
    actions = F.array(*map(F.lit, ("click", "purchase", "view")))
    v = X.vector(F.array(F.col("tick").cast("double")), X.one_hot(F.array_position(actions, F.col("action_type")) - 1, 3), X.one_hot(F.substring("agent_id", 2, 9).cast("long"), 4), F.array(F.col("d").cast("double"), F.lit(0.0), F.lit(0.0)))
    rows = rows.withColumn("v", v)
    cut = lambda name: layout.cut(F.col("v"), name)
    return rows.select("episode_id", "tick", cut("tick")[0].alias("x_tick"), X.arg_max(cut("action")).alias("action"), X.arg_max(cut("agent")).alias("agent"), cut("param")[0].alias("param"), F.size("v").cast("long").alias("width"))


@query("f26_exogenous", f"WITH {TR} SELECT episode_id, tick, CAST({_low('action_type', 8)} AS DOUBLE) AS kind, d / 100.0 AS rate FROM tr")
def exogenous(spark, sf_dir):
    x = X.exogenous_block(F.create_map(F.lit("rate"), (F.col("d") / 100.0).cast("string"), F.lit("kind"), F.col("action_type")), 8)
    return transitions(spark, sf_dir).withColumn("x", x).select("episode_id", "tick", F.element_at("x", 1).alias("kind"), F.element_at("x", 2).alias("rate"))


@query("f18_selected_keys", f"WITH {STEPS} SELECT episode_id, step, array_to_string(list_filter(['e3', 'e1', 'e7'], lambda x: list_contains(agents, x)), ',') AS keys FROM g")
def selected_keys(spark, sf_dir):
    return _steps(spark, sf_dir).select("episode_id", "step", F.array_join(V.selected(F.col("agents"), F.lit("e3, e1 ,e7")), ",").alias("keys"))


@query("pf17_pick_alive", f"WITH {STEPS} SELECT episode_id, step, agents[step % len(agents) + 1] AS agent FROM g")
def pick_alive(spark, sf_dir):
    return _steps(spark, sf_dir).select("episode_id", "step", P.pick_alive(F.array_sort("agents"), F.col("step")).alias("agent"))


# -- specifications ---------------------------------------------------------
#: Orders as specifications and their lines as effects, to run the meaning rules over many of them at once.
SPECS = {
    "worlds": "SELECT CAST(o_orderkey AS VARCHAR) AS spec, CAST(o_orderkey % 9 AS DOUBLE) AS max_ticks, CAST(o_custkey % 2 AS INTEGER) AS fixed_course, CAST(o_custkey % 3 AS INTEGER) AS seeded, CASE WHEN o_custkey % 4 = 0 THEN 'graph' ELSE 'discrete' END AS space, CAST(o_custkey % 2 AS INTEGER) AS has_registries, CAST(o_orderkey % 5 AS INTEGER) AS stop_count FROM orders",
    "names": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS spec, CASE WHEN l_linenumber % 2 = 0 THEN 'column' ELSE 'registry' END AS kind, l_linestatus AS name FROM lineitem",
    "effects": "SELECT CAST(l_orderkey AS VARCHAR) AS spec, CAST(l_linenumber AS VARCHAR) AS place, 'A' AS action, CASE l_partkey % 6 WHEN 0 THEN 'entity' WHEN 1 THEN 'field' WHEN 2 THEN 'relation' WHEN 3 THEN 'meta' WHEN 4 THEN NULL ELSE 'L5' END AS target, CASE l_suppkey % 5 WHEN 0 THEN 'reward' WHEN 1 THEN 'meta.tick' WHEN 2 THEN l_linestatus WHEN 3 THEN 'energy' ELSE NULL END AS field, CASE l_returnflag WHEN 'R' THEN 'sub' WHEN 'A' THEN 'remove' ELSE NULL END AS op, CASE WHEN l_linenumber % 2 = 0 THEN '$next.energy' ELSE '1' END AS value FROM lineitem",
    "needs": "SELECT CAST(l_orderkey AS VARCHAR) AS spec, CAST(l_linenumber AS VARCHAR) AS place, CASE WHEN l_partkey % 2 = 0 THEN 'registry_unowned' ELSE 'energy_above' END AS kind, CASE WHEN l_suppkey % 3 = 0 THEN concat('$', l_linestatus) ELSE l_linestatus END AS registry FROM lineitem",
    "stops": "SELECT CAST(l_orderkey AS VARCHAR) AS spec, CAST(l_linenumber AS VARCHAR) AS place, CASE l_partkey % 3 WHEN 0 THEN 'threshold' WHEN 1 THEN 'custom' ELSE 'no_alive' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'x' END AS field, CASE WHEN l_suppkey % 3 = 0 THEN '>' END AS op, CASE WHEN l_suppkey % 5 = 0 THEN '1' END AS value, CASE WHEN l_suppkey % 4 = 0 THEN 'p' END AS predicate FROM lineitem",
}

_OWN = {t: f"t_{t}" for t in SPECS}
_FOUND = " UNION ALL ".join(f"SELECT '{r.check_id}' AS check_id, '{r.severity}' AS severity, '{r.message.replace(chr(39), chr(39) * 2)}' AS message, spec FROM ({r.found.format(**_OWN)})" for r in spec_rules.RULES)


@query("dp28_specs_at_once", f"WITH {', '.join(f't_{t} AS ({q})' for t, q in SPECS.items())}, f AS ({_FOUND}) SELECT check_id, severity, message, count(*) AS n, count(DISTINCT spec) AS specs FROM f GROUP BY ALL")
def specs_at_once(spark, sf_dir):
    """Every rule over as many specifications as there are orders."""
    for name in ("orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"spec_source_{name}")
    named = lambda q: q.replace("FROM orders", "FROM spec_source_orders").replace("FROM lineitem", "FROM spec_source_lineitem").replace("AS VARCHAR", "AS STRING")
    found = spec_rules.check_tables(spark, {t: spark.sql(named(q)) for t, q in SPECS.items()})
    said = F.when(F.contains("message", F.lit(": ")), F.substring_index("message", ": ", 1)).otherwise(F.col("message"))
    return found.groupBy("check_id", "severity", said.alias("message")).agg(F.count("*").alias("n"), F.count_distinct("spec").alias("specs"))


# -- simulated invariants ---------------------------------------------------
SEEDS = "s AS (SELECT DISTINCT user_id AS seed FROM events)"


def _relief():
    return spec.compile_spec(scenarios.RELIEF)


@query("st17_replays_identically", f"WITH {SEEDS} SELECT concat('seed', seed, '_run0') AS episode_id, CAST(tick AS BIGINT) AS tick, tick <> 3 AS ok FROM s, (SELECT unnest(range(4)) AS tick)")
def replays_identically(spark, sf_dir):
    """The first steps again: equal hashes, but where one was forged."""
    rows = SIM.rollout(spark, _relief(), _seeds(spark, sf_dir), 5)
    rows = rows.withColumn("state_after_hash", F.when(F.col("tick") == 3, "sha256:forged").otherwise(F.col("state_after_hash")))
    return SIM.replay(rows, _relief(), 4).select("episode_id", "tick", "ok")


@query("st22_chain", f"WITH {SEEDS} SELECT concat('seed', seed, '_run0') AS episode_id, CAST(tick AS BIGINT) AS tick, CASE tick WHEN 0 THEN NULL WHEN 4 THEN false ELSE true END AS link_ok FROM s, (SELECT unnest(range(6)) AS tick)")
def simulated_chain(spark, sf_dir):
    """Simulated episodes are closed chains, but where a record was altered."""
    from pyspark.sql import Window

    w = Window.partitionBy("episode_id").orderBy("tick")
    rows = SIM.rollout(spark, _relief(), _seeds(spark, sf_dir), 6)
    rows = rows.withColumn("state_after_hash", F.when(F.col("tick") == 3, "sha256:forged").otherwise(F.col("state_after_hash")))
    return rows.select("episode_id", "tick", (F.lag("state_after_hash").over(w) == F.col("state_before_hash")).alias("link_ok"))


@query("st18_branches_held_fixed", f"WITH {SEEDS} SELECT seed, CAST(5 AS BIGINT) AS fork_tick, seed % 2 = 1 AS held_fixed FROM s")
def branches_held_fixed(spark, sf_dir):
    """Branches start from their parent's state with its event and generators; a parent of another state is told apart."""
    rows = SIM.rollout(spark, _relief(), _seeds(spark, sf_dir), 6)
    found = SIM.branch(rows, _relief())
    other = F.when(F.col("seed") % 2 == 0, "sha256:other").otherwise(F.col("state_before_hash"))
    parent = rows.select("seed", F.col("tick").alias("fork_tick"), other.alias("hash"), F.col("exogenous").alias("event"), F.col("action_type").alias("done"))
    same = (F.col("state_before_hash") == F.col("hash")) & F.col("exogenous").eqNullSafe(F.col("event")) & (F.col("action_type") != F.col("done")) & F.col("error").isNull()
    per = found.join(parent, ["seed", "fork_tick"]).groupBy("seed", "fork_tick")
    return per.agg((F.every(same) & (F.count_distinct("fingerprint_before") == 1) & (F.count_distinct("action_type") == F.count("*"))).alias("held_fixed"))


@query("st28_matched", f"WITH {SEEDS} SELECT seed, CAST(tick AS BIGINT) AS tick, policy_id, true AS matched, true AS delta_ok FROM s, (SELECT unnest(range(3)) AS tick), (SELECT unnest(['adversarial', 'random']) AS policy_id)")
def matched(spark, sf_dir):
    """Policies compared from one state, event and agent."""
    from ..operators import policies as PO

    found = SIM.matched_utilities(spark, _relief(), _seeds(spark, sf_dir), {k: PO.BUILT_IN[k] for k in ("scripted", "adversarial", "random")}, "scripted", 3)
    delta = F.abs(F.col("delta") - (F.col("candidate_utility") - F.col("baseline_utility"))) < 1e-9
    return SIM.compare_policies(found, "scripted").select("seed", "tick", "policy_id", "matched", delta.alias("delta_ok"))


@query("st16_checkpoints", f"WITH {SEEDS} SELECT concat('seed', seed, '_run0') AS episode_id, CAST(tick AS BIGINT) AS tick, tick <> 2 AS ok, CASE WHEN tick = 2 THEN 'the checksum does not fit' ELSE '' END AS message FROM s, (SELECT unnest([0, 2, 4]) AS tick)")
def checkpoints(spark, sf_dir):
    """Checkpoints that restore exactly, and ones with an altered payload that are refused."""
    rows = CP.checkpoints(SIM.rollout(spark, _relief(), _seeds(spark, sf_dir), 5), _relief(), 2)
    text = F.col("payload").cast("string")
    altered = F.when(F.col("tick") == 2, F.replace(text, F.lit('"births": 0'), F.lit('"births": 7'))).otherwise(text)
    return CP.restored(rows.withColumn("payload", altered.cast("binary")), _relief())


@query("sc8_schema_document", "SELECT * FROM (VALUES ('actions', true), ('data', false), ('entities', true), ('exogenous', false), ('fields', false), ('registries', false), ('relations', false), ('scenario', true), ('space', true), ('termination', true), ('time', true)) t(section, required)")
def schema_document(spark, sf_dir):
    """The sections of the packaged schema document."""
    found = spec.packaged_schema()
    rows = [(name, name in found["required"]) for name in json.loads(json.dumps(found["properties"]))]
    return spark.createDataFrame(rows, "section string, required boolean")
