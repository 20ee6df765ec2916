"""Transition records as nested rows, and the rules that hold for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import encode, hash_of
from .predicates import OUTCOME_CODES

SCHEMA_VERSION = "0.1.0"

SLOTS = {"fields": "field_changes", "entities": "entity_changes", "relations": "relation_changes", "registries": "registry_changes", "population": "population_changes", "events": "event_log"}

_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType()
_PARAMS = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PROPOSAL = _struct(agent_id=_S, action_type=_S, params=_PARAMS, proposed_at_tick=_L, proposer=_S)
EXECUTED = _struct(agent_id=_S, action_type=_S, params=_PARAMS, executed_at_tick=_L, proposal_hash=_S)
RECEIPT = _struct(executed_action_hash=_S, outcome_code=_S, success=_B, energy_delta=_D, events=T.ArrayType(_S), diagnostics=_PARAMS)
CHANGE = _struct(kind=_S, entity_id=_S, column=_S, before=_D, after=_D)
DELTA = _struct(
    field_changes=T.ArrayType(CHANGE), entity_changes=_struct(schema_id=_S, changes=T.ArrayType(CHANGE)), relation_changes=_struct(schema_id=_S, changes=T.ArrayType(CHANGE)),
    registry_changes=_struct(schema_id=_S, changes=T.ArrayType(CHANGE)), population_changes=_struct(changes=T.ArrayType(CHANGE)), event_log=T.ArrayType(_struct(kind=_S, tick=_L)), meta_after=_struct(tick=_L),
)
CAPABILITY = _struct(fields=_B, entities=_B, relations=_B, registries=_B, population=_B, events=_B, exact_restore=_B, executable_deterministic_replay=_B, ground_truth=_B, authority=_S, transition_mode=_S)
PROVENANCE = _struct(seed=_S, policy_id=_S, policy_version=_S, inference_config=_PARAMS, episode_id=_S, execution_mode=_S)
RECORD = _struct(
    schema_version=_S, producer_id=_S, producer_version=_S, tick=_L, state_before_hash=_S, state_after_hash=_S, candidate_actions=T.MapType(_S, PROPOSAL), executed_actions=T.MapType(_S, EXECUTED),
    exogenous_input=_struct(tick=_L, kind=_S, payload=_PARAMS), receipts=T.MapType(_S, RECEIPT), state_delta=DELTA, capability_profile=CAPABILITY, provenance=PROVENANCE,
)


def proposal_hash(proposal: Column) -> Column:
    """The canonical hash of a proposal struct."""
    return hash_of(encode(proposal, PROPOSAL, "ActionProposal"))


def records(rows: DataFrame) -> DataFrame:
    """Nested records of flat transitions (as trajectory.transitions gives them): one agent, one energy update each."""
    agent = F.col("agent_id")
    params = F.create_map(F.lit("cents"), F.col("d").cast("string"))
    proposal = F.struct(agent.alias("agent_id"), F.col("action_type"), params.alias("params"), F.col("tick").alias("proposed_at_tick"), F.col("policy_id").alias("proposer")).cast(PROPOSAL)
    rows = rows.withColumn("__p", proposal)
    executed = F.struct(agent.alias("agent_id"), F.col("action_type"), params.alias("params"), F.col("tick").alias("executed_at_tick"), proposal_hash(F.col("__p")).alias("proposal_hash")).cast(EXECUTED)
    rows = rows.withColumn("__e", executed)
    ok = F.col("outcome_code") == "ok"
    receipt = F.struct(
        hash_of(encode(F.col("__e"), EXECUTED, "ExecutedAction")).alias("executed_action_hash"), F.col("outcome_code"), ok.alias("success"), (F.col("d") / 100.0).alias("energy_delta"),
        F.array().cast("array<string>").alias("events"), F.create_map().cast("map<string,string>").alias("diagnostics"),
    ).cast(RECEIPT)
    change = F.struct(F.lit("update").alias("kind"), agent.alias("entity_id"), F.lit("energy").alias("column"), (F.col("energy_before") / 100.0).alias("before"), (F.col("energy_after") / 100.0).alias("after")).cast(CHANGE)
    null = F.lit(None)
    delta = F.struct(
        null.alias("field_changes"), F.struct(F.lit("events:v1").alias("schema_id"), F.array(change).alias("changes")).alias("entity_changes"), null.alias("relation_changes"), null.alias("registry_changes"),
        null.alias("population_changes"), null.alias("event_log"), F.struct((F.col("tick") + 1).alias("tick")).alias("meta_after"),
    ).cast(DELTA)
    flags = [F.lit(v).alias(f.name) for f, v in zip(CAPABILITY.fields, (False, True, False, False, False, False, True, True, True, "rule", "deterministic"), strict=True)]
    provenance = F.struct(
        F.col("seed").cast("string").alias("seed"), F.col("policy_id"), F.lit("0.1.0").alias("policy_version"), F.create_map().cast("map<string,string>").alias("inference_config"), F.col("episode_id"), F.lit("sequential").alias("execution_mode")
    )
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("events").alias("producer_id"), F.lit("1").alias("producer_version"), F.col("tick").cast("long").alias("tick"), "state_before_hash", "state_after_hash",
        F.create_map(agent, F.col("__p")).alias("candidate_actions"), F.create_map(agent, F.col("__e")).alias("executed_actions"), F.lit(None).cast(RECORD["exogenous_input"].dataType).alias("exogenous_input"),
        F.create_map(agent, receipt).alias("receipts"), delta.alias("state_delta"), F.struct(*flags).cast(CAPABILITY).alias("capability_profile"), provenance.cast(PROVENANCE).alias("provenance"),
    )


def _text(c: str) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def schema_rules() -> dict[str, Column]:
    """The record-level rules, each true where it holds."""
    keys = lambda m: F.coalesce(F.array_sort(F.map_keys(m)), F.array().cast("array<string>"))
    receipts = F.coalesce(F.map_values("receipts"), F.array().cast(T.ArrayType(RECEIPT)))
    cap = F.col("capability_profile")
    return {
        "present": _text("state_before_hash") & _text("state_after_hash") & F.col("candidate_actions").isNotNull() & F.col("executed_actions").isNotNull() & F.col("receipts").isNotNull() & F.col("state_delta").isNotNull() & cap.isNotNull(),
        "version": F.coalesce(F.col("schema_version") == SCHEMA_VERSION, F.lit(False)),
        "receipts_complete": keys("executed_actions") == keys("receipts"),
        "outcome_codes": F.forall(receipts, lambda r: F.coalesce(r["outcome_code"].isin(*OUTCOME_CODES) & (r["success"] == (r["outcome_code"] == "ok")), F.lit(False))),
        "grounded": F.coalesce(~((cap["authority"] == "learned") & cap["ground_truth"]) & (~cap["exact_restore"] | cap["executable_deterministic_replay"]) & cap["entities"], F.lit(False)),
        "tick": F.coalesce(F.col("tick") >= 0, F.lit(False)),
        "producer": _text("producer_id") & _text("producer_version"),
    }


def valid_schema() -> Column:
    out = F.lit(True)
    for rule in schema_rules().values():
        out = out & rule
    return out


def delta_consistent() -> Column:
    """No delta for a slot that the capabilities lack."""
    out = F.lit(True)
    for slot, change in SLOTS.items():
        out = out & ~(F.coalesce(~F.col("capability_profile")[slot], F.lit(False)) & F.col("state_delta")[change].isNotNull())
    return out


def meta_tick_ok() -> Column:
    """Whether the state after is one tick on; null if the delta doesn't say."""
    return F.col("state_delta.meta_after.tick") == F.col("tick") + 1


def provenance_complete() -> Column:
    p = "provenance."
    text = [_text(p + c) for c in ("policy_id", "policy_version", "episode_id", "seed")]
    out = F.col(p + "inference_config").isNotNull()
    for t in text:
        out = out & t
    return out


def slot_triple(capable: Column, missing: Column, value: Column) -> Column:
    """A slot is null where it is unsupported or missing, and present otherwise."""
    gone = ~capable | F.coalesce(missing, F.lit(False))
    return F.when(gone, value.isNull()).otherwise(value.isNotNull())


def seed_number(seed: Column) -> Column:
    """The seed as a number, 0 if it is none."""
    return F.coalesce(seed.try_cast("long"), F.lit(0))


def samples(rows: DataFrame) -> DataFrame:
    """The flat sample of each record: first executed agent, its action, targets."""
    from .predicates import candidate_rank, edge_change_count, first_agent, first_energy_change, receipt_of, total_energy_change

    rows = rows.withColumn("agent", first_agent(F.col("executed_actions"))).filter("agent is not null")
    did = F.element_at("executed_actions", F.col("agent"))
    changes = F.coalesce(F.col("state_delta.entity_changes.changes"), F.array().cast(T.ArrayType(CHANGE)))
    moved = F.exists(changes, lambda c: (c["column"] == "node") & (c["kind"] == "update") & F.array_contains(F.map_keys("executed_actions"), c["entity_id"]))
    return rows.select(
        F.col("provenance.episode_id").alias("episode_id"), F.col("provenance.seed").alias("seed"), F.col("provenance.policy_id").alias("policy_id"), "tick", F.col("agent").alias("agent_id"), did["action_type"].alias("action_type"),
        (F.coalesce(F.size(did["params"]), F.lit(0)) > 0).alias("has_params"), F.coalesce(receipt_of(F.col("receipts"), F.col("agent"))["energy_delta"], F.lit(0.0)).alias("energy_delta"),
        first_energy_change(changes, F.col("agent")).alias("realized_first"), total_energy_change(changes, F.col("agent")).alias("realized_total"), F.coalesce(moved, F.lit(False)).alias("position_changed"),
        edge_change_count(F.col("state_delta.relation_changes.changes")).alias("edge_change_count"), candidate_rank(F.col("candidate_actions"), F.col("agent")).alias("executed_candidate_rank"), "state_before_hash", "state_after_hash",
    )
