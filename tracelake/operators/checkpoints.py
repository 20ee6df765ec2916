"""Checkpoints as rows: the state and generators of a world as bytes, with a checksum over all that identifies them.

A codec turns a snapshot into bytes and back. The one here is JSON with the
non-JSON values of a snapshot (tuples) marked, so nothing read from a
checkpoint is ever executed. A row that is restored is checked three ways:
its codec is known, its checksum fits its content, and the state that the
world then shows hashes to the one recorded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .records import SCHEMA_VERSION
from .simulate import _frame
from .world import World

CHECKPOINT = (
    "episode_id string, seed long, tick long, schema_version string, world_id string, world_version string, state_hash string, payload binary, payload_codec string, rng_bundle map<string,string>, checksum string"
)
RESTORED = "episode_id string, tick long, ok boolean, message string"


@dataclass(frozen=True)
class Codec:
    name: str
    encode: Callable[[object], bytes]
    decode: Callable[[bytes], object]


def _marked(value):
    if isinstance(value, tuple):
        return {"$tuple": [_marked(v) for v in value]}
    if isinstance(value, list):
        return [_marked(v) for v in value]
    if isinstance(value, Mapping):
        return {k: _marked(v) for k, v in value.items()}
    return value


def _unmarked(value: dict):
    return tuple(value["$tuple"]) if set(value) == {"$tuple"} else value


JSON = Codec("json", lambda v: json.dumps(_marked(v), sort_keys=True).encode(), lambda b: json.loads(b, object_hook=_unmarked))

CODECS = {JSON.name: JSON}


def checksum(row: Mapping) -> str:
    """SHA-256 over version, world, tick, state hash, payload, codec and the generators in order, as counterfactual.checkpoint_checksum gives it."""
    rng = [f"{k}\x01{v}" for k, v in sorted((row["rng_bundle"] or {}).items())]
    parts = [row["schema_version"], row["world_id"], row["world_version"], str(row["tick"]), row["state_hash"], row["payload"], row["payload_codec"], *rng]
    return "sha256:" + hashlib.sha256(b"\0".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def take(world: World, episode: str = "", codec: Codec = JSON) -> dict:
    """The checkpoint of a world as it is."""
    saved, scenario = world.snapshot(), world.spec["scenario"]
    row = {
        "episode_id": episode, "seed": world.state["seed"], "tick": world.state["tick"], "schema_version": SCHEMA_VERSION, "world_id": scenario["scenario_id"], "world_version": scenario["scenario_version"],
        "state_hash": world.hash(), "payload": codec.encode(saved), "payload_codec": codec.name, "rng_bundle": {"exogenous": json.dumps(_marked(saved["exo"]))},
    }
    return row | {"checksum": checksum(row)}


def restore(world: World, row: Mapping) -> str:
    """Puts the world where the checkpoint was taken; what is wrong with it, or nothing."""
    codec = CODECS.get(row["payload_codec"])
    if codec is None:
        return f"unknown codec {row['payload_codec']}"
    if row["checksum"] != checksum(row):
        return "the checksum does not fit"
    world.restore(codec.decode(bytes(row["payload"])))
    return "" if world.hash() == row["state_hash"] else "the restored state hashes to something else"


def checkpoints(records: DataFrame, spec: Mapping, every: int = 10) -> DataFrame:
    """Checkpoints of every so many ticks of simulated episodes, taken before the tick's step."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, world, rows = group.sort_values(["tick", "agent_id"]), World(spec), []
        world.reset(int(group["seed"].iloc[0]))
        for tick, step in group.groupby("tick", sort=True):
            if tick % every == 0:
                rows.append(take(world, step["episode_id"].iloc[0]))
            event = step["exogenous"].iloc[0]
            world.step([(r.agent_id, r.action_type, json.loads(r.params)) for r in step.itertuples()], json.loads(event) if event else None)
        return _frame(rows, CHECKPOINT)

    return records.groupBy("episode_id").applyInPandas(run, CHECKPOINT)


def restored(rows: DataFrame, spec: Mapping) -> DataFrame:
    """Whether each checkpoint can be restored, and if not, why."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        world = World(spec)
        world.reset(0)
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                message = restore(world, r | {"rng_bundle": dict(r["rng_bundle"]) if r["rng_bundle"] is not None else None, "payload": bytes(r["payload"])})
                out.append({"episode_id": r["episode_id"], "tick": r["tick"], "ok": not message, "message": message})
            yield _frame(out, RESTORED)

    return rows.mapInPandas(run, RESTORED)
