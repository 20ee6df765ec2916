"""Decisions of a language model: requests, retries, matching, fallback, and their telemetry.

The client is injected (prompt -> text, or a transport.Reply with the tokens
that the provider counted), so tests and replays need no network; it is made
once for a task. Rows are requests; each gives one
attempt row per try, and decisions are grouped from those.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transport import Reply

#: Seconds that a retry waits for each earlier try.
BACKOFF = 0.5

ATTEMPTS = (
    "decision_id string, attempt_index int, started_at double, finished_at double, latency_ms double, retry_backoff_ms double, input_tokens long, output_tokens long, cached_tokens long, "
    "response_hash string, parse_status string, error_category string, disposition string, effective_backend string, mock_call boolean, requested_backend string, final_origin string, action_type string"
)


def answer(text: str) -> tuple[dict | None, str]:
    """(JSON object, parse status) of an answer, a Markdown fence around it or not."""
    bare = text.strip()
    if bare.startswith("```"):
        bare = bare.partition("\n")[2].rstrip().removesuffix("```").strip()
    if not bare:
        return None, "no_content"
    try:
        found = json.loads(bare)
    except ValueError:
        return None, "json_decode_error"
    return (found, "ok") if isinstance(found, dict) else (None, "not_dict")


def one(prompt: str, legal: Sequence[str], complete: Callable[[str], str | Reply], retries: int, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> list[dict]:
    """The attempts of one decision; the last has the outcome."""
    if not legal:
        return []
    out, backoff = [], 0.0
    for i in range(1, retries + 2):
        row = {"attempt_index": i, "retry_backoff_ms": backoff * 1000, "started_at": clock(), "response_hash": "", "parse_status": "no_response", "error_category": None, "input_tokens": 0, "output_tokens": 0, "action_type": None}
        try:
            said = complete(prompt)
            said = said if isinstance(said, Reply) else Reply(said, len(prompt) // 4, len(said) // 4)
        except Exception as e:  # any failure of a client is an attempt that failed
            row["error_category"] = type(e).__name__
        else:
            body, row["parse_status"] = answer(said.text)
            row["response_hash"] = "sha256:" + hashlib.sha256(said.text.encode()).hexdigest()
            row["input_tokens"], row["output_tokens"] = said.input_tokens, said.output_tokens
            if body is not None and body.get("action_type") in legal:
                row["action_type"] = body["action_type"]
        row["finished_at"] = clock()
        row["disposition"] = "success" if row["action_type"] is not None else "retry" if i <= retries else "give_up"
        out.append(row)
        if row["disposition"] != "retry":
            break
        backoff = BACKOFF * i
        wait(backoff)
    return out


def decide(requests: DataFrame, make_client: Callable[[], Callable[[str], str]], retries: int = 2, fallback: str = "first", backend: str = "fake", requested: str | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Attempt rows of requests (decision_id, prompt, legal: array of action types).

    A decision that no try settles falls back to the first legal action, or
    declines (fallback="decline"). One without legal actions makes no try.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make_client()
        for part in parts:
            rows = []
            for r in part.itertuples():
                tries = one(r.prompt, list(r.legal), complete, retries, wait)
                for t in tries:
                    settled = tries[-1]["action_type"] is not None
                    origin = "llm" if settled else "fallback" if fallback == "first" else "declined"
                    chosen = t["action_type"] if settled else r.legal[0] if t is tries[-1] and fallback == "first" else None
                    rows.append(t | {
                        "decision_id": r.decision_id, "latency_ms": (t["finished_at"] - t["started_at"]) * 1000, "cached_tokens": 0, "effective_backend": backend, "mock_call": backend == "mock",
                        "requested_backend": requested or backend, "final_origin": origin, "action_type": chosen,
                    })
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ATTEMPTS.split(", ")])

    return requests.select("decision_id", "prompt", "legal").mapInPandas(run, ATTEMPTS)


def chosen(attempts: DataFrame) -> DataFrame:
    """decision_id, action_type, final_origin of each decision's last attempt."""
    return attempts.groupBy("decision_id").agg(F.max_by("action_type", "attempt_index").alias("action_type"), F.max_by("final_origin", "attempt_index").alias("final_origin"))


def constant(action_type: str) -> Callable[[], Callable[[str], str]]:
    """A client for tests that always gives one action."""
    return lambda: lambda prompt: json.dumps({"action_type": action_type, "params": {}})


def echo() -> Callable[[], Callable[[str], Reply]]:
    """A client for tests that gives the prompt back, for 20 tokens."""
    return lambda: lambda prompt: Reply(prompt, len(prompt) // 4, 20)


def first_legal() -> Callable[[str], str]:
    """A client for tests that gives the prompt's first legal action."""
    return lambda prompt: json.dumps({"action_type": json.loads(prompt)["legal_actions"][0]["action_type"]})


def contract(observation: Mapping) -> dict:
    """What a prompt declares: the first action of each type with its parameters' types, visible slots, and what is left out."""
    schema, seen = [], set()
    names = ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (type(None), "null"))
    for action in observation["legal_actions"]:
        if action["action_type"] not in seen:
            seen.add(action["action_type"])
            kinds = {k: next((n for t, n in names if isinstance(v, t)), "string") for k, v in (action.get("params") or {}).items()}
            schema.append({"action_type": action["action_type"], "params_schema": kinds})
    slots = [s for s in ("visible_fields", "visible_entities", "visible_relations", "visible_events") if observation.get(s)]
    return {
        "schema_version": "0.1.0", "scenario_id": observation["scenario_id"], "scenario_version": observation["scenario_version"], "action_schema": schema,
        "visible_slots": [*slots, "legal_actions", "focal_agent"], "omitted": list(observation.get("omitted", ())),
    }


def message(observation: Mapping) -> str:
    """The prompt: contract and observation as JSON with sorted keys."""
    return json.dumps({"schema_version": "0.1.0", "scenario_contract": contract(observation), "observation": observation}, sort_keys=True, ensure_ascii=False)


def contract_faults(observation: Mapping, declared: Mapping) -> list[str]:
    """What keeps a contract from fitting an observation."""
    out = []
    if declared.get("schema_version") != "0.1.0":
        out.append("schema_version")
    for key in ("scenario_id", "scenario_version"):
        if declared.get(key) != observation.get(key):
            out.append(key)
    legal, known = {a["action_type"] for a in observation["legal_actions"]}, {a["action_type"] for a in declared["action_schema"]}
    return out + [f"missing:{a}" for a in sorted(legal - known)] + [f"extra:{a}" for a in sorted(known - legal)]


def observation(world, agent: str) -> dict:
    """What an agent of a world sees: all of itself, the public columns of the others, relations in order, its legal actions."""
    public = ("x", "y", "node", "alive")
    view = world.view()
    rows = view["entities"]
    own = rows[agent]
    spec = world.spec["scenario"]
    return {
        "schema_version": "0.1.0", "scenario_id": spec["scenario_id"], "scenario_version": spec["scenario_version"], "tick": view["tick"],
        "focal_agent": {"agent_id": agent, "public": {k: v for k, v in own.items() if k in public}, "own": {k: v for k, v in own.items() if k not in public}},
        "visible_fields": view["fields"] or {}, "visible_entities": [{"entity_id": e, "columns": {k: v for k, v in r.items() if k in public}} for e, r in rows.items() if e != agent],
        "visible_relations": view["edges"] or [], "visible_events": view["events"] or [], "legal_actions": [{"action_type": t, "params": p} for t, p in world.legal(agent)],
        "omitted": [s for s in ("fields", "relations", "registries", "population", "events") if not world.caps[s]],
    }
