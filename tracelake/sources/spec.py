"""Scenario specifications: loading, shape and meaning checks, identity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass
from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import spec_rules

#: Sections and whether a spec must have them.
SECTIONS = {
    "scenario": True, "time": True, "space": True, "entities": True, "actions": True, "termination": True,
    "fields": False, "relations": False, "registries": False, "exogenous": False, "data": False,
}

#: Sections whose content makes up the world's identity.
IDENTITY = ("time", "space", "fields", "entities", "relations", "registries", "actions", "exogenous", "termination")

OPS = ("set", "add", "sub", "mul", "div", "remove", "append")
DTYPES = ("int", "float", "bool", "str")

#: What a space of each type has to state.
SPACES = {"discrete": "shape", "continuous": "bounds", "graph": "node_ids"}

STOPS = ("max_ticks", "no_alive", "threshold", "custom")


class SpecError(ValueError):
    """A specification that can't be compiled; args hold its issues."""


@dataclass(frozen=True)
class Issue:
    check_id: str
    severity: str
    message: str
    location: str = ""


def load(path: str | Path) -> dict:
    """A YAML or JSON file by its extension."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text)
    if path.suffix == ".json":
        return json.loads(text)
    raise SpecError(f"a specification is .yaml, .yml or .json, not {path.suffix!r}")


# -- shape -------------------------------------------------------------------
def _kind(value: object, kind: type | tuple, what: str, out: list[Issue], low: float | None = None) -> bool:
    if isinstance(value, bool) and kind is not bool or not isinstance(value, kind):
        out.append(Issue("schema", "error", f"{what} has the wrong type", what))
        return False
    if low is not None and value < low:
        out.append(Issue("schema", "error", f"{what} is below {low}", what))
    return True


def schema_issues(data: Mapping) -> list[Issue]:
    """What is missing or of the wrong type."""
    out: list[Issue] = []
    for name in data:
        if name not in SECTIONS:
            out.append(Issue("schema", "error", f"unknown section {name}", name))
    for name, needed in SECTIONS.items():
        if name not in data:
            if needed:
                out.append(Issue("schema", "error", f"section {name} is missing", name))
        else:
            _kind(data[name], Mapping, name, out)
    if out:
        return out
    for key in ("scenario_id", "scenario_version"):
        if not isinstance(data["scenario"].get(key), str) or not data["scenario"][key]:
            out.append(Issue("schema", "error", f"scenario.{key} must be a text", f"scenario.{key}"))
    if "max_ticks" not in data["time"]:
        out.append(Issue("schema", "error", "time.max_ticks is missing", "time"))
    else:
        _kind(data["time"]["max_ticks"], int, "time.max_ticks", out, 1)
    kind = data["space"].get("type")
    if kind not in SPACES:
        out.append(Issue("schema", "error", f"space.type is one of {sorted(SPACES)}", "space.type"))
    elif SPACES[kind] not in data["space"]:
        out.append(Issue("schema", "error", f"a {kind} space needs {SPACES[kind]}", "space"))
    if not isinstance(data["entities"].get("columns"), list):
        out.append(Issue("schema", "error", "entities.columns must be a list", "entities.columns"))
    else:
        for i, c in enumerate(data["entities"]["columns"]):
            if not isinstance(c, Mapping) or "name" not in c or c.get("dtype") not in DTYPES:
                out.append(Issue("schema", "error", "a column has a name and a dtype", f"entities.columns[{i}]"))
    if "initial_count" in data["entities"]:
        _kind(data["entities"]["initial_count"], int, "entities.initial_count", out, 0)
    else:
        out.append(Issue("schema", "error", "entities.initial_count is missing", "entities"))
    for i, a in enumerate(data["actions"].get("actions") or ()):
        if not a.get("action_type") or not isinstance(a.get("effects"), list):
            out.append(Issue("schema", "error", "an action has an action_type and effects", f"actions[{i}]"))
            continue
        for j, e in enumerate(a["effects"]):
            if "target" not in e or e.get("op") not in OPS:
                out.append(Issue("schema", "error", f"an effect has a target and an op of {list(OPS)}", f"actions[{i}].effects[{j}]"))
    if "actions" not in data["actions"]:
        out.append(Issue("schema", "error", "actions.actions is missing", "actions"))
    stops = data["termination"].get("stop_conditions")
    if not isinstance(stops, list) or not stops:
        out.append(Issue("schema", "error", "termination.stop_conditions needs an entry", "termination.stop_conditions"))
    else:
        out += [Issue("schema", "error", f"a stop condition's kind is one of {list(STOPS)}", f"termination.stop_conditions[{i}]") for i, s in enumerate(stops) if s.get("kind") not in STOPS]
    return out


# -- meaning -----------------------------------------------------------------
def semantic_issues(data: Mapping) -> list[Issue]:
    """What a specification of right shape gets wrong; the rules are in spec_rules."""
    return [Issue(*found) for found in spec_rules.check_one(data)]


def compile_spec(data: Mapping) -> dict:
    """The specification with defaults; raises SpecError if it has an error of shape or meaning."""
    errors = schema_issues(data) or [i for i in semantic_issues(data) if i.severity == "error"]
    if errors:
        raise SpecError(*errors)
    full = {name: dict(data.get(name) or {}) for name in SECTIONS}
    full["time"] = {"dt": 1.0, "max_ticks": 100, "deterministic": True} | full["time"]
    full["relations"] = {"enabled": False, "directed": True, "edge_types": []} | full["relations"]
    full["registries"] = {"enabled": False, "registry_types": [], "initial_entries": []} | full["registries"]
    full["fields"] = {"enabled": False, "channels": []} | full["fields"]
    full["exogenous"] = {"events": [], "seed": None} | full["exogenous"]
    full["actions"] = {"actions": [], "is_closed": True} | full["actions"]
    return full


def parameters(spec: Mapping) -> dict:
    """The sections that make up the world's identity."""
    return {k: spec.get(k, {}) for k in IDENTITY}


def _plain(value: object) -> object:
    """JSON's form of what JSON lacks: sets as sorted lists, other things as text."""
    return sorted(value, key=repr) if isinstance(value, (set, frozenset)) else str(value)


def params_hash(spec: Mapping) -> str:
    """SHA-256 of the identity sections as JSON with sorted keys."""
    text = json.dumps(parameters(spec), sort_keys=True, default=_plain)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def json_schema() -> dict:
    """The shape of a specification as a JSON Schema document; spec.schema.json beside this module holds it."""
    name = {"type": "string", "minLength": 1}
    listed = lambda item: {"type": "array", "items": item}
    known = lambda needs, **properties: {"type": "object", "required": list(needs), "properties": properties}
    effect = known(("target", "op"), target={}, op={"enum": list(OPS)})
    parts = {
        "scenario": known(("scenario_id", "scenario_version"), scenario_id=name, scenario_version=name),
        "time": known(("max_ticks",), max_ticks={"type": "integer", "minimum": 1}),
        "space": known(("type",), type={"enum": sorted(SPACES)}) | {"allOf": [{"if": {"properties": {"type": {"const": k}}}, "then": {"required": [need]}} for k, need in sorted(SPACES.items())]},
        "entities": known(("columns", "initial_count"), columns=listed(known(("name", "dtype"), dtype={"enum": list(DTYPES)})), initial_count={"type": "integer", "minimum": 0}),
        "actions": known(("actions",), actions=listed(known(("action_type", "effects"), action_type=name, effects=listed(effect)))),
        "termination": known(("stop_conditions",), stop_conditions=listed(known(("kind",), kind={"enum": list(STOPS)})) | {"minItems": 1}),
    }
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": False, "required": [k for k, needed in SECTIONS.items() if needed],
        "properties": {k: parts.get(k, {"type": "object"}) for k in SECTIONS},
    }


def packaged_schema() -> dict:
    """The schema document that the package ships."""
    return json.loads(resources.files(__package__).joinpath("spec.schema.json").read_text(encoding="utf-8"))


def capabilities(spec: Mapping) -> dict[str, object]:
    """Which slots a world has, by what its specification uses."""
    events = spec.get("exogenous", {}).get("events", ())
    said = spec_rules.facts("", spec)
    population = any(s[2] == "no_alive" for s in said["stops"]) or any(e[3] == "population" for e in said["effects"]) or any(e.get("kind") in ("birth", "death") for e in events)
    return {
        "fields": bool(spec["fields"].get("enabled")), "entities": True, "relations": bool(spec["relations"].get("enabled")), "registries": bool(spec["registries"].get("enabled")),
        "population": population, "events": bool(events), "exact_restore": True, "executable_deterministic_replay": True, "authority": "rule", "ground_truth": True,
        "transition_mode": "deterministic" if spec["time"].get("deterministic", True) else "stochastic",
    }


def issues_frame(spark: SparkSession, specs: Mapping[str, Mapping]) -> DataFrame:
    """All issues of many specifications as rows; the meaning of those of wrong shape is not looked at."""
    shape = {name: schema_issues(data) for name, data in specs.items()}
    rows = [(name, i.check_id, i.severity, i.message, i.location) for name, found in shape.items() for i in found]
    wrong = spark.createDataFrame(rows, "spec string, check_id string, severity string, message string, location string")
    return wrong.unionByName(spec_rules.check_all(spark, {name: data for name, data in specs.items() if not shape[name]}))
