"""Meaning checks of specifications: SQL rules over tables of what the specifications say.

Specifications are taken apart into five narrow tables (worlds, names,
effects, needs, stops), a row for each thing stated, and a rule is a query
that returns the rows at fault. Spark runs the rules over any number of
specifications at once; one specification alone runs them on an in-memory
SQLite, so that it compiles without a session.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the specification language.
TARGETS = ("entity", "field", "registry", "relation", "population")
FUTURE = ("$future", "$next", "$tick+1", "$t+1")
KERNEL_OWNED = ("meta", "capabilities", "missing_mask", "rng_state_ref")
KERNEL_PREFIXES = ("meta.", "capabilities.")
READ_ONLY = ("emergence", "emergent", "L5")
UNBOUNDED_TICKS = 10_000
DEFAULT_TICKS = 100

#: Columns of the tables, after the specification's name; texts but for the numbers of worlds.
TABLES = {
    "worlds": "max_ticks double, fixed_course int, seeded int, space string, has_registries int, stop_count int",
    "names": "kind string, name string",
    "effects": "place string, action string, target string, field string, op string, value string",
    "needs": "place string, kind string, registry string",
    "stops": "place string, kind string, field string, op string, value string, predicate string",
}


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def facts(name: str, data: Mapping) -> dict[str, list[tuple]]:
    """The rows that a specification of right shape adds to each table."""
    actions = list(data["actions"].get("actions") or ())
    registries, stops = data.get("registries") or {}, list(data["termination"].get("stop_conditions") or ())
    seed = (data.get("exogenous") or {}).get("seed")
    of_actions = [(f"actions[{i}]", a) for i, a in enumerate(actions)]
    return {
        "worlds": [(name, float(data["time"].get("max_ticks", DEFAULT_TICKS)), int(bool(data["time"].get("deterministic", True))), int(seed is not None), _text(data["space"].get("type")), int(bool(registries.get("enabled"))), len(stops))],
        "names": [(name, "column", str(c["name"])) for c in data["entities"].get("columns") or ()] + [(name, "registry", str(r)) for r in registries.get("registry_types") or ()],
        "effects": [(name, f"{at}.effects[{j}]", _text(a.get("action_type")), *(_text(e.get(k)) for k in ("target", "field", "op", "value"))) for at, a in of_actions for j, e in enumerate(a.get("effects") or ())],
        "needs": [(name, f"{at}.preconditions[{j}]", _text(p.get("kind")), _text(p.get("registry_type"))) for at, a in of_actions for j, p in enumerate(a.get("preconditions") or ())],
        "stops": [(name, f"termination.stop_conditions[{i}]", *(_text(s.get(k)) for k in ("kind", "field", "op", "value", "predicate"))) for i, s in enumerate(stops)],
    }


def _among(column: str, values: Iterable[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _begins(column: str, prefixes: Iterable[str]) -> str:
    return " OR ".join(f"substr({column}, 1, {len(p)}) = '{p}'" for p in prefixes)


@dataclass(frozen=True)
class Rule:
    """found returns spec, location and subject (what the message names) of each fault; {table} stands for a table."""

    check_id: str
    severity: str
    message: str
    found: str


def _lacks(column: str) -> Rule:
    return Rule("5", "error", f"a threshold needs {column}", f"SELECT spec, place AS location, '' AS subject FROM {{stops}} WHERE kind = 'threshold' AND {column} IS NULL")


_EFFECT = "SELECT spec, place AS location, concat(coalesce(target, ''), '.', coalesce(field, '')) AS subject FROM {effects} WHERE "

RULES = (
    Rule("1", "error", "an action writes an undeclared column", "SELECT e.spec, e.place AS location, e.field AS subject FROM {effects} e LEFT JOIN {names} n ON n.spec = e.spec AND n.kind = 'column' AND n.name = e.field WHERE e.target = 'entity' AND e.field <> '' AND n.name IS NULL"),
    Rule("2", "error", "a target is one of " + ", ".join(TARGETS), _EFFECT + f"target IS NULL OR NOT ({_among('target', TARGETS)})"),
    Rule("2", "error", "an effect needs an op", _EFFECT + "op IS NULL"),
    Rule("3", "warning", "a quantity is only ever lowered", "SELECT spec, '' AS location, field AS subject FROM {effects} WHERE target IN ('entity', 'field') AND field <> '' AND op <> '' GROUP BY spec, field HAVING min(op) = 'sub' AND max(op) = 'sub'"),
    Rule("4", "error", "max_ticks is no bound", "SELECT spec, '' AS location, 'max_ticks' AS subject FROM {worlds} WHERE max_ticks <= 0"),
    Rule("4", "warning", "no stop condition and a far bound", f"SELECT spec, '' AS location, 'max_ticks' AS subject FROM {{worlds}} WHERE stop_count = 0 AND max_ticks > {UNBOUNDED_TICKS}"),
    *map(_lacks, ("field", "op", "value")),
    Rule("5", "warning", "a custom condition without a predicate can't be checked", "SELECT spec, place AS location, '' AS subject FROM {stops} WHERE kind = 'custom' AND predicate IS NULL"),
    Rule("6", "warning", "a stochastic world without a seed can't be repeated", "SELECT spec, '' AS location, '' AS subject FROM {worlds} WHERE fixed_course = 0 AND seeded = 0"),
    Rule("7", "error", "a reward reads the future", _EFFECT + "field = 'reward' AND (" + " OR ".join(f"instr(value, '{x}') > 0" for x in FUTURE) + ")"),
    Rule("8", "error", "an action writes what the kernel owns", _EFFECT + f"{_among('target', KERNEL_OWNED)} OR {_begins('field', KERNEL_PREFIXES)}"),
    Rule("9", "error", "an action writes a read-only layer", _EFFECT + f"{_among('target', READ_ONLY)} OR {_among('field', READ_ONLY)}"),
    Rule("10", "error", "a registry type is not declared", "SELECT p.spec, p.place AS location, p.registry AS subject FROM {needs} p JOIN {worlds} w ON w.spec = p.spec LEFT JOIN {names} n ON n.spec = p.spec AND n.kind = 'registry' AND n.name = p.registry WHERE w.has_registries = 1 AND p.kind = 'registry_unowned' AND p.registry <> '' AND substr(p.registry, 1, 1) <> '$' AND n.name IS NULL"),
    Rule("11", "warning", "removed entities leave their edges", "SELECT e.spec, '' AS location, '' AS subject FROM {effects} e JOIN {worlds} w ON w.spec = e.spec WHERE w.space = 'graph' GROUP BY e.spec HAVING max(CASE WHEN e.target = 'entity' AND e.op = 'remove' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN e.target = 'relation' AND e.op IN ('remove', 'set') THEN 1 ELSE 0 END) = 0"),
)


def check_one(data: Mapping) -> list[tuple[str, str, str, str]]:
    """(check, severity, message, location) of every fault of one specification, in the order of the rules."""
    db = sqlite3.connect(":memory:")
    try:
        db.create_function("concat", 3, lambda *parts: "".join(parts))
        for table, rows in facts("", data).items():
            names = ["spec", *(c.split()[0] for c in TABLES[table].split(", "))]
            db.execute(f"CREATE TABLE {table} ({', '.join(names)})")
            db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})", rows)
        own = {t: t for t in TABLES}
        return [(r.check_id, r.severity, r.message + (f": {subject}" if subject else ""), location) for r in RULES for _, location, subject in db.execute(r.found.format(**own) + " ORDER BY 2, 3")]
    finally:
        db.close()


def check_all(spark: SparkSession, specs: Mapping[str, Mapping]) -> DataFrame:
    """spec, check_id, severity, message, location of every fault of all the specifications."""
    rows: dict[str, list[tuple]] = {t: [] for t in TABLES}
    for name, data in specs.items():
        for table, more in facts(name, data).items():
            rows[table] += more
    return check_tables(spark, {t: spark.createDataFrame(rows[t], f"spec string, {columns}") for t, columns in TABLES.items()})


def check_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The same for specifications that are tables already, of any number."""
    out = None
    for r in RULES:
        text = F.concat(F.lit(r.message), F.when(F.col("subject") != "", F.concat(F.lit(": "), "subject")).otherwise(""))
        found = spark.sql(r.found, **tables).select("spec", F.lit(r.check_id).alias("check_id"), F.lit(r.severity).alias("severity"), text.alias("message"), "location")
        out = found if out is None else out.unionByName(found)
    return out
