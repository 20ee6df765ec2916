"""What references, preconditions, parameters, effects and events mean, as tables of handlers by name.

A Moment is what a handler may look at: the world's state and specification,
the action, the agent and its parameters. Names that a table lacks do
nothing (effects, events) or hold (preconditions).
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field


@dataclass
class Moment:
    state: dict
    spec: Mapping
    agent: str
    params: Mapping = field(default_factory=dict)
    action: Mapping = field(default_factory=dict)

    @property
    def own(self) -> dict:
        """The agent's row, empty for an unknown agent."""
        return self.state["entities"].get(self.agent, {})

    def read(self, value):
        """A value, or what it refers to: $entity.id and $entity.x are the agent's, $param.x and $x a parameter."""
        if not (isinstance(value, str) and value[:1] == "$"):
            return value
        scope, dot, name = value[1:].partition(".")
        if scope == "entity" and dot:
            return self.agent if name == "id" else self.own.get(name)
        return self.params.get(name if scope == "param" and dot else value[1:])

    def text(self, source: Mapping, key: str) -> str:
        return str(self.read(source.get(key, "")))


# -- preconditions -----------------------------------------------------------
def _joined(m: Moment, need: Mapping) -> bool:
    ends = m.text(need, "from"), m.text(need, "to")
    ways = [ends] if m.spec["relations"]["directed"] else [ends, ends[::-1]]
    static = {tuple(e) for e in m.spec["space"].get("edges", ())}
    return any(w in static or any((e[0], e[1]) == w for e in m.state["edges"]) for w in ways)


def _free(m: Moment, need: Mapping) -> bool:
    key = m.text(need, "registry_type"), m.text(need, "entry_id")
    owners = [e["owner_id"] for e in m.state["registries"] if (e["registry_type"], e["entry_id"]) == key]
    return owners[:1] == [None]


def _strong(m: Moment, need: Mapping) -> bool:
    return m.own.get("energy") is not None and m.own["energy"] >= float(need.get("value", 0.0))


PRECONDITIONS: dict[str, Callable[[Moment, Mapping], bool]] = {"edge_exists": _joined, "registry_unowned": _free, "energy_above": _strong}


def allowed(m: Moment) -> bool:
    needs = m.action.get("preconditions", ())
    return all(PRECONDITIONS[n["kind"]](m, n) for n in needs if n.get("kind") in PRECONDITIONS)


# -- default parameters ------------------------------------------------------
def _first_entry(m: Moment) -> str:
    wanted = [n["registry_type"] for n in m.action.get("preconditions", ()) if n.get("kind") == "registry_unowned" and isinstance(n.get("registry_type"), str)][:1]
    # Entries that fit come first, in their order; else any.
    ranked = sorted(m.state["registries"], key=lambda e: e["state"] == "destroyed" or (bool(wanted) and e["registry_type"] != wanted[0]))
    return ranked[0]["entry_id"] if ranked else ""


def _first_neighbour(m: Moment) -> str:
    here = m.own.get("node")
    if here is None:
        return ""
    ends = ({"a": b, "b": a}["a" if a == here else "b"] for a, b, *_ in m.state["edges"] if here in (a, b))
    return next(ends, str(here))


def _first_other(m: Moment) -> str:
    others = sorted((not row.get("alive", True), n, name) for n, (name, row) in enumerate(m.state["entities"].items()) if name != m.agent)
    return others[0][2] if others else ""


PARAMETERS: dict[str, Callable[[Moment], object]] = {"entry_id": _first_entry, "target_node": _first_neighbour, "target_agent": _first_other, "amount": lambda m: 1.0}

#: Defaults of other parameters by their type.
BY_TYPE = {"float": 1.0, "int": 1}


def default(m: Moment, name: str, kind) -> object:
    if name in PARAMETERS:
        return PARAMETERS[name](m)
    return BY_TYPE.get(kind.get("dtype", "str") if isinstance(kind, Mapping) else "str", "")


# -- effects -----------------------------------------------------------------
def over(value, change: Callable):
    """A field's value, nested lists or a number, with every cell changed."""
    return [over(v, change) for v in value] if isinstance(value, list) else change(value)


def raise_field(state: dict, name: str, by: float) -> None:
    if name in state["fields"]:
        state["fields"][name] = over(state["fields"][name], lambda v: v + by)


#: (old, operand) -> new, for what can be computed with.
ARITHMETIC = {"add": operator.add, "sub": operator.sub, "mul": operator.mul, "set": lambda old, new: new, "clear": lambda old, new: None}


def _entity(op: str) -> Callable:
    def change(m: Moment, name: str, value) -> None:
        if name in m.own:
            m.own[name] = ARITHMETIC[op](m.own[name], value)

    return change


def _field(op: str) -> Callable:
    def change(m: Moment, name: str, value) -> None:
        if name in m.state["fields"]:
            m.state["fields"][name] = over(m.state["fields"][name], lambda old: ARITHMETIC[op](old, float(value)))

    return change


def _entry(m: Moment) -> dict:
    """The registry entry that the parameters name; an unkept one if there is none."""
    wanted, kind = str(m.params.get("entry_id", "")), str(m.params.get("registry_type", ""))
    return next((e for e in m.state["registries"] if e["entry_id"] == wanted and kind in ("", e["registry_type"])), {})


def _set_entry(m: Moment, name: str, value) -> None:
    changes = {"owner": {"owner_id": value}, "state": {"state": str(value)}}
    _entry(m).update(changes.get(name, {}))


def _destroy_entry(m: Moment, name: str, value) -> None:
    _entry(m).update(state="destroyed", owner_id=None)


def _edge(m: Moment, name: str, value) -> list | None:
    end = m.params.get("dst", value)
    return None if end is None else [str(m.params.get("src", m.agent)), str(end), name or "default"]


def _add_edge(m: Moment, name: str, value) -> None:
    if edge := _edge(m, name, value):
        m.state["edges"].append([*edge, 1.0])


def _remove_edges(m: Moment, name: str, value) -> None:
    m.state["edges"] = [e for e in m.state["edges"] if e[:3] != _edge(m, name, value)]


EFFECTS: dict[tuple[str, str], Callable[[Moment, str, object], None]] = {
    **{("entity", op): _entity(op) for op in ARITHMETIC},
    **{("field", op): _field(op) for op in ("add", "sub", "set")},
    ("registry", "set"): _set_entry, ("registry", "remove"): _destroy_entry,
    ("relation", "add"): _add_edge, ("relation", "remove"): _remove_edges,
}


def apply(m: Moment) -> None:
    """The action's effects in declared order."""
    for e in m.action.get("effects", ()):
        handler = EFFECTS.get((e.get("target"), e.get("op", "")))
        if handler:
            handler(m, e.get("field", ""), m.read(e.get("value")))


# -- events ------------------------------------------------------------------
#: The fields that an event of a kind raises by its rate.
RAISES: dict[str, Callable[[dict, Mapping], list[str]]] = {
    "resource_spawn": lambda state, payload: list(state["fields"]),
    "hazard_escalation": lambda state, payload: [str(payload.get("field", "hazard_level"))],
}


def happen(state: dict, event: Mapping) -> None:
    payload = event["payload"]
    for name in RAISES.get(event["kind"], lambda *_: [])(state, payload):
        raise_field(state, name, float(payload.get("rate", 0.0)))
    state["events"].append({"kind": event["kind"], "tick": state["tick"], "payload": dict(payload)})
