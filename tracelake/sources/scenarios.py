"""Small scenarios of our own, for queries and tests."""

from __future__ import annotations

RELIEF = {
    "scenario": {"scenario_id": "relief", "scenario_version": "1"},
    "time": {"dt": 1.0, "max_ticks": 60, "deterministic": False},
    "space": {"type": "graph", "node_ids": ["depot", "north", "south", "bridge"], "edges": [["depot", "north"], ["north", "bridge"], ["bridge", "south"], ["south", "depot"]]},
    "fields": {"enabled": True, "channels": [{"name": "water_level", "dtype": "float"}, {"name": "supplies", "dtype": "float", "shape": [2, 2]}]},
    "entities": {
        "columns": [{"name": "energy", "dtype": "float"}, {"name": "node", "dtype": "str"}, {"name": "cargo", "dtype": "float"}, {"name": "alive", "dtype": "bool"}],
        "initial_count": 3,
        "spawn_template": {"energy_range": [3.0, 6.0]},
    },
    "relations": {"enabled": True, "directed": False, "edge_types": ["default", "radio"]},
    "registries": {"enabled": True, "registry_types": ["pump"], "initial_entries": [{"entry_id": "pump1", "registry_type": "pump", "state": "idle"}, {"entry_id": "pump2", "registry_type": "pump", "state": "idle"}]},
    "actions": {
        "is_closed": True,
        "actions": [
            {"action_type": "WALK", "params_schema": {"target_node": {"dtype": "str"}}, "effects": [{"target": "entity", "field": "node", "op": "set", "value": "$target_node"}, {"target": "entity", "field": "energy", "op": "sub", "value": 0.7}], "cost": 0.7, "preconditions": [{"kind": "edge_exists", "from": "$entity.node", "to": "$target_node"}]},
            {"action_type": "PUMP", "params_schema": {"entry_id": {"dtype": "str"}}, "effects": [{"target": "registry", "field": "owner", "op": "set", "value": "$entity.id"}, {"target": "field", "field": "water_level", "op": "sub", "value": 0.5}, {"target": "entity", "field": "energy", "op": "sub", "value": 1.0}], "cost": 1.0, "preconditions": [{"kind": "registry_unowned", "registry_type": "pump", "entry_id": "$entry_id"}, {"kind": "energy_above", "value": 1.0}]},
            {"action_type": "CALL", "params_schema": {"target_agent": {"dtype": "str"}}, "effects": [{"target": "relation", "field": "radio", "op": "add", "value": "$target_agent"}, {"target": "entity", "field": "energy", "op": "sub", "value": 0.4}], "cost": 0.4},
            {"action_type": "REST", "effects": [{"target": "entity", "field": "energy", "op": "add", "value": 0.3}], "cost": 0.0},
        ],
    },
    "exogenous": {"events": [{"kind": "hazard_escalation", "rate": 0.3, "field": "water_level"}, {"kind": "resource_spawn", "rate": 0.1}], "seed": 7},
    "termination": {"stop_conditions": [{"kind": "no_alive"}, {"kind": "max_ticks"}]},
}

RING = {
    "scenario": {"scenario_id": "ring", "scenario_version": "1"},
    "time": {"max_ticks": 20},
    "space": {"type": "discrete", "shape": [10]},
    "entities": {"columns": [{"name": "energy", "dtype": "float"}, {"name": "x", "dtype": "int"}], "initial_count": 1, "spawn_template": {"energy_range": [10.0, 10.0]}},
    "actions": {"actions": [{"action_type": "MOVE", "effects": [{"target": "entity", "field": "x", "op": "add", "value": 1}, {"target": "entity", "field": "energy", "op": "sub", "value": 0.5}], "cost": 0.5}, {"action_type": "NOOP", "effects": [], "cost": 0.0}]},
    "termination": {"stop_conditions": [{"kind": "max_ticks"}]},
}

#: One specification for each semantic check, by its number.
FAULTY = {
    "1": RING | {"actions": {"actions": [{"action_type": "A", "effects": [{"target": "entity", "field": "missing", "op": "add", "value": 1}]}]}},
    "2": RING | {"actions": {"actions": [{"action_type": "A", "effects": [{"target": "nowhere", "op": "add"}]}]}},
    "3": RING | {"actions": {"actions": [{"action_type": "A", "effects": [{"target": "entity", "field": "energy", "op": "sub", "value": 1}]}]}},
    "4": RING | {"time": {"max_ticks": 0}},
    "5": RING | {"termination": {"stop_conditions": [{"kind": "threshold", "field": "energy"}]}},
    "6": RING | {"time": {"max_ticks": 5, "deterministic": False}},
    "7": RING | {"actions": {"actions": [{"action_type": "A", "effects": [{"target": "field", "field": "reward", "op": "set", "value": "$next.energy"}]}]}},
    "8": RING | {"actions": {"actions": [{"action_type": "A", "effects": [{"target": "field", "field": "meta.tick", "op": "set", "value": 1}]}]}},
    "9": RING | {"actions": {"actions": [{"action_type": "A", "effects": [{"target": "field", "field": "emergent", "op": "set", "value": 1}]}]}},
    "10": RELIEF | {"registries": {"enabled": True, "registry_types": ["well"], "initial_entries": []}},
    "11": RELIEF | {"actions": {"actions": [{"action_type": "A", "effects": [{"target": "entity", "field": "node", "op": "remove"}]}]}},
}
