"""References, nested arrays and texts in rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve(value: Column, agent: Column, params: Column, entity: Column) -> Column:
    """What a text stands for: $param.x and $x a parameter, $entity.id the agent, $entity.x a column of it (maps of text), any other text itself."""
    name = lambda prefix: F.substring(value, F.lit(len(prefix) + 1), F.length(value))
    return (
        F.when(F.startswith(value, F.lit("$param.")), F.try_element_at(params, name("$param.")))
        .when(value == "$entity.id", agent)
        .when(F.startswith(value, F.lit("$entity.")), F.try_element_at(entity, name("$entity.")))
        .when(F.startswith(value, F.lit("$")), F.try_element_at(params, name("$")))
        .otherwise(value)
    )


def add_nested(values: Column, by: Column) -> Column:
    """A number added to every cell of a two-dimensional channel."""
    return F.transform(values, lambda row: F.transform(row, lambda x: x + by))


def set_nested(values: Column, to: Column) -> Column:
    return F.transform(values, lambda row: F.transform(row, lambda x: to))


def rounded(value: Column, places: int = 12) -> Column:
    """Rounded half to even, with no negative zero."""
    return F.bround(value, places) + F.lit(0.0)


def sorted_json(entries: Column) -> Column:
    """A map<string,string> as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def best_action(actions: Column) -> Column:
    """The first of the actions (array<struct<action_type, score>>) with the highest score."""
    top = F.array_max(F.transform(actions, lambda a: a["score"]))
    return F.element_at(F.filter(actions, lambda a: a["score"] == top), 1)["action_type"]


def change_order(kind: Column) -> Column:
    """Removals come before updates, updates before additions."""
    return F.when(kind == "remove", 0).when(kind == "add", 2).otherwise(1)


def selected(keys: Column, wanted: Column) -> Column:
    """Those of the keys that a comma-separated text names."""
    return F.array_intersect(F.transform(F.split(wanted, ","), lambda x: F.trim(x)), keys)
