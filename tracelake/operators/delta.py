"""Structural differences between two snapshots, and their application.

Snapshots are long tables. Every kind of difference is one full outer join
on its key with null-safe comparison; application is the inverse. Changes
carry an explicit kind, so that a value that becomes null, a slot that
disappears and a list that becomes empty survive the round trip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differences(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, update: str = "update") -> DataFrame:
    """keys, kind (add, remove or the name for an update), before, after of every key whose value differs or that only one side has."""
    b = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("__b"))
    a = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("__a"))
    both = b.join(a, list(keys), "full_outer")
    kind = F.when(F.col("__b").isNull(), "add").when(F.col("__a").isNull(), "remove").when(~F.col("before").eqNullSafe(F.col("after")), update)
    return both.select(*keys, kind.alias("kind"), "before", "after").filter("kind is not null")


def apply(before: DataFrame, changes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The snapshot after the changes."""
    c = changes.select(*keys, F.col("kind").alias("__kind"), F.col("after").alias("__after"))
    both = before.select(*keys, value).join(c, list(keys), "full_outer").filter(~F.coalesce(F.col("__kind") == "remove", F.lit(False)))
    return both.select(*keys, F.when(F.col("__kind").isNull(), F.col(value)).otherwise(F.col("__after")).alias(value))


def entity_changes(before: DataFrame, after: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    """Changes of wide entity rows: one for an added or removed entity, one for each updated column.

    Order of the result as of a change list: removals, updates, additions, each by entity and column.
    """
    b = before.select(F.col(ident).cast("string").alias("entity_id"), *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("__b"))
    a = after.select(F.col(ident).cast("string").alias("entity_id"), *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("__a"))
    both = b.join(a, "entity_id", "full_outer")
    text = lambda x: F.col(x).cast("string")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(f"b_{c}").alias("before"), text(f"a_{c}").alias("after"), F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")).alias("same")) for c in columns]))
    updates = both.filter("__b and __a").select("entity_id", cells.alias("x")).filter("not x.same").select("entity_id", F.lit("update").alias("kind"), "x.column", "x.before", "x.after")
    whole = both.filter("__b is null or __a is null").select("entity_id", F.when(F.col("__b").isNull(), "add").otherwise("remove").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("column", "before", "after")])
    return whole.unionByName(updates)


def last_edges(edges: DataFrame, position: str) -> DataFrame:
    """One edge for each (src, dst, edge_type): the last listed."""
    return edges.groupBy("src", "dst", "edge_type").agg(F.max_by("weight", position).alias("weight"))


def relation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    return differences(before, after, ["src", "dst", "edge_type"], "weight", "update_weight")


def registry_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    return differences(before, after, ["registry_type", "entry_id"], "state", "state_change")


def population_changes(before: Column, after: Column) -> tuple[Column, Column]:
    """(births, deaths): ids alive only after, only before; null lists are empty."""
    empty = F.array().cast("array<string>")
    b, a = F.coalesce(before, empty), F.coalesce(after, empty)
    return F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))


def slot_delta(before: Column, after: Column) -> Column:
    """What became of an optional slot: absent (in both), cleared, set, same or changed. Null is absent, an empty list is not."""
    return (
        F.when(before.isNull() & after.isNull(), "absent").when(after.isNull(), "cleared").when(before.isNull(), "set").when(before == after, "same").otherwise("changed")
    )


def apply_slot(before: Column, kind: Column, after: Column) -> Column:
    """The slot after its delta; the after-image of a set or changed slot is whole."""
    return F.when(kind.isin("absent", "cleared"), F.lit(None)).when(kind.isin("set", "changed"), after).otherwise(before)


def replay(initial: DataFrame, changes: DataFrame, keys: Sequence[str], by: Sequence[str] = ("episode_id",)) -> DataFrame:
    """The value of every key after each tick at which it changed.

    initial: by, keys, value (the state before the first tick); changes: by,
    tick, keys, kind, after. The last change up to a tick wins, so the fold
    over ticks is one window; a removal leaves no row.
    """
    first = initial.select(*by, *keys, F.lit(-1).cast("long").alias("tick"), F.lit("add").alias("kind"), F.col("value").alias("after"))
    return first.unionByName(changes.select(*by, *keys, F.col("tick").cast("long").alias("tick"), "kind", "after")).filter("kind <> 'remove'").withColumnRenamed("after", "value")


def at_tick(history: DataFrame, tick: int, keys: Sequence[str], by: Sequence[str] = ("episode_id",)) -> DataFrame:
    """The snapshot after a tick, from all changes (removals included) with their initial rows."""
    w = Window.partitionBy(*by, *keys).orderBy(F.desc("tick"))
    last = history.filter(F.col("tick") <= tick).withColumn("__i", F.row_number().over(w)).filter("__i = 1 and kind <> 'remove'")
    return last.drop("__i")
