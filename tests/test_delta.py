"""Differences and their application, with the cases that a plain list of changes loses."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import delta as D


def test_round_trip_on_random_snapshots(spark):
    rng = random.Random(1)
    for _ in range(3):
        before = [(i, rng.choice([None, 1, 2, 3])) for i in range(40) if rng.random() < 0.7]
        after = [(i, rng.choice([None, 1, 2, 3])) for i in range(40) if rng.random() < 0.7]
        b, a = (spark.createDataFrame(x, "k int, v int") for x in (before, after))
        changes = D.differences(b, a, ["k"], "v")
        assert {(r.k, r.v) for r in D.apply(b, changes, ["k"], "v").collect()} == set(after)
        assert {r.k for r in changes.collect()} == {k for k in dict(before).keys() | dict(after).keys() if (k in dict(before)) != (k in dict(after)) or dict(before).get(k) != dict(after).get(k)}


def test_a_value_may_become_null(spark):
    b, a = spark.createDataFrame([(1, 5)], "k int, v int"), spark.createDataFrame([(1, None)], "k int, v int")
    changes = D.differences(b, a, ["k"], "v")
    assert [(r.kind, r.before, r.after) for r in changes.collect()] == [("update", 5, None)]
    assert [(r.k, r.v) for r in D.apply(b, changes, ["k"], "v").collect()] == [(1, None)]


@pytest.mark.parametrize("before, after, kind", [(None, None, "absent"), (None, [], "set"), ([], None, "cleared"), ([], [], "same"), (["d"], [], "changed"), (["a"], ["a"], "same"), (["a"], None, "cleared")])
def test_slots(spark, before, after, kind):
    """Deaths that end, slots that disappear and slots that come up empty all survive."""
    df = spark.createDataFrame([(before, after)], "b array<string>, a array<string>").withColumn("kind", D.slot_delta(F.col("b"), F.col("a")))
    row = df.withColumn("out", D.apply_slot(F.col("b"), F.col("kind"), F.col("a"))).first()
    assert row.kind == kind and row.out == after


def test_entity_changes(spark):
    b = spark.createDataFrame([("e1", 1, "x"), ("e2", 2, "y"), ("e3", None, "z")], "id string, n int, s string")
    a = spark.createDataFrame([("e2", 2, "Y"), ("e3", 4, "z"), ("e4", 1, "w")], "id string, n int, s string")
    found = {(r.kind, r.entity_id, r.column, r.before, r.after) for r in D.entity_changes(b, a, "id", ["n", "s"]).collect()}
    assert found == {("remove", "e1", None, None, None), ("add", "e4", None, None, None), ("update", "e2", "s", "y", "Y"), ("update", "e3", "n", None, "4")}


def test_last_edge_wins(spark):
    edges = spark.createDataFrame([("a", "b", "t", 1.0, 0), ("a", "b", "t", 2.0, 1), ("a", "c", "t", 3.0, 2)], "src string, dst string, edge_type string, weight double, pos int")
    assert {(r.dst, r.weight) for r in D.last_edges(edges, "pos").collect()} == {("b", 2.0), ("c", 3.0)}


def test_replay_of_changes(spark):
    initial = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "episode_id string, key string, value int")
    changes = spark.createDataFrame([("p", 0, "a", "update", 5), ("p", 1, "c", "add", 7), ("p", 2, "a", "update", 6)], "episode_id string, tick int, key string, kind string, after int")
    history = D.replay(initial, changes, ["key"])
    assert {(r.key, r.value) for r in D.at_tick(history, 1, ["key"]).collect()} == {("a", 5), ("b", 2), ("c", 7)}
    assert {(r.key, r.value) for r in D.at_tick(history, 9, ["key"]).collect()} == {("a", 6), ("b", 2), ("c", 7)}
