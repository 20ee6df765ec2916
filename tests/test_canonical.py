from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import canonical as C

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**40), 2**40) | st.floats(-1e9, 1e9) | st.text(max_size=6) | st.binary(max_size=4),
    lambda inner: st.lists(inner, max_size=3).map(tuple) | st.dictionaries(st.text(max_size=3), inner, max_size=3),
    max_leaves=8,
)


def tagged(v):
    """A value with its types, floats as they are encoded, mappings without order."""
    if isinstance(v, tuple):
        return ("tuple", *map(tagged, v))
    if isinstance(v, dict):
        return ("mapping", frozenset((k, tagged(x)) for k, x in v.items()))
    return (type(v).__name__, repr(round(v, 12) + 0.0) if isinstance(v, float) else v)


@given(VALUES, VALUES)
@settings(max_examples=300, deadline=None)
def test_equal_encodings_are_equal_values(a, b):
    assert (C.encode_value(a) == C.encode_value(b)) == (tagged(a) == tagged(b))


def test_known_encodings():
    assert C.encode_value(None) == b"N"
    assert C.encode_value((1, True, "é", b"x", ())) == b"(5:i1Ts2:" + "é".encode() + b"b1:x()"
    assert C.encode_value({"aa": 1, "z": 2}) == b"M2:s1:zi2s2:aai1"
    assert C.encode_value({}) == b"{}" and C.encode_value(()) == b"()" and C.encode_value("") == b"s0:"
    assert C.encode_value(-0.0) == C.encode_value(0.0) == b"f0.0"
    assert C.encode_value(1e10) == b"f10000000000.0"
    assert C.encode_value(frozenset({2, 1})) == b"#2:i1i2"
    for bad in (float("nan"), float("inf"), [1], object()):
        with pytest.raises(C.CanonicalError):
            C.encode_value(bad)


def test_columns_agree_with_values(spark):
    kind = T.StructType(
        [
            T.StructField("i", T.LongType()),
            T.StructField("s", T.StringType()),
            T.StructField("f", T.DoubleType()),
            T.StructField("b", T.BooleanType()),
            T.StructField("a", T.ArrayType(T.LongType())),
            T.StructField("m", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    rows = [(1, "é", 0.1 + 0.2, True, [1, 2], {"aa": "x", "z": "y"}), (None, "", -0.0, False, [], {}), (-5, "x" * 12, 1e10, None, None, None)]
    df = spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("r", kind)]))
    found = [x.e for x in df.select(C.encode(F.col("r"), kind, "Thing").alias("e")).collect()]
    for row, text in zip(rows, found, strict=True):
        parts = b""
        for field, value in zip(kind.fields, row, strict=True):
            value = tuple(value) if isinstance(value, list) else value
            parts += b"%d:%s" % (len(field.name), field.name.encode()) + C.encode_value(value)
        assert text.encode() == b"D5:Thing" + parts


def test_seeds(spark):
    material = {"protocol": "0.1.0", "episode_seed": 7, "parent_episode_id": "seed7_run0", "fork_tick": 5, "stream": "rng"}
    expected = int.from_bytes(hashlib.sha256(C.encode_value(material)).digest()[:8], "big")
    row = spark.range(1).select(C.continuation_seed(F.lit("0.1.0"), F.lit(7), F.lit("seed7_run0"), F.lit(5), F.lit("rng")).alias("s")).first()
    assert int(row.s) == expected
    expected = int.from_bytes(hashlib.sha256(C.encode_value({"protocol": "0.1.0", "episode_seed": 7, "scope": "policy:x"})).digest()[:8], "big")
    assert int(spark.range(1).select(C.episode_scope_seed(F.lit("0.1.0"), F.lit(7), F.lit("policy:x")).alias("s")).first().s) == expected


def test_buckets(spark):
    row = spark.range(1).select(*[C.bucket_of(F.lit(t), n).alias(f"{t}{n}") for t in ("a", "north", "") for n in (7, 32, 1000)]).first()
    for t in ("a", "north", ""):
        for n in (7, 32, 1000):
            assert row[f"{t}{n}"] == int(hashlib.sha256(t.encode()).hexdigest(), 16) % n
