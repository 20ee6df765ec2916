"""Canonical encoding of values and the hashes over it.

encode() builds a Column from a value's type, so hashing stays in generated
code; doubles need Python's shortest text and go through an Arrow function.
encode_value() is the same rule for plain Python values on the driver.

    None N, True T, False F, int i<digits>, float f<repr of 12 places>,
    str s<bytes>:<utf8>, bytes b<n>:<raw>, tuple (<n>:<items>, empty (),
    set #<n>:<sorted items>, mapping M<n>:<k v sorted by encoded k>, empty {},
    record D<n>:<class>(<n>:<field><value>)*
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CanonicalError(ValueError):
    """A value that has no canonical encoding."""


def int_tuple(*values: Column) -> Column:
    """The encoding of a tuple of integers, as text."""
    return F.concat(F.lit(f"({len(values)}:"), *[F.concat(F.lit("i"), v.cast("string")) for v in values])


def hash_of(encoded: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(encoded.cast("binary"), 256))


def sized(text: Column) -> Column:
    """<bytes>:<text>"""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


@F.pandas_udf(T.StringType())
def _float_text(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else encode_value(float(x)).decode())


def encode(value: Column, kind: T.DataType, name: str = "Record") -> Column:
    """The encoding of a column of a type, as text. NaN counts as null here, since Spark's Arrow path doesn't tell them apart."""
    if isinstance(kind, T.BooleanType):
        known = F.when(value, "T").otherwise("F")
    elif isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        known = F.concat(F.lit("i"), value.cast("string"))
    elif isinstance(kind, T.DecimalType) and kind.scale == 0:
        known = F.concat(F.lit("i"), value.cast("string"))
    elif isinstance(kind, T.StringType):
        known = F.concat(F.lit("s"), sized(value))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        known = _float_text(value.cast("double"))
    elif isinstance(kind, T.ArrayType):
        items = F.array_join(F.transform(value, lambda x: encode(x, kind.elementType, name)), "")
        known = F.when(F.size(value) == 0, "()").otherwise(F.concat(F.lit("("), F.size(value).cast("string"), F.lit(":"), items))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(encode(e["key"], kind.keyType, name).alias("k"), encode(e["value"], kind.valueType, name).alias("v")))
        items = F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(e["k"], e["v"])), "")
        known = F.when(F.size(value) == 0, "{}").otherwise(F.concat(F.lit("M"), F.size(value).cast("string"), F.lit(":"), items))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{len(f.name.encode())}:{f.name}"), encode(value[f.name], f.dataType, f.name)) for f in kind.fields]
        known = F.concat(F.lit(f"D{len(name.encode())}:{name}"), *parts)
    else:
        raise CanonicalError(f"no canonical encoding for {kind.simpleString()}")
    return F.when(value.isNull(), "N").otherwise(known)


def encode_value(value: object) -> bytes:
    """The encoding of a Python value."""
    if value is None:
        return b"N"
    if isinstance(value, bool):
        return b"T" if value else b"F"
    if isinstance(value, int):
        return b"i%d" % value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise CanonicalError("a float must be finite")
        return b"f" + repr(round(value, 12) + 0.0).encode()
    if isinstance(value, str):
        return b"s%d:%s" % (len(value.encode()), value.encode())
    if isinstance(value, (bytes, bytearray)):
        return b"b%d:%s" % (len(value), bytes(value))
    if isinstance(value, tuple):
        return b"(%d:" % len(value) + b"".join(map(encode_value, value)) if value else b"()"
    if isinstance(value, frozenset):
        return b"#%d:" % len(value) + b"".join(sorted(map(encode_value, value)))
    if isinstance(value, Mapping):
        pairs = sorted((encode_value(k), v) for k, v in value.items())
        return b"M%d:" % len(pairs) + b"".join(k + encode_value(v) for k, v in pairs) if pairs else b"{}"
    raise CanonicalError(f"no canonical encoding for {type(value).__name__}")


def hash_value(value: object) -> str:
    return "sha256:" + hashlib.sha256(encode_value(value)).hexdigest()


def seed_from_hex(digest: Column) -> Column:
    """An unsigned 64-bit seed: the first eight bytes of a hex digest, big-endian."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def continuation_seed(protocol: Column, episode_seed: Column, parent: Column, fork_tick: Column, stream: Column) -> Column:
    """The seed of a random stream after a fork: hash of a mapping of five keys, in the order of their encodings."""
    text = F.concat(
        F.lit("M5:s12:episode_seedi"), episode_seed.cast("string"), F.lit("s17:parent_episode_ids"), sized(parent), F.lit("s6:streams"), sized(stream),
        F.lit("s8:protocols"), sized(protocol), F.lit("s9:fork_ticki"), fork_tick.cast("string"),
    )
    return seed_from_hex(F.sha2(text.cast("binary"), 256))


def episode_scope_seed(protocol: Column, episode_seed: Column, scope: Column) -> Column:
    """The seed of an episode's own random stream."""
    text = F.concat(F.lit("M3:s12:episode_seedi"), episode_seed.cast("string"), F.lit("s5:scopes"), sized(scope), F.lit("s8:protocols"), sized(protocol))
    return seed_from_hex(F.sha2(text.cast("binary"), 256))


def bucket_of(text: Column, buckets: int) -> Column:
    """SHA-256 of a text modulo a number of buckets, folded digit by digit so that no wide integer is needed."""
    digits = F.split(F.sha2(text.cast("binary"), 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % buckets)
