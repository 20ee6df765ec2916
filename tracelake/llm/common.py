"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import release, scratch, shared_dir, staged

__all__ = ["ASCII_LOWER", "STEP_BYTES", "chunks", "column", "crc_mod", "join_counted", "keyed", "numbered", "partitions", "release", "row_id", "scratch", "shared_dir", "staged", "without", "word_parts"]

#: A key with more than one in HOT of all rows is hot; at most HOT keys are.
HOT = 1024

#: Keys of at most 16 bytes that are broadcast at most; they are counted first.
BROADCAST = 1 << 19

#: Input bytes that one numpy step handles at once; temporary arrays are a small multiple of it.
STEP_BYTES = 1 << 20

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_id(rid: str | None = None) -> Column:
    """What names a row, as documents may repeat doc_id or lack it: the column rid, of any type, or else a number.

    The number follows from how the table is cut into tasks, so it may leave
    a single scan only by being written; what scans twice takes a table from
    numbered(), or keyed() rows.
    """
    return F.col(rid) if rid else F.monotonically_increasing_id()


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of row numbers, and its name. Written once, so every later scan finds the same numbers
    however many executors there are by then."""
    taken, name = {c.lower() for c in docs.columns}, "__rid"
    while name in taken:
        name += "_"
    return staged(docs.select("*", F.monotonically_increasing_id().alias(name)), "numbered"), name


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a column that identifies a row by its content, 128 bits of SHA-256 over text and doc_id, and its name.

    What is decided by text and id is the same for all rows of a key, so it
    can be carried to another scan by it. A null text counts as empty. The id
    keeps copies of a text apart, so no key gathers many rows but of one id.
    """
    taken, name = {c.lower() for c in docs.columns}, "__key"
    while name in taken:
        name += "_"
    content = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\0"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return docs.withColumn(name, F.unhex(F.substring(F.sha2(content.cast("binary"), 256), 1, 32))), name


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key is in gone (a staged table with that column alone). Up to BROADCAST keys go to the
    rows, more of them meet in a merge join."""
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST else gone.hint("merge"), key, "left_anti")


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined with per_key, which has one row for each key and the number of rows of that key.

    Hot keys, at most HOT of them, meet their rows by broadcast, so none of
    them gathers in one task. Both inputs are read twice.
    """
    heavy = F.col(count) > max(1000, total // HOT)
    hot = per_key.filter(heavy)
    here = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(per_key.filter(~heavy), keys)
    return here.unionByName(rest)


def crc_mod(col: str, by: int):
    """crc32 of the id as text, modulo by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % by


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about limit bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 16
        yield batch.slice(start)


def word_parts(text: bytes, step: int | None = None) -> Iterator[list[bytes]]:
    """text.split() in parts of about step bytes, so that the words of a very long text are never held at once."""
    step = step or STEP_BYTES
    if len(text) <= step:
        yield text.split()
        return
    rest = b""
    for at in range(0, len(text), step):
        part = rest + text[at : at + step]
        words = part.split()
        # The last word may go on in the next part.
        rest = words.pop() if words and not part[-1:].isspace() else b""
        yield words
    if rest:
        yield [rest]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))
