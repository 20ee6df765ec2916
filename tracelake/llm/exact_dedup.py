"""Exact deduplication against a persistent digest index.

The index is a parquet table bucketed and sorted by the SHA-256 digest of the
normalised text. New data is reduced to one row for each digest, joined
against the index by a sort-merge anti-join (only the new side moves, the
index is read bucket by bucket as it lies), and what is new is appended.

The number of buckets is written beside the table and read on opening, so
the session's settings don't matter. An append counts once its marker is
written: rows of an attempt that died are never seen, and a batch that runs
again under its name finds its own rows and gives the same result.

Defined results: a null text counts as empty, empty texts equal each other,
the row with the largest doc_id stays (a null id is smaller than any other),
and of rows that repeat that id exactly one stays. Other columns are ignored.
An empty table gives an empty result and adds nothing to the index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import mark, marks
from .common import ASCII_LOWER, column, join_counted, keyed, partitions, row_id, scratch, staged, without

_INDEX = "digest binary, doc_id long, group_size long, batch string, attempt string"


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rid: str | None = None) -> DataFrame:
    """(rid, doc_id, digest): SHA-256 of each whole text after lower-casing A-Z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [hashlib.sha256((x.as_py() or b"").translate(ASCII_LOWER)).digest() for x in column(batch, "t")]
            yield pa.RecordBatch.from_arrays([column(batch, "rid"), column(batch, "doc_id"), pa.array(out, pa.binary())], ["rid", "doc_id", "digest"])

    rows = docs.select(row_id(rid).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"rid {dict(rows.dtypes)['rid']}, doc_id long, digest binary")


class DigestIndex:
    """A bucketed digest table at a path; opening the same path again finds what was appended before.

    path/rows holds the table, path/layout the number of buckets and
    path/batches the markers of the appends that count (one small file for
    each batch; their names are listed on the driver).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or scratch(spark, "digest-index")).rstrip("/")
        laid = [int(x.split("-")[1]) for x in marks(spark, f"{self.path}/layout")]
        if laid and buckets not in (None, laid[0]):
            raise ValueError(f"the index at {self.path} has {laid[0]} buckets, not {buckets}")
        self.buckets = laid[0] if laid else buckets or partitions(spark)
        if not laid:
            mark(spark, f"{self.path}/layout/buckets-{self.buckets}")
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.table} ({_INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def close(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _published(self) -> dict[str, str]:
        """batch -> the attempt of it that counts."""
        return dict(x.split("-") for x in marks(self.spark, f"{self.path}/batches"))

    def _publish(self, batch: str, attempt: str) -> None:
        mark(self.spark, f"{self.path}/batches/{batch}-{attempt}")

    def rows(self) -> DataFrame:
        """The rows of all appends that count."""
        return self.spark.table(self.table).filter(F.col("attempt").isin(list(self._published().values())))

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups whose digest the index lacks."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the groups (digest, doc_id, group_size) that the index lacks; nothing if the batch was added before."""
        if batch in self._published():
            return
        attempt = uuid.uuid4().hex
        new = self.unseen(groups).select("digest", "doc_id", "group_size", F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode("append").insertInto(self.table)
        self._publish(batch, attempt)


def dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", rid: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: rid, doc_id, digest, keep_id, group_size, kept. Appends new digests to the index.

    keep_id is the id that stays, from this data or from what the index held
    before; group_size counts the rows of this data. A batch name makes a run
    repeatable: the same data under the same name gives the same rows,
    whether the run before died or not. rid names a column that tells rows
    apart and can be ordered, if docs has one.
    """
    return dedup_in_turn([docs], index, text, doc_id, rid, [batch or uuid.uuid4().hex])


def dedup_in_turn(deliveries: Sequence[DataFrame], index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id", rid: str | None = None, batches: Sequence[str] | None = None) -> DataFrame:
    """dedup() of several deliveries, each against what the index holds after those before it; group_size counts the rows of all of them."""
    spark, own = deliveries[0].sparkSession, index is None
    index = index or DigestIndex(spark)
    names = [hashlib.sha1(b.encode()).hexdigest() for b in batches or [uuid.uuid4().hex for _ in deliveries]]
    rows = groups = None
    part_of = F.lit(-1)
    for part, (docs, batch) in enumerate(zip(deliveries, names, strict=True)):
        here = staged(digests(docs, text, doc_id, rid), "digests")
        best = here.groupBy("digest").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size"))
        best = staged(best.select("digest", "best.doc_id", "best.rid", "group_size"), "digest-groups")
        index.append(best, batch)
        here, best = (x.withColumn("part", F.lit(part)) for x in (here, best))
        rows, groups = (here, best) if rows is None else (rows.unionByName(here), groups.unionByName(best))
        part_of = F.when(F.col("batch") == batch, part).otherwise(part_of)

    known = index.rows().select("digest", F.col("doc_id").alias("keep_id"), part_of.alias("keeper"))
    met = groups.select("digest", "rid", "part", "group_size").join(known.hint("merge"), "digest")
    met = met.groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.first("keeper").alias("keeper"), F.sum("group_size").alias("group_size"), F.max(F.when(F.col("part") == F.col("keeper"), F.col("rid"))).alias("best_rid"))
    met = staged(met, "known-digests")
    if own:
        index.close()
    kept = F.coalesce((F.col("part") == F.col("keeper")) & (F.col("rid") == F.col("best_rid")), F.lit(False))
    found = join_counted(rows, met, ["digest"], "group_size", rows.count())
    return found.select("rid", "doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def keep_first_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their columns."""
    rows, key = keyed(docs, text, doc_id)
    named = rows.select(F.struct(F.col(key), row_id().alias("n")).alias("rid"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    found = staged(dedup(named, rid="rid").select(F.col("rid").getField(key).alias(key), "kept"), "decided")
    gone = staged(found.filter("not kept").select(key).distinct(), "dropped")
    stay = without(rows, key, gone)
    # Rows that agree in text and id: one of them stays, whichever a scan finds, so the choice is made in the scan that keeps it.
    repeated = staged(found.filter("kept").select(key).join(gone, key, "left_semi"), "repeated")
    if not repeated.isEmpty():
        stay = stay.unionByName(rows.join(repeated, key, "left_semi").dropDuplicates([key]))
    return stay.select(*docs.columns)
