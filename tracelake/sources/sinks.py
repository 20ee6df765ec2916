"""Writing datasets: records with a quarantine, splits, manifests, checksums and the written reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..operators.grouping import manifest
from ..operators.ordering import numbered
from ..scratch import release, staged
from .files import split_rank


def judged(rows: DataFrame) -> DataFrame:
    """rows with the first rule that a record breaks in reason, null for a valid one."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(R.schema_rules().items()):
        reason = F.when(~rule, F.lit(f"validation_failed: {name}")).otherwise(reason)
    if "_corrupt_record" in rows.columns:
        reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed").otherwise(reason)
    return rows.withColumn("reason", reason)


def write_records(rows: DataFrame, path: str, mode: str = "append") -> dict[str, int]:
    """Valid records to records/, by split and episode if rows have a split; the others to _quarantine/ with their reason.

    The commit protocol makes each batch visible as a whole. Returns the counts.
    Records are made and judged once and staged: a filter by their reason
    would go below what makes them and bring a copy of it for each rule.
    """
    found = staged(judged(rows).withColumn("episode_id", F.col("provenance.episode_id")), "judged")
    keys = [k for k in ("split",) if k in rows.columns]
    found.filter("reason is null").drop("reason").write.mode(mode).partitionBy(*keys).parquet(f"{path}/records")
    found.filter("reason is not null").write.mode(mode).parquet(f"{path}/_quarantine")
    n = found.agg(F.count_if(F.col("reason").isNull()).alias("a"), F.count("reason").alias("q")).first()
    release(found)
    return {"accepted": n.a, "quarantined": n.q}


def write_jsonl(rows: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines ordered by split, episode and tick: range-partitioned, so the files in name order are the sorted whole."""
    order: list[Column] = [split_rank(F.col("split")), F.col("provenance.episode_id"), F.col("tick")]
    n = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    sorted_rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_manifests(flat: DataFrame, path: str) -> None:
    """One JSON row for each episode: counts, first and last tick and hash. flat: as trajectory.transitions."""
    manifest(flat).write.mode("overwrite").json(path)


def dataset_manifest(flat: DataFrame, scenario: str, params_hash: str) -> DataFrame:
    """One row: totals and counts by split; flat has a split."""
    by = flat.groupBy("split").agg(F.count("*").alias("record_count"), F.count_distinct("episode_id").alias("episode_count"))
    return by.agg(
        F.lit(scenario).alias("scenario_id"), F.lit(params_hash).alias("world_parameters_hash"), F.sum("record_count").alias("total_records"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", F.struct("record_count", "episode_count"))))).alias("splits"),
    )


def splits_json(splits: DataFrame, each: int = 100_000) -> DataFrame:
    """{episode: split} with episodes in order, so many of them in one row; rows are in order too, and files.splits() reads them all."""
    rows = numbered(splits.select("episode_id", "split"), ["episode_id", "split"], "__n").withColumn("__part", F.floor(F.col("__n") / each))
    objects = rows.groupBy("__part").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("episode_id", "split"))))).alias("value"))
    return objects.orderBy("__part").select("value")


def write_splits(splits: DataFrame, path: str, each: int = 100_000) -> None:
    """One file for each object of splits_json()."""
    objects = splits_json(splits, each)
    objects.repartitionByRange(max(1, objects.count()), "value").write.mode("overwrite").text(path)


def split_manifest(flat: DataFrame) -> DataFrame:
    """One row for each split: counts, and its episodes' first and last ticks. flat has a split."""
    per = flat.groupBy("split", "episode_id").agg(F.count("*").alias("n"), F.min("tick").alias("first"), F.max("tick").alias("last"))
    return per.groupBy("split").agg(F.count("*").alias("episode_count"), F.sum("n").alias("record_count"), F.min("first").alias("first_tick"), F.max("last").alias("last_tick"))


def checksums(spark: SparkSession, path: str, step: int = 8 << 20) -> DataFrame:
    """path, sha256 and length of every file below a path that is not empty, read in steps, so a file of any size takes no more memory."""
    from collections.abc import Iterator
    from urllib.parse import quote

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                if name.startswith("file:"):
                    system, inner = fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")
                else:
                    system, inner = fs.FileSystem.from_uri(quote(name, safe=":/@%"))
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as f:
                    while part := f.read(step):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), batch.column(1)], ["path", "sha256", "length"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.mapInArrow(run, "path string, sha256 string, length long")


def schema_snapshot(rows: DataFrame) -> str:
    return json.dumps(json.loads(rows.schema.json()), sort_keys=True)


def write_documents(spark: SparkSession, documents: Mapping[str, object], path: str) -> None:
    """Small JSON documents by name, each a row of one table of text (name, value): schemas, capabilities, parameters."""
    rows = [(name, json.dumps(value, sort_keys=True, default=plain)) for name, value in sorted(documents.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def plain(value: object) -> object:
    """Sets and tuples as sorted and plain lists, for JSON."""
    if isinstance(value, (set, frozenset)):
        return sorted(value, key=repr)
    if isinstance(value, tuple):
        return list(value)
    raise TypeError(f"{type(value).__name__} has no JSON form")


def dataset_card(manifest_row: Mapping, gates: list[Mapping]) -> str:
    """A Markdown card of a dataset: sizes, splits and gate results."""
    lines = [f"# Dataset {manifest_row['scenario_id']}", "", f"World parameters: `{manifest_row['world_parameters_hash']}`", "", f"Records: {manifest_row['total_records']}", "", "| split | records | episodes |", "|-|-|-|"]
    lines += [f"| {k} | {v['record_count']} | {v['episode_count']} |" for k, v in sorted(manifest_row["splits"].items())]
    lines += ["", "| gate | status | evidence |", "|-|-|-|"] + [f"| {g['key']} {g['name']} | {g['status']} | {g['evidence']} |" for g in gates]
    lines += ["", "## Known limitations", "", *[f"- {g['key']} {g['status']}: {g['evidence']}" for g in gates if g["status"] != "pass"]]
    return "\n".join(lines) + "\n"


def write_report(rows: DataFrame, path: str) -> None:
    """A small report table as one JSON file, for reports of which a definition fixes the size (gates, coverage totals)."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def append_telemetry(attempts: DataFrame, path: str) -> None:
    """Attempt rows onto a telemetry table, by backend."""
    attempts.write.mode("append").partitionBy("effective_backend").parquet(path)
