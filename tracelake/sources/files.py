"""Reading records: JSON lines, per-tick files, splits and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import RECORD
from ..scratch import staged

BAD = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD, bad: str = "drop") -> DataFrame:
    """Records of JSON-lines files; blank lines are none. bad: drop malformed lines, fail on them, or keep them in _corrupt_record."""
    if bad == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if bad == "drop":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if bad == "keep":
        with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
        return spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    raise ValueError(f"bad is drop, fail or keep, not {bad!r}")


def tick_files(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Records of <split>/<episode>/t*.json with split, episode and file name; folders whose names start with _ are skipped."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "t*.json").json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = rows.select("*", F.col("_metadata.file_name").alias("file_name"), F.element_at(parts, -2).alias("file_episode"), F.element_at(parts, -3).alias("file_split"))
    return rows.filter(~F.startswith("file_episode", F.lit("_")) & ~F.startswith("file_split", F.lit("_")))


def splits(spark: SparkSession, path: str) -> DataFrame:
    """episode_id, split of JSON objects {episode: split}, one in each file."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>"))).select(F.col("key").alias("episode_id"), F.col("value").alias("split"))


def manifest_totals(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Sums of record_count and quarantine_count over manifest files, each one document or, with lines, a document in each line."""
    rows = spark.read.schema("record_count long, quarantine_count long").option("multiLine", not lines).json(path)
    return rows.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"), F.coalesce(F.sum("quarantine_count"), F.lit(0)).alias("quarantine_count"))


def first_record(rows: DataFrame) -> DataFrame:
    """The first record by split (train, val, test), episode and tick."""
    return rows.orderBy(split_rank(F.col("split")), "episode_id", "tick").limit(1)


def split_rank(split):
    return F.when(split == "train", 0).when(split == "val", 1).when(split == "test", 2).otherwise(3)


def vocabularies(rows: DataFrame, first: int = 100) -> dict[str, list[str]]:
    """Action types and agents of the first records in order."""
    some = rows.orderBy("provenance.episode_id", "tick").limit(first)
    found = some.select(F.explode(F.map_values("executed_actions")).alias("a")).agg(F.array_sort(F.collect_set("a.action_type")).alias("actions"), F.array_sort(F.collect_set("a.agent_id")).alias("agents")).first()
    return {"actions": found.actions, "agents": found.agents}


def numbered_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD, bad: str = "drop") -> DataFrame:
    """Records of JSON-lines files with source_file and source_line, counted over all lines of the file, blank and malformed ones too.

    A file is read in blocks. Lines are numbered within their block, and a
    block goes on where the lines of the blocks before it end, so no task
    sees a whole file.
    """
    if bad not in ("drop", "keep"):
        raise ValueError(f"bad is drop or keep, not {bad!r}")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    lines = staged(lines, "lines")
    block = Window.partitionBy("__path", "__block").orderBy("__id")
    before = lines.groupBy("__path", "__block").agg(F.count("*").alias("__n")).select("__path", "__block", (F.sum("__n").over(Window.partitionBy("__path").orderBy("__block")) - F.col("__n")).alias("__before"))
    rows = lines.withColumn("__i", F.row_number().over(block)).join(before, ["__path", "__block"]).withColumn("source_line", F.col("__i") + F.col("__before"))
    with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    read = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    rows = rows.filter(F.trim("value") != "").select(read.alias("r"), "source_file", "source_line").select("r.*", "source_file", "source_line")
    return rows if bad == "keep" else rows.filter(F.col(BAD).isNull()).drop(BAD)
