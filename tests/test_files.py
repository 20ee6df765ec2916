"""Sources, sinks and streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import records as R
from tracelake.sources import files, sinks
from tracelake.streaming import log
from tracelake.trajectory import split_of, transitions


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"tick": 1, "schema_version": "0.1.0"}\n\nnot json\n{"tick": 2}\n')
    path = str(tmp_path / "r.jsonl")
    assert sorted(r.tick for r in files.json_lines(spark, path).select("tick").collect()) == [1, 2]
    kept = files.json_lines(spark, path, bad="keep").cache()
    assert kept.filter("_corrupt_record is not null").count() == 1
    assert {r.reason for r in sinks.judged(kept).collect()} >= {"malformed"}
    with pytest.raises(Exception):  # noqa: B017
        files.json_lines(spark, path, bad="fail").select("tick").collect()
    with pytest.raises(ValueError):
        files.json_lines(spark, path, bad="guess")


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """Blank and malformed lines count, in however many blocks a file is read."""
    lines = [json.dumps({"tick": i}) if i % 7 else ("" if i % 2 else "{broken") for i in range(500)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "in/b.jsonl").write_text('{"tick": 5}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = files.numbered_lines(spark, str(tmp_path / "in")).select("source_file", "source_line", "tick").collect()
            kept = files.numbered_lines(spark, str(tmp_path / "in"), bad="keep").filter("_corrupt_record is not null").select("source_line").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert sorted(map(tuple, found)) == sorted([("a.jsonl", i + 1, i) for i in range(500) if i % 7] + [("b.jsonl", 1, 5)])
        assert sorted(r.source_line for r in kept) == [i + 1 for i in range(0, 500, 14)]


def test_splits_in_several_objects(spark, tmp_path):
    rows = [(f"e{i:03}", ("train", "val", "test")[i % 3]) for i in range(50)]
    frame = spark.createDataFrame(rows, "episode_id string, split string")
    objects = [json.loads(r.value) for r in sinks.splits_json(frame, 20).collect()]
    assert [len(o) for o in objects] == [20, 20, 10] and [k for o in objects for k in o] == [r[0] for r in rows]
    sinks.write_splits(frame, str(tmp_path / "s"), 20)
    assert {tuple(r) for r in files.splits(spark, str(tmp_path / "s")).collect()} == set(rows)


def test_large_files_are_read_in_steps(spark, tmp_path):
    data = bytes(range(256)) * 5000
    (tmp_path / "a b.bin").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    found = {r.path.rsplit("/", 1)[1]: (r.sha256, r.length) for r in sinks.checksums(spark, str(tmp_path), step=1000).collect()}
    assert set(found.values()) == {(hashlib.sha256(data).hexdigest(), len(data))}  # Spark lists no empty files


def test_tick_files_skip_the_quarantine(spark, tmp_path):
    for folder in ("train/e1", "train/_quarantine", "test/e2"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "t0000000001.json").write_text(json.dumps({"tick": 1}, indent=1))
        (tmp_path / folder / "manifest.json").write_text(json.dumps({"record_count": 3, "quarantine_count": 1}))
    found = files.tick_files(spark, str(tmp_path)).select("file_split", "file_episode", "file_name", "tick").collect()
    assert sorted(map(tuple, found)) == [("test", "e2", "t0000000001.json", 1), ("train", "e1", "t0000000001.json", 1)]
    total = files.manifest_totals(spark, str(tmp_path / "*/e*/manifest.json")).first()
    assert (total.record_count, total.quarantine_count) == (6, 2)


def test_splits(spark, tmp_path):
    (tmp_path / "splits.json").write_text(json.dumps({"e1": "train", "e2": "test"}))
    found = files.splits(spark, str(tmp_path / "splits.json"))
    assert {(r.episode_id, r.split) for r in found.collect()} == {("e1", "train"), ("e2", "test")}
    assert json.loads(sinks.splits_json(found).first().value) == {"e1": "train", "e2": "test"}


def test_written_records(spark, sf_dir, tmp_path):
    rows = R.records(transitions(spark, sf_dir))
    rows = rows.withColumn("schema_version", F.when(F.col("tick") == 2, "9").otherwise(F.col("schema_version"))).withColumn("split", F.lit("train")).cache()
    counts = sinks.write_records(rows, str(tmp_path / "d"))
    assert counts == {"accepted": rows.filter("tick <> 2").count(), "quarantined": rows.filter("tick = 2").count()}
    back = spark.read.parquet(str(tmp_path / "d/_quarantine"))
    assert {r.reason for r in back.select("reason").distinct().collect()} == {"validation_failed: version"}
    assert spark.read.parquet(str(tmp_path / "d/records")).count() == counts["accepted"]


def test_each_record_is_made_once(spark, sf_dir, tmp_path):
    """Both folders and the counts come from one pass over what makes the records."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def version(tick):
        made.add(1)
        return "9" if tick == 2 else "0.1.0"

    flat = transitions(spark, sf_dir)
    rows = R.records(flat).withColumn("schema_version", version("tick")).withColumn("split", F.lit("train"))
    counts = sinks.write_records(rows, str(tmp_path / "d"))
    assert counts == {"accepted": flat.filter("tick <> 2").count(), "quarantined": flat.filter("tick = 2").count()}
    assert made.value == flat.count()


def test_json_lines_are_sorted(spark, sf_dir, tmp_path):
    rows = R.records(transitions(spark, sf_dir)).withColumn("split", split_of(F.col("provenance.seed").cast("long")))
    sinks.write_jsonl(rows, str(tmp_path / "out"), files=3)
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    rank = {"train": 0, "val": 1, "test": 2}
    keys = [(rank[x["split"]], x["provenance"]["episode_id"], x["tick"]) for x in lines]
    assert keys == sorted(keys) and len(keys) == rows.count()


def test_checksums_and_card(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert [r.sha256 for r in sinks.checksums(spark, str(tmp_path)).collect()] == [hashlib.sha256(b"abc").hexdigest()]
    card = sinks.dataset_card({"scenario_id": "s", "world_parameters_hash": "h", "total_records": 3, "splits": {"train": {"record_count": 3, "episode_count": 1}}}, [{"key": "Q0", "name": "Schema", "status": "fail", "evidence": "1/3"}])
    assert "| train | 3 | 1 |" in card and "Q0 fail: 1/3" in card


def test_chain_over_a_log(spark, tmp_path):
    """Out of order, twice, broken and incomplete records."""
    rows = [("e", 0, "h0", "h1"), ("e", 1, "h1", "h2"), ("e", 2, "hX", "h3"), ("e", 4, "h4", "h5"), ("f", 0, "g0", "g1")]
    schema = "episode_id string, tick long, state_before_hash string, state_after_hash string"
    path = str(tmp_path / "log")
    log.append(spark.createDataFrame([rows[2], rows[1], rows[3]], schema), path)
    log.append(spark.createDataFrame([rows[0], rows[4]], schema), path)
    log.append(spark.createDataFrame([rows[1]], schema), path)
    stream = log.tail(spark, path, spark.createDataFrame([], schema).schema, 1)
    found = sorted(((r.episode_id, r.tick, r.link_ok, r.late) for r in log.drain(log.chain(stream), "c").collect()), key=repr)
    linked = [r for r in found if not r[3]]
    assert ("e", 0, None, False) in linked and ("e", 1, True, False) in linked and ("e", 2, False, False) in linked and ("f", 0, None, False) in linked
    assert len(linked) == 4 and sum(r[3] for r in found) == 1  # tick 4 still waits for tick 3
