"""Streams over an append-only log of records.

The log is a folder to which batches are committed as whole files; a stream
sees each file once. Stateful operators key their state by episode, so state
grows with open episodes, and a timeout closes one that stays incomplete.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import scratch


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def tail(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of what is and will be in the log."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, name: str, key: list[str] | None = None) -> DataFrame:
    """What the stream gives for all that is there now, written to the shared folder.

    Without a key, the rows that it appends. With the key of a grouped
    stream, the last row of each key: a batch writes only the keys it
    changed, under its number, so one that runs again replaces itself.
    """
    spark = stream.sparkSession
    out, at = scratch(spark, name), scratch(spark, f"{name}-progress")
    writer = stream.writeStream.outputMode("update" if key else "append").option("checkpointLocation", at).trigger(availableNow=True)
    if key is None:
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("__last"))
    return last.select("__last.*")


CHAIN = "episode_id string, tick long, link_ok boolean, late boolean"
_STATE = "next_tick long, last_hash string, waiting string"


def chain(stream: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Links of each episode's hash chain, whatever order records come in.

    A record ahead of its turn waits in the state until the ticks before it
    have come (so the state is as large as the disorder, not as the episode); one that comes again is reported late and not linked. With a
    patience (in processing time, so only for streams that go on), records
    still waiting when it ends are given out without a link.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHAIN.split(", ")]
        turn, last, waiting = (0, None, {}) if not state.exists else (state.get[0], state.get[1], {int(k): v for k, v in json.loads(state.get[2]).items()})
        out = []
        if state.hasTimedOut:
            yield pd.DataFrame([(key[0], t, None, False) for t in sorted(waiting)], columns=names)
            state.remove()
            return
        for part in parts:
            for r in part.itertuples():
                if r.tick < turn or r.tick in waiting:
                    out.append((key[0], r.tick, None, True))
                else:
                    waiting[int(r.tick)] = [r.state_before_hash, r.state_after_hash]
        while turn in waiting:
            before, after = waiting.pop(turn)
            out.append((key[0], turn, None if last is None else before == last, False))
            turn, last = turn + 1, after
        state.update((turn, last, json.dumps(waiting)))
        if patience_ms is not None:
            state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy("episode_id").applyInPandasWithState(step, CHAIN, _STATE, "append", "NoTimeout" if patience_ms is None else "ProcessingTimeTimeout")


def live_manifest(stream: DataFrame, streaming_only: bool = True) -> DataFrame:
    """Counts and tick range of each episode so far; counters of what was observed as well, unless streaming_only."""
    counts = [F.count("*").alias("record_count"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick")]
    if not streaming_only:
        counts += [F.count_if(F.col("action_type") == k).alias(f"{k}_count") for k in ("view", "click", "purchase", "signup", "error")]
    return stream.groupBy("episode_id").agg(*counts)


def without_repeats(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Each (episode, tick) once within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["episode_id", "tick"])


def windowed(stream: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Counts by time window and action type."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", width), "action_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action_type", "n")
