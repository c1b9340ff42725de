"""Moments of arriving rows, by stored states and by event time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.operators import moments
from thermalake.sources import tables, versions


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors share."""
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4()}"


def store_states(stream: DataFrame, keys: Sequence[str], value: Column, state_path: str, checkpoint_path: str):
    """Starts a query that writes one moment state per batch; run until the source is exhausted.

    A batch overwrites its own folder, so a repeated batch counts once, and a
    restarted query goes on after the last finished one.
    """

    return _store(stream, lambda batch: moments.state(batch, keys, value), state_path, checkpoint_path)


def _store(stream: DataFrame, state: Callable[[DataFrame], DataFrame], state_path: str, checkpoint_path: str):
    def put(batch: DataFrame, number: int) -> None:
        state(batch).write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def _batches(spark: SparkSession, state_path: str) -> list[int]:
    """The numbers of the batches whose states have a folder of their own."""
    place = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _compacted(spark: SparkSession, state_path: str) -> tuple[int, str | None]:
    """The last batch that the compacted states hold, and their folder; -1 without any."""
    text = versions.latest_text(spark, f"{state_path}-compacted")
    held = json.loads(text) if text is not None else {"through": -1, "folder": None}
    return held["through"], held["folder"]


def stored_states(spark: SparkSession, state_path: str) -> DataFrame:
    """The compacted states and those of every batch since; a batch is never in both."""
    through, folder = _compacted(spark, state_path)
    paths = [f"{state_path}/batch={n}" for n in _batches(spark, state_path) if n > through]
    return spark.read.parquet(*([folder] if folder else []), *paths)


def compact(spark: SparkSession, state_path: str, merge: Callable[[DataFrame], DataFrame], keep: int = 1) -> int:
    """Merges the states of all batches but the last `keep` into one table, and removes their folders; returns how many went.

    The last batch may be written again after a restart, so it stays as it is.
    The merged table is named by a pointer that is replaced in one step, so
    readers count every batch once whenever this is cut off; what a compaction
    that was cut off has left behind goes with the next one.
    """
    if keep < 1:
        raise ValueError("the last batch may still be written again")
    through, folder = _compacted(spark, state_path)
    ready = [n for n in _batches(spark, state_path)[:-keep] if n > through]
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(state_path).getFileSystem(spark._jsc.hadoopConfiguration())
    if ready:
        new = f"{state_path}-compacted/states-{uuid.uuid4()}"
        held = spark.read.parquet(*([folder] if folder else []), *[f"{state_path}/batch={n}" for n in ready])
        merge(held).write.parquet(new)
        versions.publish_text(spark, f"{state_path}-compacted", json.dumps({"through": ready[-1], "folder": new}))
        through = ready[-1]
        if folder:
            files.delete(place(folder), True)
    gone = [n for n in _batches(spark, state_path) if n <= through]
    for n in gone:
        files.delete(place(f"{state_path}/batch={n}"), True)
    return len(gone)


def compact_states(spark: SparkSession, state_path: str, keys: Sequence[str], keep: int = 1) -> int:
    return compact(spark, state_path, lambda states: moments.merge(states, keys), keep)


def compact_windows(spark: SparkSession, state_path: str, keys: Sequence[str], keep: int = 1) -> int:
    def merge(states: DataFrame) -> DataFrame:
        return states.groupBy("start", "end", *keys).agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.sum("total").alias("total"), F.max("last").alias("last"))

    return compact(spark, state_path, merge, keep)


def merged_states(spark: SparkSession, state_path: str, keys: Sequence[str]) -> DataFrame:
    """One state per key of all batches stored so far."""
    return moments.merge(stored_states(spark, state_path), keys)


def store_windows(stream: DataFrame, time: str, keys: Sequence[str], value: str, width: str, state_path: str, checkpoint_path: str):
    """Like `store_states` per event-time window: a batch may hold rows of any time, and none is too late."""

    def state(batch: DataFrame) -> DataFrame:
        return (
            batch.groupBy(F.window(time, width).alias("w"), *keys)
            .agg(F.count("*").alias("n"), F.count(value).alias("held"), F.sum(value).alias("total"), F.max(time).alias("last"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "held", "total", "last")
        )

    return _store(stream, state, state_path, checkpoint_path)


def merged_windows(spark: SparkSession, state_path: str, keys: Sequence[str]) -> DataFrame:
    """Count, mean and last time of every window of all batches stored so far, the latest window too."""
    states = stored_states(spark, state_path)
    return states.groupBy("start", "end", *keys).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum("total"), F.sum("held").cast("double")).alias("mean"),
        F.max("last").alias("last"),
    )


def windowed(stream: DataFrame, time: str, keys: Sequence[str], value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and mean per event-time window, for unbounded streams in about the order of time.

    Rows later than the watermark are dropped by the stream, and the last
    window stays open. For tables whose files are in no order see `store_windows`.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        stream.withWatermark(time, late)
        .groupBy(window.alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean")
    )


def run_to_table(result: DataFrame, path: str, checkpoint_path: str) -> None:
    """Appends the finished windows of what has arrived to Parquet files."""
    query = (
        result.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
