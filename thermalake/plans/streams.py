"""Queries over the events table read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.sources.tables import table
from thermalake.streaming import incremental, keyed


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events; written as a pattern, the path may be a file or a folder of files."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def streamed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments per event type from the stored states of all batches."""
    folder = incremental.shared_folder(spark, "moments")
    incremental.store_states(_stream(spark, sf_dir), ["event_type"], F.col("value"), f"{folder}/state", f"{folder}/log").awaitTermination()
    incremental.compact_states(spark, f"{folder}/state", ["event_type"])
    out = incremental.merged_states(spark, f"{folder}/state", ["event_type"])
    return out.select("event_type", "n", F.round("mean", 5).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 5).alias("sd"))


STREAMED_MOMENTS = "SELECT event_type, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS sd FROM events GROUP BY 1"


def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means per day of event time, of the days that ended an hour before the last event, as in the SQL."""
    folder = incremental.shared_folder(spark, "windows")
    incremental.store_windows(_stream(spark, sf_dir), "ts", ["event_type"], "value", "1 day", f"{folder}/state", f"{folder}/log").awaitTermination()
    out = incremental.merged_windows(spark, f"{folder}/state", ["event_type"])
    last = out.agg((F.date_trunc("millisecond", F.max("last")) - F.expr("INTERVAL 1 HOUR")).alias("closed"))
    out = out.join(F.broadcast(last), F.col("end") <= F.col("closed"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 5).alias("mean"))


DAILY_WINDOWS = """SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events
WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"""

def keyed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments per user, kept by a stateful operator while the events arrive file by file."""
    keyed.enable(spark)
    states = keyed.keyed_moments(_stream(spark, sf_dir), "user_id", "value", "ts")
    out = keyed.latest(states, "user_id", incremental.shared_folder(spark, "keyed"))
    return out.select("user_id", "n", F.round("mean", 5).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 5).alias("sd"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


KEYED_STATES = "SELECT user_id, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS sd, strftime(max(ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1"

QUERIES = {
    "keyed_states": (keyed_states, KEYED_STATES),
    "streamed_moments": (streamed_moments, STREAMED_MOMENTS),
    "daily_windows": (daily_windows, DAILY_WINDOWS),
}
