"""Moments per key as the state of a stateful operator, with timers that close idle keys.

The state of a key is one row, n, mean and m2, whatever the number of its
events; a batch's own moments are merged into it, so nothing is added row by
row. Needs the RocksDB state store (`enable`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = "n long, mean double, m2 double, last timestamp"


def enable(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """n, mean and m2 of two disjoint parts together."""
    n = a[0] + b[0]
    if not n:
        return 0, 0.0, 0.0
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


class KeyedMoments(StatefulProcessor):
    """State and timer of each key; emits (key, n, mean, m2, last, closed) whenever one changes or is closed."""

    def __init__(self, key: str, idle_ms: int | None, zone: str = "UTC"):
        self.key, self.idle_ms, self.zone = key, idle_ms, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("moments", STATE)
        self.due = handle.getValueState("due", "at long") if self.idle_ms is not None else None

    def _row(self, key, state: tuple, closed: bool) -> pd.DataFrame:
        n, mean, m2, last = state
        return pd.DataFrame({self.key: [key[0]], "n": [n], "mean": [mean if n else None], "m2": [m2 if n else None], "last": [last], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (0, 0.0, 0.0, None)
        moments, last = tuple(held[:3]), held[3]
        for part in rows:
            values = part["value"].dropna()
            if len(values):
                moments = merged(moments, (len(values), float(values.mean()), float(values.var(ddof=0)) * len(values)))
            times = part["time"].dropna()
            if len(times):
                newest = times.max()
                last = newest if last is None or newest > pd.Timestamp(last) else last
        state = (*moments, last)
        self.state.update(state)
        if self.idle_ms is not None and last is not None:
            newest = pd.Timestamp(last)
            at = int((newest if newest.tzinfo else newest.tz_localize(self.zone)).timestamp() * 1000) + self.idle_ms
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            self.due.update((at,))
            self.handle.registerTimer(at)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The key was idle for long enough: its last state goes out, and its place is free."""
        state = tuple(self.state.get())
        self.state.clear()
        self.due.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def keyed_moments(stream: DataFrame, key: str, value: str, time: str, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, n, mean, m2, last, closed): the moments of a key each time that some of its rows arrive, in update mode.

    Null values count nowhere; null keys are one key. Without `idle` no row is
    too late. With it (seconds, as "3600 seconds") a key without events for so
    long, by the watermark `late` behind the newest event, is emitted once more
    as closed and forgotten; rows behind the watermark are dropped by Spark.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key), F.col(value).cast("double").alias("value"), F.col(time).cast("timestamp").alias("time"))
    milliseconds = None
    if idle is not None:
        number, unit = idle.split()
        milliseconds = int(float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)
        rows = rows.withWatermark("time", late)
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=KeyedMoments(key, milliseconds, stream.sparkSession.conf.get("spark.sql.session.timeZone")), outputStructType=f"{key} {kind}, n long, mean double, m2 double, last timestamp, closed boolean", outputMode="Update", timeMode="None" if idle is None else "EventTime"
    )


def latest(stream: DataFrame, key: str, folder: str) -> DataFrame:
    """Runs `keyed_moments` until its source is exhausted and returns each key's last state.

    Every batch is written to a folder of its own, so a batch that is repeated
    after a loss counts once.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch-{number:010d}")

    query = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    names = [c for c in rows.columns if c not in (key, "_batch")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("_batch", "closed")).alias("s"))
    return best.select(key, "s.*")
