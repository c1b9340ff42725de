import os

from pyspark.sql import functions as F

from thermalake.plans import streams
from thermalake.streaming import incremental, keyed


def test_repeated_runs_go_on_where_the_last_ended(spark, tmp_path):
    source, state, log = (str(tmp_path / n) for n in ("in", "state", "log"))
    rows = lambda a, b: spark.range(a, b).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    rows(0, 10).write.parquet(source)
    schema = rows(0, 1).schema

    def run():
        incremental.store_states(spark.readStream.schema(schema).parquet(source), ["g"], F.col("v"), state, log).awaitTermination()
        return {r.g: (r.n, r["mean"]) for r in incremental.merged_states(spark, state, ["g"]).collect()}

    assert run() == {0: (5, 4.0), 1: (5, 5.0)}
    assert run() == {0: (5, 4.0), 1: (5, 5.0)}
    rows(10, 20).write.mode("append").parquet(source)
    assert run() == {0: (10, 9.0), 1: (10, 10.0)}


def test_days_are_whole_whatever_the_order_of_the_files(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    rows = spark.range(2000).select(
        (F.col("id") % 3).cast("string").alias("event_type"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 700).alias("ts"),
        F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("value"),
    )
    for i in range(10):  # the latest first
        part = tmp_path / f"part{i}"
        rows.filter(f"ts >= timestamp_seconds({1_700_000_000 + (9 - i) * 140_000}) AND ts < timestamp_seconds({1_700_000_000 + (10 - i) * 140_000})").coalesce(1).write.parquet(str(part))
        folder.mkdir(exist_ok=True)
        file = next(part.glob("*.parquet")).rename(folder / f"{i}.parquet")
        os.utime(file, (1_600_000_000 + i, 1_600_000_000 + i))
    days = rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*"), F.round(F.avg("value"), 5))
    want = sorted(map(tuple, days.collect()))
    last = max(w[0] for w in want)
    assert sum(w[2] for w in want) == 2000
    got = sorted(map(tuple, streams.daily_windows(spark, str(tmp_path)).collect()))
    assert got == [w for w in want if w[0] < last]

    state, log = str(tmp_path / "state"), str(tmp_path / "log")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    incremental.store_windows(stream, "ts", ["event_type"], "value", "1 day", state, log).awaitTermination()
    merged = incremental.merged_windows(spark, state, ["event_type"])
    got = merged.select(F.date_format("start", "yyyy-MM-dd"), "event_type", "n", F.round("mean", 5)).collect()
    assert sorted(map(tuple, got)) == want


def test_compacted_states_count_every_batch_once(spark, tmp_path, monkeypatch):
    source, state, log = (str(tmp_path / n) for n in ("in", "state", "log"))
    rows = spark.range(60).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    for i in range(6):
        rows.filter(f"id >= {i * 10} AND id < {i * 10 + 10}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.store_states(stream, ["g"], F.col("v"), state, log).awaitTermination()
    merged = lambda: {r.g: (r.n, round(r["mean"], 9), round(r.m2, 6)) for r in incremental.merged_states(spark, state, ["g"]).collect()}
    want = {r.g: (r.n, round(r.m, 9), round(r.v, 6)) for r in rows.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("v")).collect()}
    assert merged() == want and len(incremental._batches(spark, state)) == 6
    # cut off after the pointer was replaced, before the folders went: nothing is counted twice
    plain = incremental._batches
    calls = []

    def cut_off(*args):
        calls.append(1)
        if len(calls) == 2:
            raise ConnectionError("the driver is lost")
        return plain(*args)

    monkeypatch.setattr(incremental, "_batches", cut_off)
    try:
        incremental.compact_states(spark, state, ["g"])
    except ConnectionError:
        pass
    monkeypatch.setattr(incremental, "_batches", plain)
    assert len(plain(spark, state)) == 6 and merged() == want
    assert incremental.compact_states(spark, state, ["g"]) == 5 and merged() == want and plain(spark, state) == [5]
    # the last batch is written again, and more rows come
    rows.filter("id >= 50").groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2")).write.mode("overwrite").parquet(f"{state}/batch=5")
    assert merged() == want
    rows.filter("id < 10").write.mode("append").parquet(source)
    incremental.store_states(stream, ["g"], F.col("v"), state, log).awaitTermination()
    assert sum(n for n, *_ in merged().values()) == 70
    incremental.compact_states(spark, state, ["g"])
    assert sum(n for n, *_ in merged().values()) == 70 and len(plain(spark, state)) == 1


def test_keyed_states_equal_the_batch_result_and_idle_keys_close(spark, tmp_path):
    keyed.enable(spark)
    rows = spark.range(90).select(
        F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.5).alias("v"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("t")
    )
    rows = rows.filter("NOT (g <=> 2 AND t > timestamp_seconds(1700001800))")  # this key stops early
    source = str(tmp_path / "in")
    for i in (4, 0, 3, 1, 5, 2):  # in no order of time
        rows.filter(f"t >= timestamp_seconds({1_700_000_000 + i * 900}) AND t < timestamp_seconds({1_700_000_000 + (i + 1) * 900})").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = keyed.latest(keyed.keyed_moments(stream, "g", "v", "t"), "g", str(tmp_path / "a")).collect()
    want = {r.g: r for r in rows.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"), F.max("t").alias("last")).collect()}
    assert len(got) == len(want) == 4
    for r in got:
        w = want[r.g]
        assert r.n == w.n and abs(r["mean"] - w["mean"]) < 1e-9 and abs(r.m2 - w.m2) < 1e-6 * w.m2 and r.last == w.last and not r.closed

    ordered = str(tmp_path / "ordered")
    for i in range(6):
        rows.filter(f"t >= timestamp_seconds({1_700_000_000 + i * 900}) AND t < timestamp_seconds({1_700_000_000 + (i + 1) * 900})").coalesce(1).write.mode("append").parquet(ordered)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(ordered)
    got = {r.g: r for r in keyed.latest(keyed.keyed_moments(stream, "g", "v", "t", idle="20 minutes", late="1 minute"), "g", str(tmp_path / "b")).collect()}
    assert {g for g, r in got.items() if r.closed} == {2} and got[2].n == want[2].n and got[0].n == want[0].n
