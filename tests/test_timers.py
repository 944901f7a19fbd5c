"""Streams with timers against their batch forms, silence, late frames, and going on from a checkpoint."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evalloom.streaming import feeds, sessions, timers

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 12)
FRAMES = "key long, seq int, event string, data string, at timestamp"


def put(spark, folder, rows, n):
    spark.createDataFrame([(k, s, e, d, T0 + dt.timedelta(seconds=t)) for k, s, e, d, t in rows], FRAMES).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


def stream(spark, folder, schema=FRAMES):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def test_answers_end_expire_and_are_forgotten(spark, tmp_path):
    """A second run goes on where the first stopped; a silent stream expires; frames after the end do not count."""
    folder, place = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, folder, [(1, 0, "meta", None, 0), (1, 2, "delta", "b", 1), (1, 1, "delta", "a", 1), (2, 0, "delta", "x", 2), (3, 0, "delta", "long", 0), (4, 0, "stopped", None, 1), (5, 0, "delta", "q", 3)], 0)
    first = timers.answer_stream(stream(spark, folder), "1 second", idle_s=60, linger_s=60)
    assert [tuple(r) for r in feeds.drained(first, "append", place).collect()] == [(4, "stopped", "", 0)]
    put(spark, folder, [(1, 3, "delta", "c", 30), (1, 4, "done", None, 31), (1, 5, "delta", "late", 32), (2, 1, "error", "boom", 31), (4, 1, "delta", "late", 31), (5, 1, "delta", "r", 50)], 1)
    put(spark, folder, [(9, 0, "delta", "z", 200), (1, 6, "delta", "later", 40)], 2)
    again = timers.answer_stream(stream(spark, folder), "1 second", idle_s=60, linger_s=60)
    got = sorted(tuple(r) for r in feeds.drained(again, "append", place).collect())
    assert got == [(1, "done", "abc", 3), (2, "error", "x", 1), (3, "expired", "long", 1), (4, "stopped", "", 0), (5, "expired", "qr", 2)]
    put(spark, folder, [(4, 2, "delta", "new", 300), (4, 3, "done", None, 301)], 3)  # after so long the key is free again
    more = timers.answer_stream(stream(spark, folder), "1 second", idle_s=60, linger_s=60)
    assert (4, "done", "new", 1) in {tuple(r) for r in feeds.drained(more, "append", place).collect()}


def test_the_state_that_is_left_is_that_of_live_keys(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, folder, [(k, 0, "delta", "x", k) for k in range(40)], 0)
    put(spark, folder, [(k, 1, "done", None, 50 + k) for k in range(0, 40, 2)] + [(99, 0, "delta", "y", 2000)], 1)
    put(spark, folder, [(98, 0, "delta", "y", 2001)], 2)
    out = feeds.drained(timers.answer_stream(stream(spark, folder), "1 second", 60, 60), "append", place)
    assert out.count() == 40
    left = spark.read.format("statestore").option("stateVarName", "deltas").load(f"{place}/state")
    assert {r["key"][0] for r in left.collect()} == {98, 99}


def test_answers_equal_the_batch_form(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    event = F.when(F.col("event_id") % 41 == 0, "done").when(F.col("event_id") % 37 == 0, "stopped").when(F.col("event_type") == "view", "meta").otherwise("delta")
    frames = e.select(F.col("user_id").alias("key"), F.col("event_id").cast("int").alias("seq"), event.alias("event"), (F.col("event_id") % 10).cast("string").alias("data"), (F.lit(T0) + F.make_dt_interval(secs=F.col("event_id"))).alias("at"))
    frames.orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "in"))
    got = feeds.drained(timers.answer_stream(stream(spark, str(tmp_path / "in")), idle_s=10**7, linger_s=10**7), "append")
    want = sessions.answers(frames, "key").filter("status <> 'open'").select("key", "status", "answer", "n_deltas")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0


def test_bursts_equal_the_batch_form(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    far = spark.createDataFrame([(-1, dt.datetime(2030, 1, 1))], "key long, at timestamp").select("key", F.col("at").cast("timestamp_ntz").alias("at"))
    e.unionByName(far).orderBy("at").coalesce(1).write.option("maxRecordsPerFile", 250).parquet(str(tmp_path / "in"))
    got = feeds.drained(timers.debounced_stream(stream(spark, str(tmp_path / "in"), "key long, at timestamp_ntz"), 3600), "append")
    want = sessions.debounced(e, "key", "at", 3600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_sessions_setting_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError), feeds.large_state(spark):
        assert spark.conf.get(name) == feeds.ROCKS
        raise RuntimeError
    assert spark.conf.get(name) == before
