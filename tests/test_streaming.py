"""Streams give the rows that the batch operators give."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rillflow.functions.keys import StateConfig
from rillflow.operators import eventtime, keyed
from rillflow.plans import metrics
from rillflow.streaming import keyed as live

START = datetime(2025, 1, 1, tzinfo=timezone.utc)
SCHEMA = "seq bigint, key string, ts timestamp, v double"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows = [(i, "abc"[i % 3], START + timedelta(seconds=7 * i + (60 if i % 11 == 0 else 0)), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).orderBy("seq")
    for a in range(0, 200, 50):
        df.where(f"seq >= {a} AND seq < {a + 50}").coalesce(1).write.mode("append").parquet(path)
    return df, path


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).parquet(path)


def same(a, b, columns):
    rows = lambda d: sorted(map(tuple, d.select(*columns).collect()))
    assert rows(a) == rows(b)


def test_windows(spark, events, tmp_path):
    batch, path = events
    config = eventtime.TimeWindowConfig()
    ends = {"n": F.count(F.lit(1))}
    out = live.run_available(eventtime.window_by_time(stream(spark, path), "ts", config, ends), str(tmp_path / "o"), str(tmp_path / "c"))
    whole = eventtime.window_by_time(batch, "ts", config, ends)
    done = whole.where(F.col("window_end") <= F.lit(START + timedelta(seconds=7 * 199 - 15)))
    same(out.where(F.col("window_end") <= F.lit(START + timedelta(seconds=7 * 199 - 75))), done.where(F.col("window_end") <= F.lit(START + timedelta(seconds=7 * 199 - 75))), ["window_start", "n"])


@pytest.mark.parametrize("name", ["fold", "session", "deduplicate", "count_windows"])
def test_keyed_state(spark, events, tmp_path, name):
    batch, path = events
    rows = stream(spark, path)
    if name == "fold":
        got = live.fold(rows, ["key"], ["seq"], "v")
        want, columns = keyed.stateful_fold(batch, ["key"], ["seq"], running_sum=F.col("v")), ["seq", "running_sum"]
    elif name == "session":
        got = live.session(rows, ["key"], ["seq"], "ts", 30_000_000)
        want, columns = keyed.stateful_session(batch, ["key"], ["seq"], "ts", 30_000_000), ["seq", "is_new", "session_id"]
    elif name == "deduplicate":
        ordered = batch.withColumn("ts", F.timestamp_seconds(F.col("seq")))
        got = live.deduplicate(rows.withColumn("ts", F.timestamp_seconds(F.col("seq"))), ["key"], ["seq"], "ts", 10_000_000)
        want, columns = keyed.stateful_deduplicate(ordered, ["key"], ["ts", "seq"], "ts", 10_000_000), ["seq"]
    else:
        got = live.count_windows(rows, ["key"], ["seq"], "v", 7)
        want, columns = keyed.stateful_window(batch, ["key"], ["seq"], 7, {"total": F.sum("v")}), ["key", "window_no", "total"]
    same(live.run_available(got, str(tmp_path / "o"), str(tmp_path / "c")), want, columns)


def test_join_and_messages(spark, events, tmp_path):
    batch, path = events
    config = eventtime.TimeJoinConfig(10_000_000, 120_000_000)
    left, right = stream(spark, path).where("key = 'a'"), stream(spark, path).where("key = 'b'")
    out = live.run_available(eventtime.join_with_time_window(left, right, "ts", "ts", config), str(tmp_path / "o"), str(tmp_path / "c"))
    want = eventtime.join_with_time_window(batch.where("key = 'a'"), batch.where("key = 'b'"), "ts", "ts", config)
    same(out, want, ["left.seq", "right.seq"])
    twice = stream(spark, path).withColumn("id", F.col("seq") % 150)
    once = live.run_available(live.deduplicate_messages(twice, ["id"], "ts", "1 hour"), str(tmp_path / "p"), str(tmp_path / "d"))
    assert once.count() == 150


def test_reordering(spark, tmp_path):
    numbers = [0, 2, 1, 1, 5, 6, 7, 8, 9, 3, 4]
    spark.createDataFrame([(i, "s", n) for i, n in enumerate(numbers)], "seq bigint, stream_id string, n bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("seq bigint, stream_id string, n bigint").parquet(str(tmp_path / "in"))
    out = live.run_available(live.reorder(rows, ["stream_id"], ["seq"], "n", 4), str(tmp_path / "o"), str(tmp_path / "c"))
    status = sorted((r.n, r.status) for r in out.collect())
    assert status == [(0, "Ok"), (1, "Duplicate"), (1, "Ok"), (2, "Ok"), (3, "Late"), (4, "Late"), (5, "Gap"), (6, "Ok"), (7, "Ok"), (8, "Ok"), (9, "Ok")]


def test_filtered_throttled_and_patterns(spark, events, tmp_path):
    batch, path = events

    def run(make, name):
        return live.run_available(make(stream(spark, path)), str(tmp_path / f"{name}o"), str(tmp_path / f"{name}c"))

    # Every second row of each key.
    alternate = run(lambda s: live.filtered(s, ["key"], ["seq"], "v", 0, lambda n, _: (n + 1, n % 2 == 0)), "f")
    per_key = {k: [r.seq for r in batch.where(F.col("key") == k).orderBy("seq").collect()] for k in "abc"}
    assert sorted(r.seq for r in alternate.collect()) == sorted(x for own in per_key.values() for x in own[::2])
    dropped = run(lambda s: live.throttled(s, ["key"], ["ts", "seq"], "ts", 2, 100_000_000), "t")
    assert 0 < dropped.count() < batch.count()
    pairs = run(lambda s: live.patterns(s, ["key"], ["seq"], "v", 3, lambda items: f"{items[0]}" if items[0] < items[2] else None), "p")
    values = {k: [r.v for r in batch.where(F.col("key") == k).orderBy("seq").collect()] for k in "abc"}
    want = sorted((k, i // 3, f"{own[i]}") for k, own in values.items() for i in range(0, len(own) - 2, 3) if own[i] < own[i + 2])
    assert sorted((r.key, r.batch_no, r.result) for r in pairs.collect()) == want


def test_state_is_given_up_after_its_time_to_live(spark, tmp_path):
    path = str(tmp_path / "in")
    # Key a stops after three rows; b goes on for an hour, which moves the watermark.
    rows = [(0, "a", START, 1.0), (1, "a", START + timedelta(seconds=1), 2.0), (2, "a", START + timedelta(seconds=2), 4.0)]
    parts = [rows, *([(10 + i, "b", START + timedelta(minutes=10 * i), 1.0)] for i in range(1, 7))]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "10 seconds")
    out = live.run_available(live.grouped(read, ["key"], ["seq"], "v", 2, StateConfig(600, 60)), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in out.where("key = 'a'").collect()) == [("a", 0, 2, 3.0), ("a", 1, 1, 4.0)]


def test_resources_are_watched(spark, events, tmp_path):
    _, path = events
    manager = metrics.ResourceManager()
    listener = metrics.watch(spark, manager)
    try:
        live.run_available(live.deduplicate(stream(spark, path), ["key"], ["ts", "seq"], "ts", 1), str(tmp_path / "o"), str(tmp_path / "c"))
        deadline = time.monotonic() + 20
        while not manager.keys and time.monotonic() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert manager.keys == 3
