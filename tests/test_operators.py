"""Stream operators on small vectors with known results."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rillflow.flow import Flow
from rillflow.operators import combine, eventtime, keyed, results, sequence, timecontrol, transform
from rillflow.sources import builders

START = datetime(2025, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(autouse=True, params=["spread", "small"])
def way(request, monkeypatch):
    """Each operator is tested in the form for large streams and in that for small ones."""
    if request.param == "spread":
        for module in (combine, sequence, timecontrol, transform):
            monkeypatch.setattr(module, "SMALL_BYTES", 0)


def ints(spark, values):
    return builders.from_rows(spark, values, "x int")


def xs(df, column="x", order="seq"):
    return [r[column] for r in df.orderBy(order).collect()]


def timed(spark, seconds, key="k"):
    rows = [(i, key, START + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "seq bigint, key string, ts timestamp")


def test_sources(spark):
    assert builders.empty(spark, "x int").count() == 0
    assert xs(builders.evaluated(spark, lambda: 5, "x int")) == [5]
    fib = builders.unfold(spark, "a, b", "0, 1", "b, a + b", "a < 30", most=50)
    assert xs(fib, "a") == [0, 1, 1, 2, 3, 5, 8, 13, 21, 34]
    assert xs(builders.unfold_with(spark, 1, lambda s: (s, s * 2) if s < 20 else None, "x int", 100)) == [1, 2, 4, 8, 16]
    assert builders.unfold(spark, "a", "0", "a + 1", "seq < 4").count() == 5
    with pytest.raises(Exception):  # noqa: B017, it goes on
        builders.unfold(spark, "a", "0", "a + 1", "true", most=20).collect()
    with pytest.raises(ValueError):
        builders.unfold_with(spark, 1, lambda s: (s, s), "x int", 10)
    assert builders.repeat(spark, F.lit(1), 7).count() == 7
    assert builders.tick(spark, F.lit("t"), "2025-01-01 00:00:00", "2025-01-01 00:01:00", "20 seconds").count() == 4
    assert builders.ticking(spark, F.lit(1)).isStreaming


def test_file_chunks(spark, tmp_path):
    path = tmp_path / "blob"
    data = bytes(range(256)) * 3
    path.write_bytes(data)
    chunks = builders.file_chunks(spark, str(path), "s", 100).orderBy("sequence_number").collect()
    assert b"".join(bytes(c.data) for c in chunks) == data
    assert [c.is_final for c in chunks] == [False] * 7 + [True]
    few = builders.RANGE_BYTES, builders.BATCH_BYTES
    builders.RANGE_BYTES, builders.BATCH_BYTES = 250, 150
    try:
        again = builders.file_chunks(spark, str(path), "s", 100).orderBy("sequence_number").collect()
    finally:
        builders.RANGE_BYTES, builders.BATCH_BYTES = few
    assert again == chunks
    (tmp_path / "none").write_bytes(b"")
    assert builders.file_chunks(spark, str(tmp_path / "none"), "s", 100).count() == 0


def test_slices(spark):
    df = ints(spark, [1, 2, 3, 4, 5])
    assert xs(sequence.take(df, ["seq"], 2)) == [1, 2] and xs(sequence.drop(df, ["seq"], 2)) == [3, 4, 5]
    assert xs(sequence.drop(df, ["seq"], 0)) == [1, 2, 3, 4, 5] and xs(sequence.drop(df, ["seq"], 9)) == []
    below = F.col("x") < 4
    assert xs(sequence.take_while(df, ["seq"], below)) == [1, 2, 3] and xs(sequence.drop_while(df, ["seq"], below)) == [4, 5]
    assert xs(sequence.take_while(df, ["seq"], F.col("x") < 9)) == [1, 2, 3, 4, 5] and xs(sequence.drop_while(df, ["seq"], F.col("x") < 9)) == []
    with_null = ints(spark, [1, None, 2])
    assert xs(sequence.take_while(with_null, ["seq"], F.col("x") > 0)) == [1]


def test_runs(spark):
    df = ints(spark, [1, 1, 2, 2, 3, 3, 2, 1])
    runs = sequence.group_adjacent_by(df, ["seq"], F.col("x") % 2, ["x"]).orderBy("run").collect()
    assert [(r.key, [i.x for i in r["items"]]) for r in runs] == [(1, [1, 1]), (0, [2, 2]), (1, [3, 3]), (0, [2]), (1, [1])]
    assert xs(sequence.distinct_until_changed(df, ["seq"], F.col("x"))) == [1, 2, 3, 2, 1]
    nulls = ints(spark, [None, None, 1, None])
    assert xs(sequence.distinct_until_changed(nulls, ["seq"], F.col("x"))) == [None, 1, None]
    nan = builders.from_rows(spark, [float("nan"), float("nan"), 1.0], "x double")
    assert sequence.distinct_until_changed(nan, ["seq"], F.col("x"), nan_differs=True).count() == 3
    assert sequence.distinct_until_changed(nan, ["seq"], F.col("x")).count() == 2


def test_chunks_and_windows(spark):
    df = ints(spark, [1, 2, 3, 4, 5])
    chunks = sequence.chunk(df, ["seq"], 2, ["x"]).orderBy("chunk_no").collect()
    assert [[i.x for i in c["items"]] for c in chunks] == [[1, 2], [3, 4], [5]]
    assert [c.n for c in sequence.chunk(df, ["seq"], 0, ["x"]).collect()] == [5]
    windows = sequence.sliding_window(df, ["seq"], 3, ["x"]).orderBy("rn").collect()
    assert [[i.x for i in w["items"]] for w in windows] == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert sequence.sliding_window(df, ["seq"], 6, ["x"]).count() == 0 and sequence.sliding_window(df, ["seq"], 0, ["x"]).count() == 0


def test_running_and_total(spark):
    df = ints(spark, [3, 1, 4, 1, 5])
    assert xs(sequence.scan(df, ["seq"], total=F.col("x")), "total") == [3, 4, 8, 9, 14]
    extremes = sequence.running_extremes(df, ["seq"], F.col("x"), block_rows=2)
    assert xs(extremes, "running_min") == [3, 1, 1, 1, 1] and xs(extremes, "running_max") == [3, 3, 4, 4, 5]
    assert sequence.fold(df.limit(0), total=F.sum("x")).first().total is None
    digits = sequence.ordered_fold(df, ["seq"], F.col("x").cast("bigint"), F.lit(0).cast("bigint"), lambda a, x: a * 10 + x)
    assert digits.first().value == 31415
    product = sequence.ordered_fold(df, ["seq"], F.col("x").cast("string"), F.lit(""), lambda a, x: F.concat(a, x), 2, lambda a, x: F.concat(a, x))
    assert product.first().value == "31415"
    with pytest.raises(PySparkException):
        sequence.ordered_fold(df, ["seq"], F.col("x"), F.lit(0), lambda a, x: a + x, block_rows=3).collect()
    assert [r.x for r in sequence.collected(df, ["seq"], 2)] == [3, 1]
    assert sequence.collected_set(df, F.col("x"), 4) == {1, 3, 4, 5}
    with pytest.raises(ValueError):
        sequence.collected_set(df, F.col("x"), 3)


def test_combined_streams(spark):
    a, b, c = ints(spark, [1, 2, 3]), ints(spark, [10]), ints(spark, [100, 200])
    turns = combine.interleave([a, b, c], ["seq"]).orderBy("turn", "src")
    assert [r.x for r in turns.collect()] == [1, 10, 100, 2, 200, 3]
    assert [r.x for r in combine.concat([a, b, c]).orderBy("src", "seq").collect()] == [1, 2, 3, 10, 100, 200]
    pairs = combine.zipped(a, c, ["seq"], ["seq"]).orderBy("rn").collect()
    assert [(p.left.x, p.right.x) for p in pairs] == [(1, 100), (2, 200)]
    assert [r.s for r in combine.zip_with(a, c, ["seq"], ["seq"], s=F.col("left.x") + F.col("right.x")).orderBy("rn").collect()] == [101, 202]
    assert combine.par_join([a, b, c]).count() == combine.either(a.unionByName(b), c).count() == 6
    with pytest.raises(ValueError):
        combine.concat([])


def test_expansion_and_batches(spark):
    df = builders.from_rows(spark, ["a b", "", "c"], "x string")
    words = transform.flat_mapped(df, F.split("x", " "), "w", ["seq"], "pos").orderBy("seq", "pos")
    assert [r.w for r in words.collect()] == ["a", "b", "", "c"]
    nums = ints(spark, range(7))
    sums = transform.batch_processed(nums, [F.col("seq")], 3, lambda c: pd.DataFrame({"s": [c.x.sum()]}), "s long")
    assert sorted(r.s for r in sums.collect()) == [3, 6, 12]
    assert transform.map_parallel(nums, {"y": F.col("x")}, 3).rdd.getNumPartitions() == 3
    pairs = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, "c")], "k int, o int, v string")
    assert sorted(map(tuple, transform.distinct_by(pairs, ["k"], ["o"]).collect())) == [(1, 2, "a"), (2, 9, "c")]


def test_rate_control(spark):
    df = timed(spark, [0, 0.1, 0.2, 5, 5.5])
    emitted = timecontrol.throttle(df, ["seq"], "ts", 1_000_000).orderBy("seq").collect()
    base = int(START.timestamp()) * 1_000_000
    assert [r.emit_us - base for r in emitted] == [0, 1_000_000, 2_000_000, 5_000_000, 6_000_000]
    assert [r.seq for r in timecontrol.debounce(df, ["seq"], "ts", 300_000).orderBy("seq").collect()] == [2, 3, 4]
    samples = timed(spark, [0.001, 0.010, 0.020, 0.110, 0.160, 0.170])
    assert [r.seq for r in timecontrol.sample(samples, ["seq"], "ts", 50_000, base).orderBy("seq").collect()] == [2, 3, 5]
    late = timecontrol.timeout(df, ["seq"], "ts", 2_000_000)
    assert late.where("err_kind = 'Timeout'").count() == 2 and late.count() == 7
    bucket = F.floor(F.unix_micros("ts") / 1_000_000)
    assert [r.seq for r in timecontrol.backpressure(df, ["seq"], bucket, 2, "drop_oldest").orderBy("seq").collect()] == [1, 2, 3, 4]
    assert [r.seq for r in timecontrol.backpressure(df, ["seq"], bucket, 2, "drop_newest").orderBy("seq").collect()] == [0, 1, 3, 4]
    assert timecontrol.backpressure(df, ["seq"], bucket, 3, "error").count() == 5
    with pytest.raises(PySparkException):
        timecontrol.backpressure(df, ["seq"], bucket, 2, "error").collect()
    with pytest.raises(ValueError):
        timecontrol.backpressure(df, ["seq"], bucket, 2, "shrug")
    assert timecontrol.rate_limited(files_per_trigger=2) == {"maxFilesPerTrigger": "2"}


def test_throttle_against_stepping(spark):
    rng = random.Random(2)
    times, now = [], 0.0
    for _ in range(200):
        now += rng.choice([0, 0.1, 0.5, 3])
        times.append(round(now, 3))
    df = timed(spark, times)
    got = [r.emit_us for r in timecontrol.throttle(df, ["seq"], "ts", 700_000).orderBy("seq").collect()]
    last, want = None, []
    for t in times:
        us = int(START.timestamp()) * 1_000_000 + round(t * 1_000_000)
        last = us if last is None else max(us, last + 700_000)
        want.append(last)
    assert got == want


def test_time_windows_and_join(spark):
    df = timed(spark, [0, 30, 59.999, 60, 130])
    windows = eventtime.window_by_time(df, "ts", eventtime.TimeWindowConfig(), {"n": F.count(F.lit(1))}).orderBy("window_start")
    assert [w.n for w in windows.collect()] == [3, 1, 1]
    sliding = eventtime.window_by_time(df, "ts", eventtime.TimeWindowConfig(slide_us=20_000_000), {"n": F.count(F.lit(1))})
    assert sliding.agg(F.sum("n")).first()[0] == 15
    with pytest.raises(ValueError):
        eventtime.TimeWindowConfig(10, 20)
    left = spark.createDataFrame([(1, START), (2, START + timedelta(seconds=100))], "id long, ts timestamp")
    right = spark.createDataFrame([(1, START + timedelta(seconds=30)), (1, START + timedelta(seconds=60)), (2, START + timedelta(seconds=40)), (2, START + timedelta(seconds=39))], "id long, ts timestamp")
    pairs = eventtime.join_with_time_window(left, right, "ts", "ts", eventtime.TimeJoinConfig(), ["id"])
    assert sorted(r.left.id for r in pairs.collect()) == [1, 1, 2]
    keyless = eventtime.join_with_time_window(left, right, "ts", "ts", eventtime.TimeJoinConfig())
    assert keyless.count() == 6
    same = eventtime.join_with_time_window(left, left.unionByName(left), "ts", "ts", eventtime.TimeJoinConfig(), ["id"], dedup_by_timestamps=True)
    assert same.count() == 2


@pytest.mark.parametrize("size,slide,partial", [(3, None, False), (3, 2, False), (3, 2, True), (3, 1, True), (2, 5, False), (1, 1, True), (4, 3, True)])
def test_count_windows_against_stepping(spark, size, slide, partial):
    rng = random.Random(size * 10 + (slide or 0))
    rows = [(i, rng.choice("ab"), i * i) for i in range(rng.randrange(5, 30))] + [(99, "c", 1)]
    df = spark.createDataFrame(rows, "seq bigint, key string, v bigint")
    got = sorted((r.key, r.window_no, r.total) for r in keyed.stateful_window(df, ["key"], ["seq"], size, {"total": F.sum("v")}, slide, partial).collect())
    want = []
    for key in "abc":
        held, number = [], 0
        step = slide if slide and slide < size else size
        fresh = False
        for _, k, v in rows:
            if k != key:
                continue
            held.append(v)
            fresh = True
            if len(held) == size:
                want.append((key, number, sum(held)))
                held, number, fresh = held[step:], number + 1, False
        if partial and held:
            want.append((key, number, sum(held)))
        assert fresh in (True, False)
    assert got == sorted(want)


def test_sessions_patterns_groups(spark):
    df = timed(spark, [0, 5, 20, 20, 40])
    marked = keyed.stateful_session(df, ["key"], ["seq"], "ts", 15_000_000).orderBy("seq").collect()
    assert [r.is_new for r in marked] == [False, False, False, False, True] and [r.session_id for r in marked] == [1, 1, 1, 1, 2]
    items = spark.createDataFrame([(i, "u", c) for i, c in enumerate("abcabxa")], "seq bigint, key string, c string")
    found = keyed.stateful_pattern(items, ["key"], ["seq"], 3, "c", lambda a: F.when(F.array_join(a, "") == "abc", F.lit("hit")))
    assert [(r.batch_no, r.result) for r in found.collect()] == [(0, "hit")]
    groups = keyed.stateful_group_by(items, ["key"], ["seq"], {}, max_size=3).orderBy("group_no").collect()
    assert [g.n_rows for g in groups] == [3, 3, 1]
    change = keyed.stateful_group_by(items, ["c"], ["seq"], {}, emit_on_key_change=True)
    assert change.count() == 7


def test_fraud_filter_keeps_the_large_order(spark):
    rows = [(1, "c1", 100.0), (2, "c1", 500.0), (3, "c1", 1000.0), (4, "c2", 50.0)]
    df = spark.createDataFrame(rows, "seq bigint, key string, amount double")
    out = keyed.stateful_filter(df, ["key"], ["seq"], {"spent": F.sum("amount")}, F.col("spent") > 1000)
    assert [r.seq for r in out.collect()] == [3]


def test_recurrences_against_stepping(spark):
    rng = random.Random(11)
    rows, now = [], 0
    for i in range(400):
        now += rng.choice([0, 1, 2, 7, 30])
        rows.append((i, rng.choice(["a", "a", "b", None]), START + timedelta(seconds=now)))
    df = spark.createDataFrame(rows, "seq bigint, key string, ts timestamp")
    us = lambda t: int(t.timestamp()) * 1_000_000
    last: dict = {}
    want = []
    for seq, key, ts in rows:
        if key not in last or us(ts) - last[key] > 10_000_000:
            want.append(seq)
            last[key] = us(ts)
    assert sorted(r.seq for r in keyed.stateful_deduplicate(df, ["key"], ["ts", "seq"], "ts", 10_000_000).collect()) == want
    state: dict = {}
    over = {}
    for seq, key, ts in rows:
        start, n = state.get(key, (None, 0))
        if start is None or us(ts) - start > 20_000_000:
            start, n = us(ts), 0
        over[seq] = n >= 2
        if over[seq]:
            left = start + 20_000_000 - us(ts)
            start, n = (us(ts) + left if 0 < left < 1_000_000 else us(ts)), 0
        state[key] = (start, n + 1)
    got = {r.seq: r for r in keyed.stateful_throttle(df, ["key"], ["ts", "seq"], "ts", 2, 20_000_000).collect()}
    assert {s: r.throttled for s, r in got.items()} == over
    assert keyed.stateful_throttle(df, ["key"], ["ts", "seq"], "ts", 2, 20_000_000, "drop").where("throttled").count() == 0
    groups: dict = {}
    number = {}
    for seq, key, ts in rows:
        start, n, g = groups.get(key, (None, 0, -1))
        if start is None or us(ts) - start > 15_000_000 or n >= 4:
            start, n, g = us(ts), 0, g + 1
        groups[key] = (start, n + 1, g)
        number[seq] = g
    out = keyed.stateful_group_by_timeout(df, ["key"], ["ts", "seq"], "ts", 15_000_000, 4).collect()
    assert {r.seq: r.group_no for r in out} == number


def test_errors_as_data(spark):
    df = results.attempt(ints(spark, [1, -2, 3]), F.when(F.col("x") > 0, F.col("x")), "Custom", "negative")
    assert xs(results.recover(df, F.lit(0)), "ok") == [1, 0, 3]
    resumed = results.on_error_resume_next(df, F.array(F.lit(7), F.lit(8))).orderBy("seq", "resume_no")
    assert [r.ok for r in resumed.collect()] == [1, 7, 8, 3]
    assert results.collect_ok(df, ["seq"]).first()["values"] == [1, 3]
    assert [e.message for e in results.collect_err(results.map_error(df, "IO", F.lit("worse")), ["seq"]).first()["values"]] == ["worse"]
    assert results.collect_ok(df.limit(0), ["seq"]).first()["values"] == []
    with pytest.raises(ValueError):
        results.error("Nonsense", "x")


def test_retries(spark):
    def factory(number):
        bad = {0: 3, 1: 3, 2: 1, 3: -1}[number]
        return results.attempt(ints(spark, [0, 1, 2, 3]), F.when(F.col("seq") != bad, F.col("x")), "IO", "bad")

    out = results.retry(factory, ["seq"], 3)
    assert [out.where(F.col("attempt") == a).count() for a in range(4)] == [4, 4, 2, 4]
    policy = results.RetryPolicy("exponential", 2, 100, 3)
    delayed = results.retry_with_policy(factory, ["seq"], policy)
    assert sorted({(r.attempt, r.attempt_delay_ms) for r in delayed.collect()}) == [(0, 0.0), (1, 100.0), (2, 300.0)]
    assert results.retry_with_policy(factory, ["seq"], results.RetryPolicy("none")).count() == 4


def test_brackets(spark):
    log = []
    with results.bracket(lambda: log.append("got") or "r", lambda r: log.append("released")) as r:
        log.append(r)
    assert log == ["got", "r", "released"]
    df = results.attempt(ints(spark, [4, -5, 6]), F.when(F.col("x") > 0, F.col("x")), "Custom", "no")
    seen = []
    assert len(results.bracket_case(lambda: 1, lambda _: df, lambda _, c: seen.append(c))) == 3
    results.bracket_case(lambda: 1, lambda _: df, lambda _, c: seen.append(c), strict=True)
    with pytest.raises(RuntimeError):
        results.bracket_case(lambda: 1, lambda _: (_ for _ in ()).throw(RuntimeError()), lambda _, c: seen.append(c))
    assert seen == ["Completed", "Errored", "Errored"]


def test_flow(spark):
    df = timed(spark, [0, 1, 2, 100, 101]).withColumn("x", F.col("seq").cast("int"))
    flow = Flow.of(df, ["seq"], ["key"], "ts")
    assert [r.y for r in flow.map(y=F.col("x") * 2).filter(F.col("y") > 2).take(2).collect()] == [4, 6]
    assert [r.session_id for r in flow.stateful_session(10_000_000).collect()] == [1, 1, 1, 2, 2]
    assert [r.n for r in flow.chunk(2, ["x"]).collect()] == [2, 2, 1]
    assert flow.fold(s=F.sum("x")).first().s == 10
    assert len(flow.interleave(flow).collect()) == 10 and len(flow.zip(flow.drop(3)).collect()) == 2
    seen = []
    flow.skip(1).for_each(lambda r: seen.append(r.x))
    assert seen == [1, 2, 3, 4]
    assert [r.seq for r in flow.stateful_deduplicate(50_000_000).collect()] == [0, 3]
    with pytest.raises(ValueError):
        Flow.of(df, ["nothing"])
    with pytest.raises(ValueError):
        Flow.of(df, ["seq"]).debounce(1)


KEYED = [("a", 1, 3), ("a", 2, None), ("b", 3, 5), (None, 4, 7), ("a", 5, 4), (None, 6, 1), ("b", 7, 5)]


def test_keyed_scans_of_any_function(spark):
    df = spark.createDataFrame(KEYED, "`k.1` string, i bigint, v bigint")
    out = keyed.keyed_scan(df, ["k.1"], ["i"], [F.col("v"), F.col("i")], lambda: [10], lambda s, v, i: ([*s, v], (len(s) + 1, i) if v != 4 else None), "n int, `i 2` bigint")
    assert sorted((r.i, r.n, r["i 2"]) for r in out.collect()) == [(1, 2, 1), (2, 3, 2), (3, 2, 3), (4, 2, 4), (6, 3, 6), (7, 3, 7)]
    best = keyed.keyed_reduce(df, ["k.1"], ["i"], F.col("v"), max, "best bigint")
    assert {r.i: r.best for r in best.collect()} == {1: 3, 2: 3, 3: 5, 4: 7, 5: 4, 6: 7, 7: 5}
    assert keyed.keyed_reduce(df.limit(0), ["k.1"], ["i"], F.col("v"), max, "best bigint").count() == 0


def test_associative_scans_over_partitions(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "hot", "hot", "hot", "x"]), i, None if rng.random() < 0.1 else rng.choice("abc")) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i bigint, v string")
    got = {r.i: r.joined for r in keyed.scan_associative(df, ["k"], ["i"], F.col("v"), lambda a, b: (a + b)[-9:], "joined", "string").collect()}
    held: dict = {}
    for k, i, v in rows:
        held[k] = held.get(k) if v is None else ((held.get(k) or "") + v)[-9:]
        assert got[i] == held[k]
    assert keyed.scan_associative(df.limit(0), [], ["i"], F.col("v"), max, "m", "string").count() == 0


def test_distinct_until_changed_by_any_equality(spark):
    df = spark.createDataFrame(list(enumerate([1, 3, 2, 4, 5, 7, 6, 8])), "i bigint, v bigint")
    parity = keyed.distinct_until_changed_by(df, ["i"], F.col("v"), lambda a, b: a % 2 == b % 2)
    assert xs(parity, "v", "i") == [1, 2, 5, 6]
    assert xs(sequence.distinct_until_changed(df, ["i"], F.col("v") % 2), "v", "i") == [1, 2, 5, 6]
    near = keyed.distinct_until_changed_by(df, ["i"], F.col("v"), lambda last, v: abs(last - v) <= 2)
    assert xs(near, "v", "i") == [1, 4, 7]  # against the last kept, not the one before


def test_advanced_groups_end_by_what_comes_first(spark):
    rows = [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 4, 3), ("a", 5, 4), ("a", 6, 30), ("a", 7, 31)]
    df = spark.createDataFrame([(k, i, START + timedelta(seconds=s)) for k, i, s in rows], "key string, i bigint, ts timestamp")
    ids = {"ids": F.sort_array(F.collect_list("i"))}
    plain = keyed.stateful_group_by_advanced(df, ["key"], ["i"], "ts", ids, 2, 10_000_000)
    assert sorted(r.ids for r in plain.collect()) == [[1, 2], [3, 5], [4], [6, 7]]
    changed = keyed.stateful_group_by_advanced(df, ["key"], ["i"], "ts", ids, 2, 10_000_000, emit_on_key_change=True)
    assert sorted(r.ids for r in changed.collect()) == [[1, 2], [3], [4], [5], [6, 7]]
    assert sorted(r.n_rows for r in keyed.stateful_group_by_advanced(df, ["key"], ["i"], "ts", {}).collect()) == [1, 6]


def test_spread_forms_of_a_hot_key_with_nulls(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, "hot", "hot", "hot", "x"]), i, START + timedelta(seconds=10 * i + rng.choice([0, 0, 60])), rng.choice("ab"), "u") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, ts timestamp, v string, rn string")

    def same(a, b):
        columns = sorted(a.columns)
        assert sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))

    flow = Flow.of(df.drop("rn"), ["i"], ["k"], "ts")
    same(flow.stateful_session(30_000_000).df, flow.stateful_session(30_000_000, spread=True).df)
    n = {"n": F.count("v")}
    same(flow.stateful_window(7, 3, True, **n), flow.stateful_window(7, 3, True, spread=True, **n))
    same(flow.stateful_group_by(7, **n), flow.stateful_group_by(7, spread=True, **n))
    aba = lambda items: F.when(F.array_join(items, "") == "aba", F.lit("yes"))
    same(flow.stateful_pattern(3, "v", aba), flow.stateful_pattern(3, "v", aba, spread=True))
    changed = [sequence.distinct_until_changed(df.drop("rn"), ["i"], F.col("v"), ["k"], spread=s) for s in (False, True)]
    same(*changed)


def test_windows_corrected_by_late_rows_until_a_cut_off(spark):
    # Windows of 10 s, delay 5 s, lateness 5 s: the first takes rows until the greatest time before them reaches 20 s.
    at = [1, 12, 3, 19, 4, 20, 5, None, 21]
    df = spark.createDataFrame([(i, None if s is None else START + timedelta(seconds=s), "x") for i, s in enumerate(at)], "i bigint, ts timestamp, source string")
    config = eventtime.TimeWindowConfig(10_000_000, 10_000_000, 5_000_000, 5_000_000)
    out = eventtime.window_by_arrival(df, "i", "ts", config, {"ids": F.sort_array(F.collect_list("i"))}, by=["source"])
    assert [r.ids for r in out.orderBy("window_start").collect()] == [[0, 2, 4], [1, 3], [5, 8]]
    with pytest.raises(ValueError):
        eventtime.window_by_arrival(df, "i", "ts", eventtime.TimeWindowConfig(10, 10), {})
