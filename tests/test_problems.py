"""The data-processing problems against brute force on small inputs with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions.identity import epoch_ms, snake_key
from rillflow.operators import delivery, features, implausible, lateness, sessions

START = datetime(2025, 1, 6, tzinfo=timezone.utc)
ACTIVITY = "delivery_id bigint, batch_id bigint, id string, user_id bigint, activity_type string, timestamp timestamp, rf_key string, ms string, kind int"
UUID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def spelled(rng: random.Random, u: str) -> str:
    return rng.choice([u, u.upper(), u.replace("-", ""), "{" + u + "}", f" {u} ", "urn:uuid:" + u])


def activities(seed: int, n: int = 600) -> list[tuple]:
    rng = random.Random(seed)
    ids = [f"{rng.getrandbits(128):032x}" for _ in range(n // 2)]
    ids = [f"{i[:8]}-{i[8:12]}-{i[12:16]}-{i[16:20]}-{i[20:]}" for i in ids]
    rows = []
    for d in range(n):
        ident = None if rng.random() < 0.05 else "not a uuid" if rng.random() < 0.02 else spelled(rng, rng.choice(ids))
        user = None if rng.random() < 0.05 else 7 if rng.random() < 0.4 else rng.randrange(20)
        kind = None if rng.random() < 0.05 else rng.choice(["view", "View", "log-out", "LOG_OUT", " search ", "unheard"])
        at = None if rng.random() < 0.05 else START + timedelta(minutes=rng.choice([0, 29, 30, 31, rng.randrange(5000)]))
        rows.append((d, d % 5, ident, user, kind, at, "x", "y", 3))
    return rows


def plain_id(ident: str | None, d: int) -> str:
    if ident is None:
        return f"row {d}"
    low = ident.strip().lower().removeprefix("urn:uuid:").translate(str.maketrans("", "", "{}-"))
    return low if len(low) == 32 else "?" + ident.strip().lower()


def messages(rows: list[tuple]) -> list[tuple]:
    first: dict[str, tuple] = {}
    for r in sorted(rows):
        first.setdefault(plain_id(r[2], r[0]), r)
    return list(first.values())


def snake(kind: str | None) -> str | None:
    return None if kind is None else kind.strip().lower().replace("-", "_").replace(" ", "_")


def ms(at: datetime) -> int:
    return int(at.timestamp() * 1000)


@pytest.mark.parametrize("seed,n", [(1, 600), (2, 0)])
def test_wide_features(spark, seed, n):
    rows, types = activities(seed, n), ["log_out", "search", "view"]
    df = spark.createDataFrame(rows, ACTIVITY)
    key = delivery.activity_key(F.col("id"), F.col("delivery_id"))
    once = delivery.collapse(df, key, "delivery_id", [F.col("user_id"), snake_key(F.col("activity_type")).alias("kind"), epoch_ms(F.col("timestamp")).alias("ms")])
    got = {r.user_id: r.asDict() for r in features.wide_features(once, types, "user_id", F.col("kind"), F.col("ms")).collect()}
    want: dict[int, dict] = {}
    for _, _, _, user, kind, at, *_ in messages(rows):
        if user is None:
            continue
        w = want.setdefault(user, {"user_id": user, "n_messages": 0, "n_types": 0, "first_ms": None, "last_ms": None} | {f"{p}_{t}": 0 if p == "n" else None for t in types for p in ("n", "first_ms", "last_ms")})
        w["n_messages"] += 1
        names = [""] + ([f"_{snake(kind)}"] if snake(kind) in types else [])
        if len(names) > 1:
            w["n_types"] += w[f"n{names[1]}"] == 0
            w[f"n{names[1]}"] += 1
        for s in names if at is not None else ():
            w[f"first_ms{s}"] = ms(at) if w[f"first_ms{s}"] is None else min(w[f"first_ms{s}"], ms(at))
            w[f"last_ms{s}"] = ms(at) if w[f"last_ms{s}"] is None else max(w[f"last_ms{s}"], ms(at))
    assert got == want


def test_wide_features_of_many_entities_and_no_types(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("user_id"), F.lit(None).cast("string").alias("kind"), F.col("id").alias("ms"))
    wide = features.wide_features(df, [], "user_id", F.col("kind"), F.col("ms"))
    assert wide.count() == 5000 and wide.agg(F.sum("n_messages")).first()[0] == 20_000


@pytest.mark.parametrize("n", [600, 0])
def test_superfluous_deliveries(spark, n):
    rows = activities(3, n)
    df = spark.createDataFrame(rows, ACTIVITY)
    key = delivery.activity_key(F.col("id"), F.col("delivery_id"))
    got = {r[0] for r in delivery.superfluous(df, key, "delivery_id", "batch_id").collect()}
    kept = {r[0] for r in messages(rows)}
    assert got == {r[0] for r in rows} - kept
    assert {r.delivery_id for r in delivery.kept_rows(df, key, "delivery_id", "batch_id").collect()} == kept


def test_chunk_keys_ignore_case_and_blanks_of_streams(spark):
    rows = [(1, "S-1", 5), (2, " s-1 ", 5), (3, "s-1", 6), (4, None, 5), (5, None, 5), (6, "s-1", None), (7, "s-1", None)]
    df = spark.createDataFrame(rows, "delivery_id bigint, stream_id string, sequence_number bigint").withColumn("batch_id", F.lit(None).cast("bigint"))
    key = delivery.chunk_key(F.col("stream_id"), F.col("sequence_number"), F.col("delivery_id"))
    assert [r[0] for r in delivery.superfluous(df, key, "delivery_id", "batch_id").collect()] == [2]


def test_upsert_is_idempotent_and_compaction_merges(spark):
    batch = spark.createDataFrame([("a", 3), ("b", 2), ("a", 1)], f"{delivery.KEY} string, {delivery.VERSION} bigint")
    later = spark.createDataFrame([("b", 1), ("c", 9)], batch.schema)
    store = delivery.RunStore(spark, 4).upsert(batch).upsert(later)
    once = sorted(map(tuple, store.compacted().collect()))
    assert once == [("a", 1), ("b", 1), ("c", 9)]
    assert sorted(map(tuple, store.upsert(batch).upsert(later).compact().compacted().collect())) == once


def test_compaction_needs_no_shuffle(spark):
    batch = spark.range(1000).select(F.col("id").cast("string").alias(delivery.KEY), F.col("id").alias(delivery.VERSION))
    plan = delivery.RunStore(spark, 4).upsert(batch).upsert(batch).compacted()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def brute_sessions(events: list[tuple[int | None, int | None, str | None]], gap: int) -> dict[tuple, Counter]:
    by_user = defaultdict(list)
    for user, at, kind in events:
        if user is not None and at is not None:
            by_user[user].append((at, kind or ""))
    out = {}
    for user, own in by_user.items():
        own.sort()
        held: list = []
        for at, kind in own:
            if held and at - held[-1][0] > gap:
                out[user, held[0][0], held[-1][0]] = Counter(k for _, k in held)
                held = []
            held.append((at, kind))
        out[user, held[0][0], held[-1][0]] = Counter(k for _, k in held)
    return out


@pytest.mark.parametrize("seed,block", [(1, 10_000), (2, 1000), (3, 10**9)])
def test_sessions(spark, seed, block):
    rng, gap = random.Random(seed), 1000
    events = [(rng.choice([None, 1, 1, 1, 2, 3]), None if rng.random() < 0.05 else rng.choice([0, 1000, 2000, 2001, -5, rng.randrange(60_000)]), rng.choice([None, "a", "b"])) for _ in range(500)]
    df = spark.createDataFrame(events, "user_id bigint, ms bigint, activity_type string").withColumns({"block": F.lit("x"), "n": F.lit("y"), "upto": F.lit(1)})
    want = brute_sessions(events, gap)
    found = sessions.sessions(df, gap, block).collect()
    assert {(r.user_id, r.session_start_ms, r.session_end_ms): r.n_events for r in found} == {k: sum(v.values()) for k, v in want.items()}
    assert all(r.duration_ms == r.session_end_ms - r.session_start_ms for r in found)
    lean = sessions.sessions(df, gap, block, counts=False).collect()
    assert {(r.user_id, r.session_start_ms, r.session_end_ms) for r in lean} == set(want)
    number = {(r.user_id, r.session_no): (r.user_id, r.session_start_ms, r.session_end_ms) for r in found}
    types = defaultdict(Counter)
    for r in sessions.session_type_counts(df, gap, block).collect():
        types[number[r.user_id, r.session_no]][r.activity_type or ""] += r.n_activities
    assert types == want


def test_sessions_of_nothing_and_wrong_block(spark):
    none = spark.createDataFrame([], "user_id bigint, ms bigint, activity_type string")
    assert sessions.sessions(none).count() == 0 and sessions.session_type_counts(none).count() == 0
    with pytest.raises(ValueError):
        sessions.sessions(none, gap_ms=10, block_ms=5)


CONFIG = [("tumbling", 100, 100, 30, 20), ("sliding", 100, 40, 30, 20), ("silent", 100, 100, 0, 0)]


def brute_lateness(rows, config):
    conf = {c[0]: c[1:] for c in config}
    high: dict = {}
    late, counts = set(), defaultdict(set)
    for seq, stream, event, at in sorted(rows):
        if stream not in conf:
            continue
        size, slide, delay, grace = conf[stream]
        mark = high[stream] - delay if stream in high else None
        if at is not None:
            last = at // slide * slide
            if mark is not None and mark >= last + size + grace:
                late.add(seq)
            start = last
            while at < start + size:
                if mark is None or mark < start + size + grace:
                    counts[stream, start].add(event if event is not None else ("row", seq))
                start -= slide
            high[stream] = max(high.get(stream, at), at)
    return late, {k: len(v) for k, v in counts.items()}


@pytest.mark.parametrize("seed,segment", [(1, 7), (2, 50), (3, 10**6)])
def test_lateness_and_counts(spark, seed, segment):
    rng = random.Random(seed)
    rows = []
    for seq in range(400):
        at = None if rng.random() < 0.05 else seq * 3 - rng.choice([0, 0, 5, 60, 200, 600])
        rows.append((seq, rng.choice(["tumbling", "sliding", "unconfigured", None]), None if rng.random() < 0.03 else rng.randrange(300), at))
    # Repeats of an event have its time.
    first: dict = {}
    rows = [(s, n, e, first.setdefault((n, e), a) if e is not None else a) for s, n, e, a in rows]
    df = spark.createDataFrame(rows, "seq bigint, stream_name string, event_id bigint, ms bigint").withColumns({"source": F.lit("x"), "window_size": F.lit("y"), "watermark": F.lit(0)})
    conf = spark.createDataFrame(CONFIG, "stream_name string, window_size bigint, slide_interval bigint, watermark_delay bigint, allowed_lateness bigint")
    late, counts = brute_lateness(rows, CONFIG)
    assert {r.seq for r in lateness.too_late(df, conf, segment).collect()} == late
    parts = lateness.portions(df, 4, segment)
    assert sorted(r.seq for p in parts for r in p.collect()) == [r[0] for r in rows]
    merged = lateness.merged_registers([*reversed(parts), parts[0]], segment)
    states = [lateness.counters(p, conf, merged, segment) for p in parts]

    def counted(state):
        return {(r.stream_name, r.window_start_ms): r.n_events for r in lateness.totals(state).collect()}

    # Events are repeated across portions; the order of portions and their repetition don't matter.
    for order in (states, [*reversed(states), states[0], states[-1]]):
        assert counted(lateness.merge_counters(order)) == counts
    # What no counter holds is too late.
    held = {r.seq for p in parts for r in lateness.window_admissions(p, conf, merged, segment).select("seq").distinct().collect()}
    dated = {s for s, n, _, at in rows if n in ("tumbling", "sliding") and at is not None}
    assert dated - held == late == {r.seq for p in parts for r in lateness.too_late(p, conf, segment, merged).collect()}
    # Closed windows keep their sums, whatever portions come again, and need one row each.
    final = lateness.closed(lateness.merge_counters(states), conf, merged)
    assert counted(lateness.merge_counters([states[0], final, states[-1]])) == counts
    known = {r.stream_name: r.n for r in final.groupBy("stream_name").agg(F.count(F.when(F.col("source").isNotNull(), 1)).alias("n")).collect()}
    assert final.count() < sum(counts.values()) and all(n < 100 for n in known.values())


def test_registers_merge_by_greatest_version(spark):
    schema = "stream_name string, source bigint, version bigint, high bigint"
    old, new = spark.createDataFrame([("s", 1, 5, 3), ("s", 2, 9, 2), (None, 1, 1, 1)], schema), spark.createDataFrame([("s", 1, 8, 6)], schema)
    for order in ([old, new], [new, old], [new, new, old]):
        merged = {(r.stream_name, r.source): r.high for r in lateness.merge_states(order, ["stream_name"], "high").collect()}
        assert merged == {("s", 1): 6, ("s", 2): 2, (None, 1): 1}


def test_lateness_of_nothing(spark):
    none = spark.createDataFrame([], "seq bigint, stream_name string, event_id bigint, ms bigint")
    conf = spark.createDataFrame(CONFIG, "stream_name string, window_size bigint, slide_interval bigint, watermark_delay bigint, allowed_lateness bigint")
    assert lateness.too_late(none, conf).count() == 0 and len(lateness.portions(none, 4)) == 1


def wave(rng: np.random.Generator, n: int, level: float, noise: float) -> np.ndarray:
    return level + level * 0.2 * np.sin(np.arange(n) / 40) + rng.normal(0, noise, n)


KIND = implausible


def test_spikes_are_found_and_changes_are_not():
    rng = np.random.default_rng(5)
    x = wave(rng, 600, 50, 1.0)
    x[300:] += 25  # a lasting change
    x[100], x[200:203], x[400] = 95, (90, 5, 92), 2
    found = np.flatnonzero(implausible.judge(x, 0, 200, False))
    assert found.tolist() == [100, 200, 201, 202, 400]


def test_ramps_with_resets_are_normal():
    rng = np.random.default_rng(6)
    x = 30 + (np.arange(500) % 45) + rng.normal(0, 0.6, 500)
    assert not implausible.judge(x, 0, 100, False).any()


def test_stuck_stretches_from_their_second_reading():
    rng = np.random.default_rng(7)
    x = wave(rng, 300, 50, 1.0)
    x[120:140] = x[120] + rng.choice([-0.01, 0, 0.01], 20)
    x[200:215] = 0.0  # falls to nothing: the first reading is implausible by itself
    kind = implausible.judge(np.round(x, 2), 0, 100, False)
    assert np.flatnonzero(kind == KIND.STUCK).tolist() == [*range(121, 140), *range(201, 215)]
    assert np.flatnonzero(kind == KIND.SPIKE).tolist() == [200]


def test_resting_series_are_not_stuck_and_small_moves_no_spikes():
    rng = np.random.default_rng(8)
    x = np.where(rng.random(400) < 0.2, rng.uniform(0, 0.003, 400), 0.0)
    x[150] = 0.6
    assert np.flatnonzero(implausible.judge(np.round(x, 4), 0, 1, False)).tolist() == [150]


def test_counts_must_be_whole_and_within_bounds():
    rng = np.random.default_rng(9)
    x = rng.poisson(3, 200).astype(float)
    x[20], x[40], x[60], x[80], x[100] = 2.5, -1, np.inf, 1e9, 400
    kind = implausible.judge(x, 0, 1e6, True)
    assert {int(i): int(kind[i]) for i in np.flatnonzero(kind)} == {20: 3, 40: 3, 60: 3, 80: 3, 100: 1}


@pytest.mark.parametrize("x", [[], [1.0], [5.0] * 50, [0.0] * 8, [np.nan, np.inf]])
def test_short_constant_and_odd_series(x):
    kind = implausible.judge(np.array(x, dtype=float), 0, 100, False)
    assert all(k == KIND.IMPOSSIBLE for k, v in zip(kind, x, strict=True) if not np.isfinite(v))
    assert not any(k for k, v in zip(kind, x, strict=True) if np.isfinite(v))


METRICS = "metric_id bigint, service string, metric_type string, value double, timestamp timestamp, source string, block int, kind int, reason string"
LIMITS = "metric_type string, unit string, physical_min double, physical_max double, is_count boolean"


@pytest.mark.parametrize("block,halo", [(1024, 64), (64, 64), (100, 70)])
def test_implausible_rows(spark, block, halo):
    rng = np.random.default_rng(10)
    x = wave(rng, 500, 50, 1.0)
    x[77], x[250:252] = 120, (5, 110)
    rows = [(i, ["svc", " SVC ", "Svc"][i % 3], "cpu", float(v), START + timedelta(minutes=int(i)), "x", 1, 2, "y") for i, v in enumerate(x)]
    rows += [(1000 + i, "svc", "cpu", float(x[i]), START + timedelta(minutes=i), "x", 1, 2, "y") for i in (77, 78)]  # reported twice
    rows += [(2000, None, "cpu", 999.0, START, "x", 1, 2, "y"), (2001, "svc", "cpu", None, START, "x", 1, 2, "y"), (2002, "svc", "cpu", float("nan"), START, "x", 1, 2, "y"), (2003, "svc", "cpu", 999.0, None, "x", 1, 2, "y"), (2004, "svc", None, 1.0, START, "x", 1, 2, "y")]
    rows += [(3000 + i, "other", "unbounded", 1e12, START + timedelta(minutes=i), "x", 1, 2, "y") for i in range(3)]
    rng2 = random.Random(1)
    rng2.shuffle(rows)
    limits = spark.createDataFrame([("cpu", "percent", 0.0, 115.0, False)], LIMITS)
    found = {r.metric_id: r.reason for r in implausible.implausible(spark.createDataFrame(rows, METRICS), limits, block, halo).collect()}
    assert found == {77: "impossible", 1077: "impossible", 250: "spike", 251: "spike"}


@pytest.mark.parametrize("at", [[0], [1], [0, 1], [198], [199], [198, 199], [0, 100, 199]])
def test_spikes_at_the_ends_of_a_series(at):
    x = wave(np.random.default_rng(15), 200, 50, 1.0)
    x[at] = 120 + 5 * np.arange(len(at))
    assert np.flatnonzero(implausible.judge(x, 0, 200, False)).tolist() == at


def test_ends_of_ramps_and_levels_are_no_spikes():
    rng = np.random.default_rng(16)
    ramp = 30 + (np.arange(43, 500) % 45) + rng.normal(0, 0.6, 457)  # ends two readings after its start
    assert not implausible.judge(ramp, 0, 100, False).any()


def test_chains_of_spikes_are_taken_out_to_the_last():
    x = np.random.default_rng(17).poisson(3, 400).astype(float)
    at = np.arange(100, 100 + 7 * 12, 7)
    x[at] = np.floor(900 * 5.0 ** np.arange(12))  # on the scale of counts, each stands beside one over twice as great
    assert np.flatnonzero(implausible.judge(x, 0, 1e15, True)).tolist() == at.tolist()


@pytest.mark.parametrize("n,starts", [(128, (20, 80)), (1152, range(40, 1140, 130))])
def test_several_stuck_stretches_do_not_hide_each_other(n, starts):
    rng = np.random.default_rng(13)
    x = wave(rng, n, 50, 1.0)
    for a in starts:
        x[a : a + 25] = x[a]
    assert np.flatnonzero(implausible.judge(x, 0, 100, False) == KIND.STUCK).tolist() == [i for a in starts for i in range(a + 1, a + 25)]


def test_values_a_series_rests_at_are_normal_beside_stuck_stretches():
    rng = np.random.default_rng(14)
    x = wave(rng, 1000, 50, 1.0)
    for a in range(0, 1000, 100):
        x[a : a + 30] = 20.0  # idle
    x[560:590] = 47.5
    assert np.flatnonzero(implausible.judge(x, 0, 100, False) == KIND.STUCK).tolist() == list(range(561, 590))
    steps = np.repeat(wave(rng, 40, 50, 5.0), 25)  # holds each value
    assert not (implausible.judge(steps, 0, 100, False) == KIND.STUCK).any()


def series_rows(x, first_id=0, metric="cpu"):
    return [(first_id + i, "svc", metric, float(v), START + timedelta(minutes=int(i)), "x", 1, 2, "y") for i, v in enumerate(x)]


@pytest.mark.parametrize("jitter", [0.0, 0.01])
def test_stuck_stretches_longer_than_blocks_are_found_whole(spark, jitter):
    rng = np.random.default_rng(11)
    x = wave(rng, 700, 50, 1.0)
    x[150:390] = 48.0 + jitter * rng.choice([-1, 0, 1], 240)  # fills blocks of 64 with halos of 16
    x[300] = 999.0  # an impossible one doesn't end it
    limits = spark.createDataFrame([("cpu", "percent", 0.0, 115.0, False)], LIMITS)
    found = implausible.implausible(spark.createDataFrame(series_rows(x), METRICS), limits, 64, 16).collect()
    assert sorted(r.metric_id for r in found if r.reason == "stuck") == [i for i in range(151, 390) if i != 300]
    assert [r.metric_id for r in found if r.reason == "impossible"] == [300]


def test_series_over_partitions_are_judged_as_whole_ones(spark):
    rng = np.random.default_rng(18)
    rows, want = [], {}
    for i in range(30):
        n = 5000 if i == 7 else 5 if i == 8 else 150
        x = np.round(wave(rng, n, 50, 1.0), 3)
        if n > 5:
            x[rng.integers(0, n, n // 60)] = 95.0
            a = int(rng.integers(0, n - 40))
            x[a : a + n // 5] = x[a]
            x[rng.integers(0, n)] = -3.0
        kinds = implausible.judge(x, 0.0, 115.0, False)
        own = [(len(rows) + j, f"svc{i:02d}", "cpu", float(v), START + timedelta(minutes=int(j)), "x", 1, 2, "y") for j, v in enumerate(x)]
        want |= {r[0]: implausible.KINDS[int(k)] for r, k in zip(own, kinds, strict=True) if k}
        rows += own
    rng.shuffle(rows)
    rows = [(int(r[0]), r[1], r[2], float(r[3]), *r[4:6], 1, 2, "y") for r in rows]
    limits = spark.createDataFrame([("cpu", "percent", 0.0, 115.0, False)], LIMITS)
    got = {r.metric_id: r.reason for r in implausible.implausible(spark.createDataFrame(rows, METRICS), limits).collect()}
    assert got == want and {"spike", "stuck", "impossible"} == set(got.values())


def test_medians_of_segments_are_near_numpys():
    rng = np.random.default_rng(19)
    of = np.sort(rng.integers(0, 20, 2000))
    values = np.where(rng.random(2000) < 0.1, 0.0, rng.lognormal(0, 3, 2000))
    got = implausible.medians(values[of != 3], of[of != 3], 21)
    for i in range(21):
        assert got[i] == pytest.approx(np.median(values[of == i]) if i not in (3, 20) else 0.0, rel=0.016)


def test_runs_joined_over_blocks_are_those_of_the_whole_series():
    rng = np.random.default_rng(12)
    for _ in range(200):
        x = np.round(np.cumsum(rng.normal(0, 1, 200)), 1)
        for a in rng.integers(0, 190, 2):
            x[a : a + rng.integers(6, 60)] = x[a]
        a = rng.integers(0, 150)
        x[a : a + 40] = x[a] + 0.004 * np.arange(40)  # leaves its level by small steps
        whole, near = implausible.SeriesRuns(0.03), 0.03
        whole.add(implausible.block_runs(x, np.arange(200), near))
        for size in (1, 3, 7, 50):
            series = implausible.SeriesRuns(near)
            for b in range(0, 200, size):
                series.add(implausible.block_runs(x[b : b + size], np.arange(200)[b : b + size], near))
            assert series.stuck() == whole.stuck() and (series.steps, series.flats) == (whole.steps, whole.flats)
            assert sorted(series.runs) == sorted(whole.runs)


def test_implausible_of_nothing(spark):
    limits = spark.createDataFrame([("cpu", "percent", 0.0, 100.0, False)], LIMITS)
    assert implausible.implausible(spark.createDataFrame([], METRICS), limits).count() == 0
