"""Implausible readings in measured series: spikes, stuck stretches and impossible values.

Readings are range-partitioned by (source, kind of measurement, time, value) and sorted, so that a series, however large, is
spread over neighbouring partitions. A series that lies inside a partition is judged as the partition is read. Of a series
that reaches a partition's ends, and so may go on in the next, blocks of ``block`` readings are written with ``halo`` readings
of their neighbours on both sides; what is measured of the whole series (robust deviations, the usual step) is added up
from counts over its blocks, flat runs that reach their borders are joined in order, and the blocks are judged by that. There
are two such series for each partition at most. Of a series:

1. bounds and wholeness find impossible readings, which are left out of what follows;
2. runs of any length in which the first difference is zero, or all but zero, in a series that normally changes at every
   reading, are stuck stretches, from their second reading on (see ``stuck``);
3. wavelet details beyond a multiple of their robust deviation over the series give candidates, which are spikes if they lie
   beyond what both sides show (see ``spikes``).

Defined cases: null and NaN values and rows without source or time are no readings; infinite values are impossible;
equal times of a series are one reading if their values are equal too (all rows are flagged alike) and are taken in the
order of values otherwise; series of fewer than LEAST readings are only held against bounds; bounds that are null
or missing bind nothing; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.identity import label_key
from rillflow.operators.spikes import FIRST, SECOND, SPIKE_LIMIT, Batch, bucket_of, first_measures, medians, scores, second_measures, value_of
from rillflow.operators.stuck import STUCK_LENGTH, STUCK_SHARE, BlockRuns, Piece, SeriesRuns, block_runs
from rillflow.plans.ordering import changes
from rillflow.plans.sizing import written_if_small
from rillflow.plans.storage import materialize, shuffle_width

BLOCK, HALO = 1024, 64
FINE, SPIKE, STUCK, IMPOSSIBLE = 0, 1, 2, 3
KINDS = {SPIKE: "spike", STUCK: "stuck", IMPOSSIBLE: "impossible"}
#: More kinds of measurement than this have no bounds that tasks can hold.
MOST_LIMITS = 50_000
#: Readings judged at once.
AT_ONCE = 1 << 16
#: Partitions looked back and ahead for a halo; a share of a series in one may be shorter than that.
PARTS_NEAR = 8

Limits = dict[str, tuple[float, float, bool]]
Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def is_possible(x: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, whole: np.ndarray | bool) -> np.ndarray:
    return np.isfinite(x) & (x >= low) & (x <= high) & (np.logical_not(whole) | (x == np.floor(x)))


def judge(x: np.ndarray, low: float, high: float, whole: bool) -> np.ndarray:
    """The kind of each reading of one series in order of time."""
    return judge_series(x, np.zeros(len(x), dtype=np.int64), np.array([low], dtype=float), np.array([high], dtype=float), np.array([whole], dtype=bool))


def judge_series(x: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The kind of each reading of whole series that follow each other; of numbers the series from 0."""
    n = len(whole)
    kind = np.full(len(x), FINE, dtype=np.int8)
    ok = is_possible(x, low[of], high[of], whole[of])
    kind[~ok] = IMPOSSIBLE
    possible = np.flatnonzero(ok)
    batch = Batch(x[possible], np.arange(len(x))[possible], of[possible], np.ones(len(possible), dtype=bool), whole)
    first = np.array([medians(v, s, n) for v, s in first_measures(batch)])
    held = _stuck_of_series(batch, near_of(first[0], whole))
    kind[possible[held]] = STUCK
    # The first reading of a stretch is judged by itself; the others aren't there, but their time passes.
    free = batch.keep(~held)
    second = np.array([medians(v, s, n) for v, s in second_measures(free, first)])
    found = scores(free, first, second, np.bincount(free.of, minlength=n)) > SPIKE_LIMIT
    kind[free.at[found]] = SPIKE
    return kind


def near_of(step: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The step up to which a reading counts as staying the same."""
    return np.where(whole, 0.0, STUCK_SHARE * step)


def _stuck_of_series(batch: Batch, near: np.ndarray) -> np.ndarray:
    """Which readings of whole series are stuck, given the steps up to which they stay the same."""
    held = np.zeros(len(batch.x), dtype=bool)
    if not len(held):
        return held
    flat = np.zeros(len(batch.x), dtype=bool)
    flat[1:] = (batch.of[1:] == batch.of[:-1]) & (np.abs(np.diff(batch.x)) <= near[batch.of[1:]])
    ends = np.flatnonzero(np.diff(np.concatenate([[0], flat, [0]])))
    long = ends[0::2][ends[1::2] - ends[0::2] >= STUCK_LENGTH - 1]
    begin, last = batch.ends()
    for i in np.unique(batch.of[long]):  # few series have any
        a = np.searchsorted(batch.of, i)
        x = batch.x[a : last[a] + 1]
        series = SeriesRuns(float(near[i]))
        series.add(block_runs(x, np.arange(len(x)), float(near[i])))
        for first, end in series.stuck():
            held[a + first + 1 : a + end + 1] = True
    return held


SERIES = ["source", "metric_type"]
ROW = (
    "metric_id bigint, kind byte, source string, metric_type string, part int, number bigint, begin bigint, lead bigint, own bigint, is_last boolean, "
    "value array<double>, ids array<bigint>, copies array<bigint>, share bigint, head array<double>, tail array<double>"
)
BLOCKS = pa.schema({
    "metric_id": pa.int64(), "kind": pa.int8(), "source": pa.string(), "metric_type": pa.string(), "part": pa.int32(), "number": pa.int64(), "begin": pa.int64(),
    "lead": pa.int64(), "own": pa.int64(), "is_last": pa.bool_(), "value": pa.list_(pa.float64()), "ids": pa.list_(pa.int64()), "copies": pa.list_(pa.int64()),
    "share": pa.int64(), "head": pa.list_(pa.float64()), "tail": pa.list_(pa.float64()),
})


def implausible(metrics: DataFrame, kinds: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """metrics(metric_id, service, metric_type, value, timestamp) -> (metric_id, reason) of the implausible rows."""
    limits = _limits(kinds)
    rows = metrics.select(
        "metric_id", label_key(F.col("service")).alias("source"), "metric_type", "value", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us")
    ).where("source IS NOT NULL AND metric_type IS NOT NULL AND us IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    order = [*SERIES, "us", "value"]
    spread = rows.repartitionByRange(shuffle_width(metrics), *order).sortWithinPartitions(*order, "metric_id").withColumn("part", F.spark_partition_id())
    read = materialize(spread.mapInArrow(_reader(limits, block, halo), ROW), "series")
    inside = read.where("kind IS NOT NULL").select("metric_id", "kind")
    found = inside.unionByName(_judged_over_partitions(read.where("kind IS NULL").drop("metric_id", "kind"), limits, block, halo))
    named = F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(k).cast("byte"), F.lit(v))))
    return found.select("metric_id", named[F.col("kind")].alias("reason"))


def _limits(kinds: DataFrame) -> Limits:
    known = kinds.select("metric_type", "physical_min", "physical_max", "is_count").where("metric_type IS NOT NULL").limit(MOST_LIMITS + 1).collect()
    if len(known) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} kinds of measurement")
    return {r[0]: (-np.inf if r[1] is None else r[1], np.inf if r[2] is None else r[2], bool(r[3])) for r in known}


def _bounds(limits: Limits, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high, whole = zip(*(limits.get(n, (-np.inf, np.inf, False)) for n in names), strict=True)
    return np.array(low, dtype=float), np.array(high, dtype=float), np.array(whole, dtype=bool)


def _reader(limits: Limits, block: int, halo: int) -> Mapper:
    """Judges the series inside a sorted partition and cuts its first and its last into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the series that may go on in the next batch
        ready: list[pa.Table] = []  # series that are at hand in whole
        at_first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = np.flatnonzero(_series_changes(batch, held[-1] if held else None))
            begins = begins[begins > 0] if not held else begins
            if not len(begins):
                held.append(batch)
                continue
            begun = pa.Table.from_batches([*held, batch.slice(0, int(begins[0]))])
            if at_first:
                yield from _blocks(begun, block, halo)
                at_first = False
            else:
                ready.append(begun)
            if begins[-1] > begins[0]:
                ready.append(pa.Table.from_batches([batch.slice(int(begins[0]), int(begins[-1] - begins[0]))]))
            held = [batch.slice(int(begins[-1]))]
            if sum(t.num_rows for t in ready) >= AT_ONCE:
                yield _judged(pa.concat_tables(ready), limits)
                ready = []
        if ready:
            yield _judged(pa.concat_tables(ready), limits)
        if held:
            yield from _blocks(pa.Table.from_batches(held), block, halo)

    return run


def _series_changes(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
    """Whether a row begins another series than the one before (the first of all does)."""
    some = batch.select(SERIES)
    known = pa.Table.from_batches([before.select(SERIES).slice(before.num_rows - 1), some] if before is not None else [some])
    return changes([c.combine_chunks() for c in known.columns], known.num_rows)[-batch.num_rows :]


def _readings(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where series and readings begin in sorted rows, values and ids."""
    series = changes([rows.column(c).combine_chunks() for c in SERIES], rows.num_rows)
    us, value, ids = (rows.column(c).to_numpy() for c in ("us", "value", "metric_id"))
    new = series.copy()
    new[1:] |= (us[1:] != us[:-1]) | (value[1:] != value[:-1])
    return series, new, value, ids


def _judged(rows: pa.Table, limits: Limits) -> pa.RecordBatch:
    series, new, value, ids = _readings(rows)
    names = rows.column("metric_type").take(pa.array(np.flatnonzero(series))).to_pylist()
    kind = judge_series(value[new], (np.cumsum(series) - 1)[new], *_bounds(limits, names))[np.cumsum(new) - 1]
    return _found(ids[kind != FINE], kind[kind != FINE])


def _found(ids: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    columns = {"metric_id": pa.array(ids, pa.int64()), "kind": pa.array(kind, pa.int8())}
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in BLOCKS], schema=BLOCKS)


def _blocks(rows: pa.Table, block: int, halo: int) -> Iterator[pa.RecordBatch]:
    """A partition's share of one series, cut into blocks of at least block readings (but the only one)."""
    if not rows.num_rows:
        return
    _, new, value, ids = _readings(rows)
    places = np.flatnonzero(new)
    copies, x = np.diff(np.append(places, len(new))), value[places]
    n = len(x)
    cuts = [*range(0, max(n - block, 0) + 1, block), n]
    source, metric_type, part = (rows.column(c)[0].as_py() for c in (*SERIES, "part"))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        first, last = max(0, a - halo), min(n, b + halo)
        stop = places[b] if b < n else len(ids)
        row = {
            "source": source, "metric_type": metric_type, "part": part, "number": i, "begin": a, "lead": a - first, "own": b - a, "is_last": b == n,
            "value": x[first:last], "ids": ids[places[a] : stop], "copies": copies[a:b], "share": n if i == 0 else None,
            "head": x[:halo] if i == 0 else None, "tail": x[max(0, n - halo) :] if i == 0 else None,
        }
        yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in BLOCKS], schema=BLOCKS)


def _judged_over_partitions(blocks: DataFrame, limits: Limits, block: int, halo: int) -> DataFrame:
    """(metric_id, kind) from the blocks of series that may reach over partitions."""
    share = [*SERIES, "part"]
    by_part = Window.partitionBy(*SERIES).orderBy("part")
    before = F.flatten(F.collect_list("tail").over(by_part.rowsBetween(-PARTS_NEAR, -1)))
    after = F.flatten(F.collect_list("head").over(by_part.rowsBetween(1, PARTS_NEAR)))
    ends = blocks.where("number = 0").select(
        *share,
        F.coalesce(F.sum("share").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.slice(before, F.greatest(F.size(before) - halo + 1, F.lit(1)), halo).alias("before"),
        F.slice(after, 1, halo).alias("after"),
    )
    none = F.array().cast("array<double>")
    ahead, behind = F.when(F.col("number") == 0, F.col("before")).otherwise(none), F.when(F.col("is_last"), F.col("after")).otherwise(none)
    whole = blocks.join(written_if_small(ends, "ends"), share).select(
        *share, "number", (F.col("start") + F.col("begin")).alias("position"), (F.col("lead") + F.size(ahead)).alias("lead"), "own",
        F.concat(ahead, "value", behind).alias("value"), "ids", "copies",
    )
    whole = materialize(whole, "open")
    none_held = {"begins": F.lit(None).cast("array<bigint>"), "ends": F.lit(None).cast("array<bigint>")}
    first = _medians_over_blocks(whole.withColumns(none_held), limits, FIRST).withColumnRenamed("median", "first")
    runs = whole.join(first, SERIES, "left").mapInArrow(_runs_of_blocks(limits), RUNS)
    runs = runs.repartition(shuffle_width(blocks), *SERIES).sortWithinPartitions(*SERIES, "first_place")
    stretches = runs.mapInArrow(_join_runs, "source string, metric_type string, begin bigint, end bigint")
    cell = [F.floor(c / block) for c in (F.col("begin"), F.col("end"))]
    reached = stretches.select(*SERIES, "begin", "end", F.explode(F.sequence(*cell)).alias("cell"))
    own_cells = F.sequence(F.floor((F.col("position") - F.col("lead")) / block), F.floor((F.col("position") + F.size("value") - F.col("lead") - 1) / block))
    held = whole.select(*share, "number", F.explode(own_cells).alias("cell")).join(reached, [*SERIES, "cell"])
    held = held.groupBy(*share, "number").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("found"))
    held = held.select(*share, "number", F.col("found.begin").alias("begins"), F.col("found.end").alias("ends"))
    free = whole.join(written_if_small(held, "held"), [*share, "number"], "left").join(first.drop("count"), SERIES, "left")
    second = _medians_over_blocks(free, limits, SECOND).withColumnsRenamed({"median": "second", "count": "readings"})
    return free.join(second, SERIES, "left").mapInArrow(_judge_blocks(limits), "metric_id bigint, kind byte")


def _medians_over_blocks(blocks: DataFrame, limits: Limits, names: Sequence[str]) -> DataFrame:
    """(source, metric_type, median, count): of each series the medians of some measures, and how many values the fullest of
    them has. A series without values of any has no row. There are two series for each partition at most: they are sent to all."""
    counted = blocks.mapInArrow(_count_values(limits, names), "source string, metric_type string, measure int, bucket int, n bigint")
    counted = counted.groupBy(*SERIES, "measure", "bucket").agg(F.sum("n").alias("n"))
    one = Window.partitionBy(*SERIES, "measure")
    ranked = counted.select(*SERIES, "measure", "bucket", "n", F.sum("n").over(one.orderBy("bucket")).alias("upto"), F.sum("n").over(one).alias("total"))
    at = [F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("bucket"))) for rank in (F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))]
    middle = ranked.groupBy(*SERIES, "measure").agg(at[0].alias("lo"), at[1].alias("hi"), F.max("total").alias("total"))
    found = middle.groupBy(*SERIES).agg(
        *(F.max(F.when(F.col("measure") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(names)) for c in ("lo", "hi")),
        F.max("total").alias("count"),
    )
    return F.broadcast(materialize(found.mapInArrow(_values_of_buckets(len(names)), "source string, metric_type string, median array<double>, count bigint"), "medians"))


def _values_of_buckets(n: int) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = (np.array([batch.column(f"{c}{i}").fill_null(0).to_numpy(zero_copy_only=False) for i in range(n)]) for c in ("lo", "hi"))
            values = (value_of(lo) + value_of(hi)) / 2
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(values.T).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in SERIES), lists, batch.column("count")], names=[*SERIES, "median", "count"])

    return run


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list column without nulls, and where each row's begin (and the last one's end)."""
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _vectors(batch: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    """A column of lists of n numbers as n rows; null lists are zeros."""
    out = np.zeros((n, batch.num_rows))
    for i, v in enumerate(batch.column(name).to_pylist()):
        out[:, i] = v if v is not None else 0.0
    return out


def _pieces(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few enough blocks."""
    for batch in blocks:
        for a in range(0, batch.num_rows, AT_ONCE // BLOCK):
            yield batch.slice(a, AT_ONCE // BLOCK)


def _batch_of(blocks: pa.RecordBatch, limits: Limits) -> tuple[Batch, Batch, np.ndarray]:
    """The possible readings of blocks, those of them that aren't held in a stuck stretch, and all values."""
    value, offsets = _lists(blocks, "value")
    lead, own, position = _numbers(blocks, "lead", "own", "position")
    low, high, whole = _bounds(limits, blocks.column("metric_type").to_pylist())
    of = np.repeat(np.arange(blocks.num_rows), np.diff(offsets))
    place = np.arange(len(value)) - offsets[of]
    mine = (place >= lead[of]) & (place < (lead + own)[of])
    at = (position - lead)[of] + place
    ok = is_possible(value, low[of], high[of], whole[of])
    possible = Batch(value[ok], at[ok], of[ok], mine[ok], whole)
    held = np.zeros(len(value), dtype=bool)
    for i, (begins, ends) in enumerate(zip(blocks.column("begins").to_pylist(), blocks.column("ends").to_pylist(), strict=True)):
        for a, b in zip(begins or (), ends or (), strict=True):
            shift = int(offsets[i] - position[i] + lead[i])
            held[max(a + 1 + shift, int(offsets[i])) : max(min(b + 1 + shift, int(offsets[i + 1])), 0)] = True
    return possible, possible.keep(~held[ok]), value


def _count_values(limits: Limits, names: Sequence[str]) -> Mapper:
    """Per series, measure and bucket how many values there are, once for all blocks of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _pieces(batches):
            if not blocks.num_rows:
                continue
            _, free, _ = _batch_of(blocks, limits)
            measured = first_measures(free) if names == FIRST else second_measures(free, _vectors(blocks, "first", len(FIRST)))
            codes = [blocks.column(c).dictionary_encode() for c in SERIES]
            series = codes[0].indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy(zero_copy_only=False)
            _, example, series = np.unique(series, return_index=True, return_inverse=True)
            for i, (values, of) in enumerate(measured):
                key, n = np.unique((series[of] << 18) | bucket_of(values), return_counts=True)
                which = pa.array(example[key >> 18])
                arrays = [*(blocks.column(c).take(which) for c in SERIES), pa.array(np.full(len(key), i), pa.int32()), pa.array(key & ((1 << 18) - 1), pa.int32()), pa.array(n)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*SERIES, "measure", "bucket", "n"])

    return run


RUNS = (
    "source string, metric_type string, first_place bigint, near double, steps bigint, flats bigint, first double, last double, "
    "pieces array<struct<count:bigint,first:bigint,last:bigint,number:array<bigint>,value:array<double>,before:array<bigint>>>, "
    "within array<struct<first:bigint,last:bigint,count:bigint,level:double>>"
)
PIECE = pa.struct({"count": pa.int64(), "first": pa.int64(), "last": pa.int64(), "number": pa.list_(pa.int64()), "value": pa.list_(pa.float64()), "before": pa.list_(pa.int64())})
WITHIN = pa.struct({"first": pa.int64(), "last": pa.int64(), "count": pa.int64(), "level": pa.float64()})
BODY = pa.schema({
    "first_place": pa.int64(), "near": pa.float64(), "steps": pa.int64(), "flats": pa.int64(), "first": pa.float64(), "last": pa.float64(),
    "pieces": pa.list_(PIECE), "within": pa.list_(WITHIN),
})


def _runs_of_blocks(limits: Limits) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            value, offsets = _lists(batch, "value")
            lead, own, position = _numbers(batch, "lead", "own", "position")
            low, high, whole = _bounds(limits, batch.column("metric_type").to_pylist())
            near = near_of(_vectors(batch, "first", len(FIRST))[0], whole)
            rows, kept = [], []
            for i in range(batch.num_rows):
                begin = offsets[i] + lead[i]
                x = value[begin : begin + own[i]]
                possible = np.flatnonzero(is_possible(x, low[i], high[i], bool(whole[i])))
                if not len(possible):
                    continue
                runs = block_runs(x[possible], position[i] + possible, float(near[i]))
                pieces = [{"count": p.count, "first": p.first, "last": p.last, "number": p.number, "value": p.value, "before": p.before} for p in runs.pieces]
                within = [dict(zip(("first", "last", "count", "level"), w, strict=True)) for w in runs.within]
                kept.append(i)
                rows.append({"first_place": int(position[i]), "near": float(near[i]), "steps": runs.steps, "flats": runs.flats, "first": runs.first, "last": runs.last, "pieces": pieces, "within": within})
            if rows:
                heads = batch.select(SERIES).take(pa.array(kept))
                body = pa.RecordBatch.from_pylist(rows, schema=BODY)
                yield pa.RecordBatch.from_arrays([*heads.columns, *body.columns], names=[*heads.schema.names, *body.schema.names])

    return run


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stuck stretches of each series, whose blocks come one after the other in order."""
    name: tuple[str, str] | None = None
    series = SeriesRuns(0.0)
    found: list[tuple[str, str, int, int]] = []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["source"], row["metric_type"]) != name:
                found += [(*name, a, b) for a, b in series.stuck()] if name else []
                name, series = (row["source"], row["metric_type"]), SeriesRuns(row["near"])
            pieces = [Piece(**{k: np.array(v) if isinstance(v, list) else v for k, v in p.items()}) for p in row["pieces"]]
            within = [(w["first"], w["last"], w["count"], w["level"]) for w in row["within"]]
            series.add(BlockRuns(row["steps"], row["flats"], row["first"], row["last"], pieces, within))
        if found:
            yield _stretches(found)
            found = []
    found += [(*name, a, b) for a, b in series.stuck()] if name else []
    if found:
        yield _stretches(found)


def _stretches(found: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=[*SERIES, "begin", "end"])


def _judge_blocks(limits: Limits) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _pieces(batches):
            if not blocks.num_rows:
                continue
            possible, free, value = _batch_of(blocks, limits)
            kind = np.full(len(value), IMPOSSIBLE, dtype=np.int8)
            _, offsets = _lists(blocks, "value")
            lead, own, position = _numbers(blocks, "lead", "own", "position")
            shift = offsets[:-1] + lead - position  # from a reading's position in its series to its place here
            kind[possible.at + shift[possible.of]] = STUCK
            kind[free.at + shift[free.of]] = FINE
            first, second = _vectors(blocks, "first", len(FIRST)), _vectors(blocks, "second", len(SECOND))
            count = np.nan_to_num(blocks.column("readings").to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            spikes = scores(free, first, second, count) > SPIKE_LIMIT
            kind[(free.at + shift[free.of])[spikes]] = SPIKE
            places = np.repeat(offsets[:-1] + lead - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
            ids, copies = _lists(blocks, "ids")[0], _lists(blocks, "copies")[0]
            of_rows = np.repeat(kind[places], copies)
            found = of_rows != FINE
            yield pa.RecordBatch.from_arrays([pa.array(ids[found], pa.int64()), pa.array(of_rows[found], pa.int8())], names=["metric_id", "kind"])

    return run
