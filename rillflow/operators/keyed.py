"""Keyed stateful operators in batch form: state by key over rows in a unique order, time by an event-time column.

Running states are windows partitioned by key; Spark sorts and spills, and no window holds more than its frame. With
``spread=True`` positions, running sums and neighbours come from range partitions with offsets and blocks instead, for
keys that hold much of all rows.
Recurrences that no window can express (greedy time-to-live, throttling, group timeouts) are streamed over partitions
sorted by key with constant memory: only the state of the current key is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import WindowSpec

from rillflow.operators.eventtime import TimeJoinConfig, join_with_time_window
from rillflow.plans.ordering import block_window, blocked, changes, col, free_name, own_rows, running_sums, with_position
from rillflow.plans.sizing import written_if_small
from rillflow.plans.storage import materialize, shuffle_width

#: Items of a group that are handed on together when no size is given.
GROUP_ITEMS = 10_000


def key_window(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*(col(k) for k in key)).orderBy(*(col(o) for o in order))


def upto(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return key_window(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def stateful_map(df: DataFrame, key: Sequence[str], order: Sequence[str], **columns: Column) -> DataFrame:
    """Each row with columns made from the running aggregates of its key, e.g. F.sum("x")."""
    return df.withColumns({n: c.over(upto(key, order)) for n, c in columns.items()})


def stateful_fold(df: DataFrame, key: Sequence[str], order: Sequence[str], spread: bool = False, **sums: Column) -> DataFrame:
    """Every intermediate accumulator of each key. sums are expressions to add up; with spread see the module."""
    if spread:
        return running_sums(df, key, [col(o) for o in order], sums, label="fold")
    return df.withColumns({n: F.sum(c).over(upto(key, order)) for n, c in sums.items()})


def stateful_reduce(df: DataFrame, key: Sequence[str], order: Sequence[str], **aggregates: Column) -> DataFrame:
    """Every intermediate result of reducing each key's rows with built-in aggregates, e.g. F.max("x"); the first row's
    value stands for itself. See keyed_reduce for any function."""
    return stateful_map(df, key, order, **aggregates)


def stateful_filter(df: DataFrame, key: Sequence[str], order: Sequence[str], state: dict[str, Column], predicate: Column) -> DataFrame:
    """The rows for which predicate holds over their key's running state, which includes the row."""
    return stateful_map(df, key, order, **state).where(predicate).drop(*state)


def _placed(df: DataFrame, key: Sequence[str], order: Sequence[str], spread: bool) -> DataFrame:
    """df with __rn, the place of each row in its key; with spread by range partitions and offsets."""
    if spread:
        return with_position(df, [col(o) for o in order], "__rn", key)
    return df.withColumn("__rn", F.row_number().over(key_window(key, order)).cast("bigint"))


def stateful_session(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, timeout_us: int, spread: bool = False) -> DataFrame:
    """Add is_new, true after a pause longer than the timeout (false for a key's first row), and session_id from 1."""
    us = F.unix_micros(col(ts).cast("timestamp"))
    if spread:
        framed = blocked(df.withColumn("__us", us), [col(o) for o in order], key, before=1)
        gap = F.col("__us") - F.lag("__us").over(block_window(key))
        marked = own_rows(framed.withColumn("is_new", F.coalesce(gap > timeout_us, F.lit(False)))).drop("__us")
        summed = running_sums(marked, key, [F.col("rn")], {"session_id": F.col("is_new").cast("bigint")}, label="sessions")
        return summed.withColumn("session_id", F.col("session_id") + 1).drop("rn")
    gap = us - F.lag(us).over(key_window(key, order))
    marked = df.withColumn("is_new", F.coalesce(gap > timeout_us, F.lit(False)))
    return marked.withColumn("session_id", F.lit(1) + F.sum(F.col("is_new").cast("bigint")).over(upto(key, order)))


def session_windows(df: DataFrame, key: Sequence[str], ts: str, timeout: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregated sessions, batch or streaming: key..., session_start, session_end (last event plus timeout)."""
    rows = df.withColumn(ts, col(ts).cast("timestamp"))
    grouped = rows.groupBy(*(col(k) for k in key), F.session_window(col(ts), timeout).alias("__s"))
    out = grouped.agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(*(col(k) for k in key), F.col("__s.start").alias("session_start"), F.col("__s.end").alias("session_end"), *aggregates)


def stateful_window(
    df: DataFrame, key: Sequence[str], order: Sequence[str], size: int, aggregates: dict[str, Column], slide: int | None = None, emit_partial: bool = False,
    spread: bool = False,
) -> DataFrame:
    """Count windows of each key: window_no from 0, n_rows and aggregates. A slide of the size or more tumbles.

    Windows of size rows begin every slide rows; with emit_partial the rows not begun a full window with make one more.
    """
    if size < 1 or (slide is not None and slide < 1):
        raise ValueError("size and slide must be at least 1")
    step = slide if slide is not None and slide < size else size
    placed = _placed(df, key, order, spread)
    if spread:
        counts = df.groupBy(*(col(k).alias(f"__k{i}") for i, k in enumerate(key))).agg(F.count(F.lit(1)).alias("__total"))
        same = [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
        placed = placed.join(written_if_small(counts, "counts"), same).drop(*(f"__k{i}" for i in range(len(key))))
    else:
        placed = placed.withColumn("__total", F.count(F.lit(1)).over(Window.partitionBy(*(col(k) for k in key))))
    total = F.col("__total")
    placed = placed.withColumn("__full", F.when(total < size, F.lit(0)).otherwise(F.floor((total - size) / step) + 1).cast("bigint"))
    rn, full = F.col("__rn"), F.col("__full")
    first = F.greatest(F.lit(0), F.ceil((rn - size) / step)).cast("bigint")
    last = F.least(F.floor((rn - 1) / step).cast("bigint"), full - 1)
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    if emit_partial:
        numbers = F.concat(numbers, F.when(rn > full * step, F.array(full)).otherwise(F.array().cast("array<bigint>")))
    each = placed.withColumn("window_no", F.explode(numbers))
    return each.groupBy(*(col(k) for k in key), "window_no").agg(F.count(F.lit(1)).alias("n_rows"), *(a.alias(n) for n, a in aggregates.items()))


def stateful_pattern(df: DataFrame, key: Sequence[str], order: Sequence[str], size: int, item: str, pattern: Callable[[Column], Column], spread: bool = False) -> DataFrame:
    """Successive batches of size rows of each key; pattern maps the array of their items to a result, null being none."""
    placed = _placed(df, key, order, spread)
    number = F.floor((F.col("__rn") - 1) / size).cast("bigint").alias("batch_no")
    rows = F.sort_array(F.collect_list(F.struct("__rn", col(item).alias("v"))))
    full = placed.groupBy(*(col(k) for k in key), number).agg(F.transform(rows, lambda x: x["v"]).alias("__items")).where(F.size("__items") == size)
    return full.withColumn("result", pattern(F.col("__items"))).where("result IS NOT NULL").drop("__items")


def stateful_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts_left: str, ts_right: str, window_us: int) -> DataFrame:
    """All pairs of equal keys whose times differ by at most window_us."""
    return join_with_time_window(left, right, ts_left, ts_right, TimeJoinConfig(window_us), keys)


def stateful_group_by(
    df: DataFrame, key: Sequence[str], order: Sequence[str], aggregates: dict[str, Column], max_size: int | None = None, emit_on_key_change: bool = False,
    spread: bool = False,
) -> DataFrame:
    """Groups of each key's rows: group_no from 0, n_rows and aggregates; at most max_size rows in each.

    With emit_on_key_change a group ends too where the next row of the whole stream has another key.
    """
    size = max_size or GROUP_ITEMS
    if emit_on_key_change:
        from rillflow.operators.sequence import with_run

        runs = with_run(df, order, F.struct(*(col(k) for k in key)))
        inside = F.row_number().over(Window.partitionBy("run").orderBy("rn"))
        return (
            runs.withColumn("group_no", F.floor((inside - 1) / size).cast("bigint"))
            .groupBy("run", *(col(k) for k in key), "group_no")
            .agg(F.count(F.lit(1)).alias("n_rows"), *(a.alias(n) for n, a in aggregates.items()))
        )
    placed = _placed(df, key, order, spread)
    number = F.floor((F.col("__rn") - 1) / size).cast("bigint").alias("group_no")
    return placed.groupBy(*(col(k) for k in key), number).agg(F.count(F.lit(1)).alias("n_rows"), *(a.alias(n) for n, a in aggregates.items()))


Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


def keyed_stream(df: DataFrame, key: Sequence[str], order: Sequence[str], step: Step, schema: str) -> DataFrame:
    """Stream each key's rows in order through step(state, rows) -> (state, output); state is None at a key's start.

    A key's rows may come in several batches; only its state is kept between them. A null in the key is a key.
    """
    names = list(key)
    ordered = df.repartition(shuffle_width(df), *(col(k) for k in key)).sortWithinPartitions(*(col(k) for k in key), *(col(o) for o in order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state: Any = None
        for batch in batches:
            if batch.empty:
                continue
            change = np.zeros(len(batch), dtype=bool)
            change[0] = True
            for n in names:
                v = batch[n]
                differs = (v.ne(v.shift())) & ~(v.isna() & v.shift().isna())
                change[1:] |= differs.to_numpy()[1:]
            begins = np.flatnonzero(change)
            for a, b in zip(begins, [*begins[1:], len(batch)], strict=True):
                rows = batch.iloc[a:b]
                this = tuple(None if pd.isna(x) else x for x in rows.iloc[0][names])
                if this != current:
                    current, state = this, None
                state, out = step(state, rows)
                if len(out):
                    yield out

    return ordered.mapInPandas(run, schema)


def keyed_scan(df: DataFrame, key: Sequence[str], order: Sequence[str], inputs: Sequence[Column], init: Any, step: Callable[..., tuple[Any, tuple | None]], schema: str) -> DataFrame:
    """Fold each key's rows in order with any Python function, emitting every state.

    step(state, *inputs of the row) gives the next state and the values of the columns in schema that are added to the row;
    None in their place leaves the row out. A key begins with init (called, if it can be). Arrow batches of partitions sorted
    by key are gone through once; only the current key's state is kept. A null in the key is a key; without key columns
    the whole stream is one key and one task's work, as such a fold can't be taken apart.
    """
    names = [*df.columns, *(f"__in{i}" for i in range(len(inputs)))]
    wide = df.select(*(col(c) for c in df.columns), *inputs).toDF(*(f"c{i}" for i in range(len(names))))
    at = [names.index(k) for k in key]
    sort = [F.col(f"c{i}") for i in [*at, *(names.index(o) for o in order)]]
    spread = wide.repartition(shuffle_width(df), *sort[: len(at)]) if at else wide.repartition(1)
    ordered = spread.sortWithinPartitions(*sort)
    added = _parsed(schema)
    fields = [StructField(f"c{j}", f.dataType) for j, f in enumerate([*df.schema.fields, *added.fields])]
    run = _scanning(at, len(df.columns), len(inputs), init, step, to_arrow_schema(added))
    return ordered.mapInArrow(run, StructType(fields)).toDF(*df.columns, *added.names)


def _scanning(at: list[int], width: int, n_inputs: int, init: Any, step: Callable[..., tuple[Any, tuple | None]], arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds sorted batches by the key columns numbered at; the n_inputs columns from width on become those of arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None
        state: Any = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.select(at)
            if at:
                known = pa.Table.from_batches([before, keys] if before is not None else [keys])
                changed = changes([c.combine_chunks() for c in known.columns], known.num_rows)[-len(batch) :].tolist()
                before = keys.slice(len(batch) - 1)
            else:
                changed = [before is None] + [False] * (len(batch) - 1)
                before = batch
            kept, out = [], []
            for i, (new, *values) in enumerate(zip(changed, *(batch.column(width + j).to_pylist() for j in range(n_inputs)), strict=True)):
                if new:
                    state = init() if callable(init) else init
                state, made = step(state, *values)
                if made is not None:
                    kept.append(i)
                    out.append(made)
            rows = batch.select(range(width)).take(pa.array(kept, pa.int64()))
            columns = [pa.array([o[j] for o in out], f.type) for j, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[f"c{j}" for j in range(width + len(arrow))])

    return run


def _parsed(schema: str) -> StructType:
    return StructType.fromDDL(schema) if schema else StructType([])


def keyed_reduce(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, f: Callable[[Any, Any], Any], schema: str) -> DataFrame:
    """Every intermediate value of reducing each key's values in order with any function; the first stands for itself.
    A null value leaves the result as it is."""
    return keyed_scan(df, key, order, [value], (), _reducing(f), schema)


def scan_associative(df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, f: Callable[[Any, Any], Any], name: str, kind: str) -> DataFrame:
    """Every intermediate value of reducing each key's values (without key columns, the stream's) in order by an associative
    function, however many rows a key has; the first stands for itself, a null leaves the result as it is.

    Sorted range partitions are reduced as they are written; what earlier partitions hold of a key, one row per key and
    partition that hold each other, is reduced in order and put in front when they are read.
    """
    place, local, groups = free_name(df, "__place"), free_name(df, "__local"), [col(k) for k in key]
    sort = [*groups, *(col(o) for o in order)]
    spread = df.repartitionByRange(shuffle_width(df), *sort).sortWithinPartitions(*sort).withColumn(place, F.monotonically_increasing_id())
    added = _parsed(f"held {kind}")
    fields = [StructField(f"c{j}", x.dataType) for j, x in enumerate([*spread.schema.fields, *added.fields])]
    numbered = spread.select(*(col(c) for c in spread.columns), value).toDF(*(f"c{j}" for j in range(len(fields))))
    run = _scanning([spread.columns.index(k) for k in key], len(spread.columns), 1, (), _reducing(f), to_arrow_schema(added))
    ranged = materialize(numbered.mapInArrow(run, StructType(fields)).toDF(*spread.columns, local), "reduced")
    part = F.shiftright(col(place), 33)
    names = [f"__k{i}" for i in range(len(key))]
    ends = ranged.groupBy(*(g.alias(n) for g, n in zip(groups, names, strict=True)), part.alias("__p")).agg(F.max_by(col(local), col(place)).alias("__end"))

    def before(held: tuple, v: Any) -> tuple[tuple, tuple]:
        return _reducing(f)(held, v)[0], held or (None,)

    ahead = keyed_scan(ends, names, ["__p"], [F.col("__end")], (), before, f"__ahead {kind}").drop("__end")
    same = [g.eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)] + [part == F.col("__p")]
    joined = ranged.join(written_if_small(ahead, "ahead"), same)

    @F.udf(kind, useArrow=True)
    def both(ahead_value: Any, own: Any) -> Any:
        return own if ahead_value is None else ahead_value if own is None else f(ahead_value, own)

    return joined.select(*(col(c) for c in df.columns), both(F.col("__ahead"), col(local)).alias(name))


def _reducing(f: Callable[[Any, Any], Any]) -> Callable[[tuple, Any], tuple[tuple, tuple]]:
    def step(held: tuple, v: Any) -> tuple[tuple, tuple]:
        held = held if v is None else (f(held[0], v),) if held else (v,)
        return held, held or (None,)

    return step


def distinct_until_changed_by(df: DataFrame, order: Sequence[str], value: Column, same: Callable[[Any, Any], bool], key: Sequence[str] = ()) -> DataFrame:
    """Leave out a row whose value is the same, by any function, as that of the last row kept (of its key).

    The first stays. Where same compares a projection, ``sequence.distinct_until_changed`` needs no one task.
    """

    def step(last: tuple, v: Any) -> tuple[tuple, tuple | None]:
        return (last, None) if last and same(last[0], v) else ((v,), ())

    return keyed_scan(df, key, order, [value], (), step, "")


def _us(ts: str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def stateful_deduplicate(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, ttl_us: int) -> DataFrame:
    """The rows more than ttl_us after the last row kept of their key; the first is kept. order must begin with ts."""

    def step(last: int | None, us: int) -> tuple[int | None, tuple | None]:
        return (us, ()) if last is None or us - last > ttl_us else (last, None)

    return keyed_scan(df, key, order, [_us(ts)], None, step, "")


def stateful_throttle(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, limit: int, window_us: int, policy: str = "delay") -> DataFrame:
    """Add window_start_us, n_in_window, throttled and emit_us. A key's window begins with its first row and anew after
    more than window_us. A row over the limit begins a new window: at the end of the old one if that is less than a
    second away, else at once. With policy 'drop' rows over the limit are left out instead and begin no window."""
    if policy not in ("delay", "drop"):
        raise ValueError(f"unknown policy {policy}")

    def step(state: tuple[int | None, int], us: int) -> tuple[tuple[int, int], tuple | None]:
        start, n = state
        if start is None or us - start > window_us:
            start, n = us, 0
        emit, over = us, n >= limit
        if over and policy == "drop":
            return (start, n), None
        if over:
            left = start + window_us - us
            emit = us + left if 0 < left < 1_000_000 else us
            start, n = emit, 0
        return (start, n + 1), (start, n + 1, over, max(emit, us))

    return keyed_scan(df, key, order, [_us(ts)], (None, 0), step, "window_start_us bigint, n_in_window bigint, throttled boolean, emit_us bigint")


def stateful_group_by_timeout(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, timeout_us: int | None = None, max_size: int | None = None) -> DataFrame:
    """Add group_no: a group ends before a row more than timeout_us after the group's first row, or at max_size rows."""

    def step(state: tuple[int | None, int, int], us: int) -> tuple[tuple[int, int, int], tuple]:
        start, n, number = state
        if start is None or (timeout_us is not None and us - start > timeout_us) or (max_size is not None and n >= max_size):
            start, n, number = us, 0, number + 1
        return (start, n + 1, number), (number,)

    return keyed_scan(df, key, order, [_us(ts)], (None, 0, -1), step, "group_no bigint")


def stateful_group_by_advanced(
    df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, aggregates: dict[str, Column], max_size: int | None = None,
    timeout_us: int | None = None, emit_on_key_change: bool = False,
) -> DataFrame:
    """Groups of each key's rows that end by whatever comes first: max_size rows, a row more than timeout_us after the
    group's first, or (with emit_on_key_change) a row of another key next in the whole stream. With the last, groups are
    those of run, the number of the stretch of rows of one key; group_no counts from 0 in the key or run."""
    from rillflow.operators.sequence import with_run

    rows = with_run(df, order, F.struct(*(col(k) for k in key))) if emit_on_key_change else df
    by = ["run", *key] if emit_on_key_change else list(key)
    grouped = stateful_group_by_timeout(rows, by, order, ts, timeout_us, max_size or GROUP_ITEMS)
    return grouped.groupBy(*(col(k) for k in by), "group_no").agg(F.count(F.lit(1)).alias("n_rows"), *(a.alias(n) for n, a in aggregates.items()))
