"""Keyed operators on unbounded streams. Time is event time, so a replay gives the same rows.

Each takes a streaming DataFrame; rows of a micro-batch are taken in the given order per key. State is kept by Spark's
state store and survives executors; late rows behind the watermark are dropped where one is set.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillflow.functions.keys import StateConfig
from rillflow.plans.ordering import col, quoted

Step = Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame]]
AtEnd = Callable[[tuple, Any], pd.DataFrame]


def stateful(
    df: DataFrame, key: Sequence[str], order: Sequence[str], step: Step, schema: str, config: StateConfig | None = None, at_end: AtEnd | None = None
) -> DataFrame:
    """step(state, rows) -> (state, output) per key and micro-batch; the state is any JSON value, None at first.

    The same step serves rillflow.operators.keyed.keyed_stream on batches. With config, the state of a key that got no rows
    for its time to live, by the watermark, is given up (df must have a watermark); at_end(key, state) may then make last
    rows of it. Without, it is kept for good.
    """
    ttl_ms = max(1, int(config.validated().ttl_s * 1000)) if config is not None else None

    def run(this: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            if at_end is not None:
                yield at_end(this, json.loads(held.get[0]))
            held.remove()
            return
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        state, out = step(json.loads(held.get[0]) if held.exists else None, rows)
        held.update((json.dumps(state),))
        if ttl_ms is not None:
            held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs(), 0) + ttl_ms)
        yield out

    grouped = df.groupBy(*(col(k) for k in key))
    mode = GroupStateTimeout.EventTimeTimeout if ttl_ms is not None else GroupStateTimeout.NoTimeout
    return grouped.applyInPandasWithState(run, schema, "state string", "append", mode)


def filtered(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, init: Any, step: Callable[[Any, Any], tuple[Any, bool]], config: StateConfig | None = None) -> DataFrame:
    """The rows that step(state, value) -> (state, keep) keeps, by their key's state."""

    def run(state: list | None, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        now, kept = state[0] if state else init, []
        for i, v in enumerate(rows[value].tolist()):
            now, keep = step(now, v)
            if keep:
                kept.append(i)
        return [now], rows.iloc[kept]

    return stateful(df, key, order, run, _schema(df, ""), config)


def throttled(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, limit: int, window_us: int, config: StateConfig | None = None) -> DataFrame:
    """The first limit rows of each window of a key, which begins with a row and ends after window_us; the others are dropped."""

    def step(state: list | None, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        start, n = state or (None, 0)
        kept = []
        for i, us in enumerate(rows["__us"].tolist()):
            if start is None or us - start > window_us:
                start, n = int(us), 0
            if n < limit:
                n += 1
                kept.append(i)
        return [start, n], rows.iloc[kept].drop(columns="__us")

    timed = df.withColumn("__us", F.unix_micros(col(ts).cast("timestamp")))
    return stateful(timed, key, order, step, _schema(df, ""), config)


def patterns(df: DataFrame, key: Sequence[str], order: Sequence[str], item: str, size: int, match: Callable[[list], str | None], config: StateConfig | None = None) -> DataFrame:
    """key..., batch_no, result: what match says of each size successive items of a key, where it isn't None."""
    names = list(key)

    def step(state: list | None, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        waiting, number = state or ([], 0)
        waiting = waiting + rows[item].tolist()
        out = []
        while len(waiting) >= size:
            found = match(waiting[:size])
            if found is not None:
                out.append((*rows.iloc[0][names], number, found))
            waiting, number = waiting[size:], number + 1
        return [waiting, number], pd.DataFrame(out, columns=[*names, "batch_no", "result"])

    kinds = dict((f.name, f.dataType.simpleString()) for f in df.schema)
    return stateful(df, key, order, step, ", ".join(f"{quoted(k)} {kinds[k]}" for k in names) + ", batch_no bigint, result string", config)


def grouped(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, max_size: int, config: StateConfig) -> DataFrame:
    """key..., group_no, n_rows, total: groups of each key's rows, which end at max_size rows or when the key gets no more
    rows for the time to live (a timer by the watermark)."""
    names = list(key)
    columns = [*names, "group_no", "n_rows", "total"]

    def step(state: list | None, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        number, n, total = state or (0, 0, 0.0)
        out = []
        for v in rows[value].tolist():
            n, total = n + 1, total + (0.0 if pd.isna(v) else v)
            if n == max_size:
                out.append((*rows.iloc[0][names], number, n, total))
                number, n, total = number + 1, 0, 0.0
        return [number, n, total], pd.DataFrame(out, columns=columns)

    def last(this: tuple, state: list) -> pd.DataFrame:
        number, n, total = state
        return pd.DataFrame([(*this, number, n, total)] if n else [], columns=columns)

    kinds = dict((f.name, f.dataType.simpleString()) for f in df.schema)
    schema = ", ".join(f"{quoted(k)} {kinds[k]}" for k in names) + ", group_no bigint, n_rows bigint, total double"
    return stateful(df, key, order, step, schema, config, last)


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema) + more


def fold(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str = "running_sum", config: StateConfig | None = None) -> DataFrame:
    """Add the running sum of value."""

    def step(total: float | None, rows: pd.DataFrame) -> tuple[float, pd.DataFrame]:
        sums = rows[value].fillna(0).cumsum() + (total or 0)
        return float(sums.iloc[-1]), rows.assign(**{name: sums})

    return stateful(df, key, order, step, _schema(df, f", {name} double"), config)


def session(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, timeout_us: int, config: StateConfig | None = None) -> DataFrame:
    """Add is_new and session_id as the batch operator of that name."""

    def step(state: list | None, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        us = rows["__us"].astype("int64")
        last, number = state or (None, 1)
        gap = us.diff()
        if last is not None:
            gap.iloc[0] = us.iloc[0] - last
        new = gap > timeout_us
        ids = number + new.cumsum()
        return [int(us.iloc[-1]), int(ids.iloc[-1])], rows.drop(columns="__us").assign(is_new=new, session_id=ids)

    timed = df.withColumn("__us", F.unix_micros(col(ts).cast("timestamp")))
    return stateful(timed, key, order, step, _schema(df, ", is_new boolean, session_id bigint"), config)


def deduplicate(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, ttl_us: int, config: StateConfig | None = None) -> DataFrame:
    """The rows more than ttl_us after the last row kept of their key."""

    def step(last: int | None, rows: pd.DataFrame) -> tuple[int | None, pd.DataFrame]:
        kept = []
        for i, us in enumerate(rows["__us"].tolist()):
            if last is None or us - last > ttl_us:
                kept.append(i)
                last = int(us)
        return last, rows.iloc[kept].drop(columns="__us")

    timed = df.withColumn("__us", F.unix_micros(col(ts).cast("timestamp")))
    return stateful(timed, key, order, step, _schema(df, ""), config)


def deduplicate_messages(df: DataFrame, ids: Sequence[str], ts: str, delay: str) -> DataFrame:
    """One of each message, recognised again as long as the watermark hasn't passed it."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def count_windows(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, size: int, config: StateConfig | None = None) -> DataFrame:
    """Tumbling windows of size rows of each key: key..., window_no, total (of value). Rows wait for a full window."""
    names = list(key)

    def step(state: list | None, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        waiting, number = state or ([], 0)
        waiting = waiting + rows[value].astype(float).tolist()
        out = []
        while len(waiting) >= size:
            out.append((*rows.iloc[0][names], number, sum(waiting[:size])))
            waiting, number = waiting[size:], number + 1
        return [waiting, number], pd.DataFrame(out, columns=[*names, "window_no", "total"])

    kinds = dict((f.name, f.dataType.simpleString()) for f in df.schema)
    return stateful(df, key, order, step, ", ".join(f"{quoted(k)} {kinds[k]}" for k in names) + ", window_no bigint, total double", config)


def reorder(df: DataFrame, key: Sequence[str], order: Sequence[str], number: str, window: int = 32, config: StateConfig | None = None) -> DataFrame:
    """Release numbers of each key from 0 in order: key..., number, status. Numbers ahead wait for those missing, at most
    window of them; then the gap is given up and the least waiting is released as 'Gap'. Numbers that were released or
    given up come out at once as 'Duplicate' or 'Late'."""
    names = list(key)

    def step(state: list | None, rows: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        due, waiting, skipped = state or (0, [], [])
        held = set(waiting)
        out = []
        for n in rows[number].astype("int64").tolist():
            if n < due or n in held:
                out.append((n, "Late" if n in skipped else "Duplicate"))
                skipped = [s for s in skipped if s != n]
                continue
            held.add(n)
            while held and (due in held or len(held) > window):
                least = min(held)
                # What is given up is remembered only as far back as a window.
                skipped = [*skipped, *range(max(due, least - window), least)][-window:]
                out.append((least, "Ok" if least == due else "Gap"))
                held.remove(least)
                due = least + 1
        first = rows.iloc[0]
        return [due, sorted(held), skipped], pd.DataFrame([(*first[names], *o) for o in out], columns=[*names, number, "status"])

    kinds = dict((f.name, f.dataType.simpleString()) for f in df.schema)
    return stateful(df, key, order, step, ", ".join(f"{quoted(k)} {kinds[k]}" for k in names) + f", {quoted(number)} bigint, status string", config)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into Parquet files, and read them."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
