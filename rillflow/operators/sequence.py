"""Operators on one totally ordered stream. ``order`` must be unique; it is the order of the stream.

None of them sorts the whole stream in one task: positions and running values come from range partitions with offsets,
and functions of neighbouring rows are windows over blocks with copies of the rows next to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.plans.ordering import BLOCK_ROWS, SMALL_BYTES, block_window, blocked, col, own_rows, running_sums, settings, with_position


def _columns(order: Sequence[str]) -> list[Column]:
    return [col(o) for o in order]


def take(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*_columns(order)).limit(n)


def drop(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """All but the first n rows."""
    if n <= 0:
        return df
    return with_position(df, _columns(order), "__rn", small_bytes=SMALL_BYTES).where(F.col("__rn") > n).drop("__rn")


def first_where(df: DataFrame, order: Sequence[str], condition: Column) -> Column | None:
    """The order key of the first row where condition holds, as a literal struct; None if there is none."""
    key = F.struct(*_columns(order))
    row = df.where(condition).agg(F.min(key).alias("k")).first()
    if row is None or row.k is None:
        return None
    kinds = dict(df.dtypes)
    return F.struct(*(F.lit(row.k[o]).cast(kinds[o]).alias(o) for o in order))


def take_while(df: DataFrame, order: Sequence[str], predicate: Column) -> DataFrame:
    """The rows before the first for which predicate isn't true. One aggregate finds it; the rest is a pushed filter."""
    stop = first_where(df, order, ~F.coalesce(predicate, F.lit(False)))
    return df if stop is None else df.where(F.struct(*_columns(order)) < stop)


def drop_while(df: DataFrame, order: Sequence[str], predicate: Column) -> DataFrame:
    """The rows from the first on for which predicate isn't true."""
    begin = first_where(df, order, ~F.coalesce(predicate, F.lit(False)))
    return df.where(F.lit(False)) if begin is None else df.where(F.struct(*_columns(order)) >= begin)


def interrupt_when(df: DataFrame, ts: str, signal: Column) -> DataFrame:
    """The rows before a moment; at that very moment the signal wins."""
    return df.where(col(ts) < signal)


def chunk(df: DataFrame, order: Sequence[str], size: int, items: Sequence[str]) -> DataFrame:
    """Successive chunks of size rows, the last perhaps shorter: chunk_no from 0, n, and items as an array in order.

    Size 0 gives one chunk of everything.
    """
    placed = with_position(df, _columns(order), small_bytes=SMALL_BYTES)
    number = F.floor((F.col("rn") - 1) / size).cast("bigint") if size > 0 else F.lit(0).cast("bigint")
    return _gathered(placed.withColumn("chunk_no", number), ["chunk_no"], items)


def _gathered(df: DataFrame, by: Sequence[str], items: Sequence[str], place: str = "rn") -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(col(place).alias("rn"), *(col(i) for i in items))))
    return df.groupBy(*(col(b) for b in by)).agg(F.count(F.lit(1)).alias("n"), rows.alias("items"))


def sliding_window(df: DataFrame, order: Sequence[str], size: int, items: Sequence[str]) -> DataFrame:
    """Every size successive rows, one step on each time, only full ones: rn of the last row, and items in order."""
    if size <= 0:
        none = df.where(F.lit(False))
        return none.select(F.lit(0).cast("bigint").alias("rn"), F.array(F.struct(*(col(i) for i in items))).alias("items"))
    framed = blocked(df, _columns(order), before=size - 1, small_bytes=SMALL_BYTES)
    w = block_window().rowsBetween(-(size - 1), 0)
    rows = framed.withColumn("items", F.collect_list(F.struct(*(col(i) for i in items))).over(w))
    return own_rows(rows).where(F.col("rn") >= size).select("rn", "items")


def sliding_aggregate(df: DataFrame, order: Sequence[str], size: int, **aggregates: Column) -> DataFrame:
    """As sliding_window, with aggregates in place of the rows."""
    framed = blocked(df, _columns(order), before=size - 1, small_bytes=SMALL_BYTES)
    w = block_window().rowsBetween(-(size - 1), 0)
    rows = framed.withColumns({n: a.over(w) for n, a in aggregates.items()})
    return own_rows(rows).where(F.col("rn") >= size)


def with_run(df: DataFrame, order: Sequence[str], key: Column) -> DataFrame:
    """Add rn and run, the number from 1 of the run of successive equal keys (null equals null)."""
    framed = blocked(df.withColumn("__key", key), _columns(order), before=1, small_bytes=SMALL_BYTES)
    before = F.lag("__key").over(block_window())
    changes = (F.col("rn") == 1) | ~before.eqNullSafe(F.col("__key"))
    marked = own_rows(framed.withColumn("__new", changes.cast("bigint"))).drop("__key")
    return running_sums(marked, [], [F.col("rn")], {"run": F.col("__new")}, label="runs", small_bytes=SMALL_BYTES).drop("__new")


def group_adjacent_by(df: DataFrame, order: Sequence[str], key: Column, items: Sequence[str]) -> DataFrame:
    """Runs of successive rows of equal key: run, key, n and the rows in order."""
    runs = with_run(df.withColumn("key", key), order, F.col("key"))
    return _gathered(runs, ["run", "key"], items)


def adjacent_aggregate(df: DataFrame, order: Sequence[str], key: Column, **aggregates: Column) -> DataFrame:
    """As group_adjacent_by, with aggregates in place of the rows."""
    return with_run(df.withColumn("key", key), order, F.col("key")).groupBy("run", "key").agg(*(a.alias(n) for n, a in aggregates.items()))


def hash_group_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], items: Sequence[str]) -> DataFrame:
    """All rows of a key in order, wherever they stand."""
    rows = F.sort_array(F.collect_list(F.struct(*(col(c) for c in [*order, *(i for i in items if i not in order)]))))
    return df.groupBy(*(col(k) for k in keys)).agg(F.count(F.lit(1)).alias("n"), rows.alias("items"))


def distinct_until_changed(
    df: DataFrame, order: Sequence[str], value: Column, key: Sequence[str] = (), nan_differs: bool = False, spread: bool = False
) -> DataFrame:
    """Leave out a row whose value equals that of the row before (of its key). The first stays, even if null.

    With nan_differs, NaN differs from NaN, as in IEEE comparisons. spread is for keys that hold much of all rows.
    """
    seen = df.withColumn("__value", value)
    if key and spread:
        seen = blocked(seen, _columns(order), key, before=1)
        before, first = F.lag("__value").over(block_window(key)), F.col("rn") == 1
    elif key:
        before = F.lag("__value").over(Window.partitionBy(*(col(k) for k in key)).orderBy(*_columns(order)))
        first = F.row_number().over(Window.partitionBy(*(col(k) for k in key)).orderBy(*_columns(order))) == 1
    else:
        seen = blocked(seen, _columns(order), before=1, small_bytes=SMALL_BYTES)
        before, first = F.lag("__value").over(block_window()), F.col("rn") == 1
    marked = seen.withColumns({"__before": before, "__first": first})
    same = F.col("__before").eqNullSafe(F.col("__value"))
    if nan_differs:
        same = same & ~F.coalesce(F.isnan("__value"), F.lit(False))
    kept = marked.where(F.col("__first") | ~same).drop("__before", "__first", "__value")
    return kept if key and not spread else own_rows(kept).drop("rn")


def scan(df: DataFrame, order: Sequence[str], **sums: Column) -> DataFrame:
    """Running sums after each row; the start value isn't emitted. Counts are sums of 1."""
    return running_sums(df, [], _columns(order), sums, label="scan", small_bytes=SMALL_BYTES)


def running_extremes(df: DataFrame, order: Sequence[str], value: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running minimum and maximum of value after each row, from blocks and the extremes of the blocks before them."""
    block_rows = min(block_rows, settings.block_rows)
    placed = with_position(df.withColumn("__value", value), _columns(order), small_bytes=SMALL_BYTES)
    placed = placed.withColumn("__b", F.floor((F.col("rn") - 1) / block_rows))
    inside = Window.partitionBy("__b").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    blocks = placed.groupBy("__b").agg(F.min("__value").alias("lo"), F.max("__value").alias("hi"))
    base = blocks.select("__b", F.min("lo").over(earlier).alias("__lo"), F.max("hi").over(earlier).alias("__hi"))
    local = placed.withColumns({"running_min": F.min("__value").over(inside), "running_max": F.max("__value").over(inside)})
    joined = local.join(base, "__b", "left")
    joined = joined.withColumns({"running_min": F.least("running_min", "__lo"), "running_max": F.greatest("running_max", "__hi")})
    return joined.drop("__b", "__lo", "__hi", "__value", "rn")


def fold(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row of aggregates over the whole stream; with an empty stream those of no rows."""
    return df.agg(*(a.alias(n) for n, a in aggregates.items()))


def ordered_fold(df: DataFrame, order: Sequence[str], item: Column, init: Column, step, block_rows: int = BLOCK_ROWS, combine=None) -> DataFrame:  # noqa: ANN001
    """A fold whose step depends on the order. With combine, blocks are folded apart and their results combined in
    order; without, the whole stream must fit into one value, and more than block_rows rows are refused."""
    placed = with_position(df.withColumn("__item", item), _columns(order), small_bytes=SMALL_BYTES).select("rn", "__item")
    if combine is None:
        rows = F.transform(F.sort_array(F.collect_list(F.struct("rn", "__item"))), lambda x: x["__item"])
        checked = placed.where(F.when(F.col("rn") > block_rows, F.raise_error(F.lit("too many rows for a fold without combine"))).isNull())
        return checked.agg(F.aggregate(rows, init, step).alias("value"))
    block_rows = min(block_rows, settings.block_rows)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("rn", "__item"))), lambda x: x["__item"])
    blocks = placed.groupBy(F.floor((F.col("rn") - 1) / block_rows).alias("b")).agg(F.aggregate(rows, init, step).alias("v"))
    return blocks.agg(F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda x: x["v"]), init, combine).alias("value"))


def collected(df: DataFrame, order: Sequence[str], most: int | None = None) -> list:
    """The rows at the driver in order, the first most if given. Nothing is cut silently."""
    rows = df.orderBy(*_columns(order))
    return (rows if most is None else rows.limit(most)).collect()


def collected_set(df: DataFrame, value: Column, most: int) -> set:
    """The different values at the driver; more than most are refused."""
    rows = df.select(value.alias("v")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} different values")
    return {r.v for r in rows}
