"""Positions and running sums in a total order, without moving a group into one task.

A window over a whole group (or over no group) sorts it in one task. Here rows are range-partitioned by (group, order),
so that a large group is spread over many partitions; each partition's share is summed, the shares (groups plus
partitions rows) are turned into offsets, and only the sum inside one partition is a window.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import WindowSpec

from rillflow.plans.sizing import written_if_small
from rillflow.plans.storage import materialize, shuffle_width

def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores before it until no column of df has that name (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


#: Estimated bytes up to which a whole stream is ordered in one task instead, by those who allow it.
SMALL_BYTES = 4 << 20
#: Rows of one block of a total order.
BLOCK_ROWS = 100_000


@dataclass
class Settings:
    """Upper bounds on what callers ask for; lowered to try the distributed forms on small tables."""

    small_bytes: int = SMALL_BYTES
    block_rows: int = BLOCK_ROWS


settings = Settings()


@contextlib.contextmanager
def distributed(block_rows: int = BLOCK_ROWS) -> Iterator[None]:
    """Plans made inside order even small streams by range partitions and blocks of at most so many rows."""
    before = settings.small_bytes, settings.block_rows
    settings.small_bytes, settings.block_rows = -1, block_rows
    try:
        yield
    finally:
        settings.small_bytes, settings.block_rows = before


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether the optimizer's estimate of df, from file sizes and widths, is within limit. Runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, Column],
    totals: bool = False,
    label: str = "running",
    small_bytes: int = 0,
) -> DataFrame:
    """Add for each measure the sum over its group's rows up to and including the row, in the given unique order.

    With totals, <name>_total is the sum over the whole group. Nulls in group columns form a group of their own; a
    null measure counts as 0. An empty df gives an empty result. Names in measures may not be those of group columns. A df
    estimated within small_bytes is summed by a plain window; a wrong estimate costs time, not rows.

    Rows are moved once: sorted range partitions are summed as they are streamed to the written table, and what earlier
    partitions hold of a group (one row per group and partition that hold each other) is added when it is read.
    """
    if small_bytes and is_small(df, min(small_bytes, settings.small_bytes)):
        return _plain_sums(df, group, order, measures, totals)
    place, groups = free_name(df, "__place"), [col(g) for g in group]
    names, summed = list(measures), [free_name(df, f"__sum_{i}") for i in range(len(measures))]
    weighted = df.withColumns({m: F.coalesce(c, F.lit(0)) for m, c in measures.items()})
    spread = weighted.repartitionByRange(shuffle_width(df), *groups, *order).sortWithinPartitions(*groups, *order)
    spread = spread.withColumn(place, F.monotonically_increasing_id())
    kinds = spread.agg(*(F.sum(col(m)).alias(n) for m, n in zip(names, summed, strict=True))).schema
    schema = StructType([*spread.schema.fields, *kinds.fields])
    which = ([spread.columns.index(c) for c in by] for by in (group, names))
    numbered = spread.toDF(*(f"c{i}" for i in range(len(spread.columns))))  # any name may come in here
    ranged = materialize(numbered.mapInArrow(_summing(*which, to_arrow_schema(schema)), schema), label)
    part = F.shiftright(col(place), 33)
    share = ranged.groupBy(*groups, part.alias("__p")).agg(*(F.sum(col(m)).alias(f"__share_{i}") for i, m in enumerate(names)))
    before = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = share.select(
        *(g.alias(f"__g{i}") for i, g in enumerate(groups)),
        "__p",
        *(F.coalesce(F.sum(f"__share_{i}").over(before), F.lit(0)).alias(f"__off_{i}") for i in range(len(names))),
        *(F.sum(f"__share_{i}").over(whole).alias(f"__tot_{i}") for i in range(len(names)) if totals),
    )
    same = [g.eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)] + [part == F.col("__p")]
    joined = ranged.join(written_if_small(offsets, "offsets"), _all(same))
    return joined.select(
        *(col(c) for c in df.columns if c not in measures),
        *((col(n) + F.col(f"__off_{i}")).alias(m) for i, (m, n) in enumerate(zip(names, summed, strict=True))),
        *(F.col(f"__tot_{i}").alias(f"{m}_total") for i, m in enumerate(names) if totals),
    )


def _summing(group: list[int], measures: list[int], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the sums so far of each group, the schema's last columns, to batches of rows sorted by group."""
    kinds = schema.types[len(schema) - len(measures) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None  # the last row's group
        upto: list = [0] * len(measures)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.select(group)
            known = pa.Table.from_batches([before, keys] if before is not None else [keys])
            changed = changes([c.combine_chunks() for c in known.columns], len(batch) + (before is not None))[-len(batch) :]
            run_no = np.cumsum(changed)
            goes_on = before is not None and not changed[0]
            sums = []
            for i, (m, kind) in enumerate(zip(measures, kinds, strict=True)):
                decimal = pa.types.is_decimal(kind)
                values = np.array(batch.column(m).to_pylist(), dtype=object) if decimal else batch.column(m).cast(kind).to_numpy(zero_copy_only=False).copy()
                if goes_on:
                    values[0] += upto[i]
                by_run = pd.Series(values).groupby(run_no)
                total = (by_run.transform(lambda v: v.cumsum()) if decimal else by_run.cumsum()).to_numpy()
                sums.append(pa.array(total, kind))
                upto[i] = total[-1]
            before = keys.slice(len(batch) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=schema.names)

    return run


def changes(columns: Sequence[pa.Array], n: int) -> np.ndarray:
    """Whether each of n rows differs from the one before in any column (null equals null, NaN equals NaN); the first does."""
    out = np.zeros(n, dtype=bool)
    out[:1] = True
    for c in columns:
        if pa.types.is_nested(c.type):
            values = c.to_pylist()
            out[1:] |= np.array([a != b for a, b in zip(values[1:], values[:-1], strict=True)], dtype=bool)
            continue
        here, there = c.slice(1), c.slice(0, max(n - 1, 0))
        differs = pc.fill_null(pc.not_equal(here, there), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(c.type):
            nan = pc.fill_null(pc.is_nan(c), False).to_numpy(zero_copy_only=False)
            differs = differs & ~(nan[1:] & nan[:-1])
        null = c.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= differs | (null[1:] != null[:-1])
    return out


def _plain_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], measures: Mapping[str, Column], totals: bool) -> DataFrame:
    whole = Window.partitionBy(*(col(g) for g in group))
    upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {m: F.coalesce(c, F.lit(0)) for m, c in measures.items()}
    return df.select(
        *(col(c) for c in df.columns if c not in measures),
        *(F.sum(c).over(upto).alias(m) for m, c in filled.items()),
        *(F.sum(c).over(whole).alias(f"{m}_total") for m, c in filled.items() if totals),
    )


def with_position(
    df: DataFrame, order: Sequence[Column], name: str = "rn", group: Sequence[str] = (), small_bytes: int = 0
) -> DataFrame:
    """Add the 1-based position of each row in the order (inside its group), as BIGINT.

    The rows are written sorted inside range partitions, each with its place there; a position is the distance from the
    first row of the group in the partition, plus the group's rows in earlier partitions. As long as those offsets (one
    row per group and partition that hold each other) are few, they are broadcast and the rows aren't moved again.
    """
    if small_bytes and is_small(df, min(small_bytes, settings.small_bytes)):
        return _plain_sums(df, group, order, {name: F.lit(1).cast("bigint")}, totals=False)
    place = free_name(df, "__place")
    groups = [col(g) for g in group]
    spread = df.repartitionByRange(shuffle_width(df), *groups, *order).sortWithinPartitions(*groups, *order)
    placed = materialize(spread.withColumn(place, F.monotonically_increasing_id()), "position")
    part = F.shiftright(col(place), 33)
    share = placed.groupBy(*groups, part.alias("__p")).agg(F.min(col(place)).alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = share.select(
        *(g.alias(f"__g{i}") for i, g in enumerate(groups)),
        "__p",
        (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__shift"),
    )
    same = [g.eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)] + [part == F.col("__p")]
    joined = placed.join(written_if_small(offsets, "offsets"), _all(same))
    return joined.select(*(col(c) for c in df.columns if c != name), (col(place) + F.col("__shift")).alias(name))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


HOME, BLOCK, OWN = "__home", "__block", "__own"


def blocked(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
    small_bytes: int = 0,
) -> DataFrame:
    """df cut into blocks of successive rows, for window functions with a bounded reach in a total order.

    Adds rn (position in the group), __block, and __own, which is false for the copies of the rows up to ``before``
    places ahead of a block and ``after`` places behind it. A window partitioned by (group, __block) and ordered by rn
    sees for each own row all it needs; keep the rows where __own holds afterwards.
    """
    block_rows = max(min(block_rows, settings.block_rows), before, after, 1)
    if max(before, after) > BLOCK_ROWS:
        raise ValueError("the reach must not exceed a block")
    placed = with_position(df, order, "rn", group, small_bytes)
    if small_bytes and is_small(df, min(small_bytes, settings.small_bytes)):
        return placed.withColumn(BLOCK, F.lit(0).cast("bigint")).withColumn(OWN, F.lit(True))
    home = F.floor((F.col("rn") - 1) / block_rows).cast("bigint")
    into = F.pmod(F.col("rn") - 1, F.lit(block_rows))
    also = [home]
    if after:
        also.append(F.when((into < after) & (home > 0), home - 1))
    if before:
        also.append(F.when(into >= block_rows - before, home + 1))
    spread = placed.withColumn(HOME, home).withColumn(BLOCK, F.explode(F.array_compact(F.array(*also))))
    return spread.withColumn(OWN, F.col(BLOCK) == F.col(HOME)).drop(HOME)


def block_window(group: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*(col(g) for g in group), BLOCK).orderBy("rn")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(BLOCK, OWN)
