"""One wide row per entity from events: counts, first and last times for each of hundreds of event types.

Where events are read, stretches of TOGETHER of them become runs (entity, type, count, first and last time), so that a hot
entity costs one row per type and stretch. Runs are bucketed by entity and sorted by (entity, type), the only shuffle; the
sorted runs are streamed into counters and wide rows, batch by batch.

Defined cases: rows without entity are left out; a null or unknown type counts in the entity's overall figures only;
a null time counts but sets no time; a type an entity never had gives 0 and null times; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.plans.ordering import col, free_name
from rillflow.plans.storage import shuffle_width

#: Entities per emitted batch; a batch holds ROWS x (3 types + 5) values of 8 bytes.
ROWS = 512
#: Events that are combined at once where they are read.
TOGETHER = 1 << 17
#: More types than this can't become columns.
MOST_TYPES = 1000
NO_TIME = np.iinfo(np.int64).min


def wide_features(events: DataFrame, types: Sequence[str], entity: str, kind: Column, at: Column) -> DataFrame:
    """events -> entity, n_messages, n_types, first_ms, last_ms and n_<t>, first_ms_<t>, last_ms_<t> per type."""
    number = free_name(events, "__number")
    return numbered_features(with_type_number(events, types, kind, number), types, entity, col(number), at)


def with_type_number(events: DataFrame, types: Sequence[str], kind: Column, name: str) -> DataFrame:
    """events with the place of their type in types, null if it is unknown: a number is cheaper to move than a name."""
    if len(types) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types can't become columns")
    known = events.sparkSession.createDataFrame([(t, i) for i, t in enumerate(types)], "__name string, __number_of smallint")
    joined = events.withColumn("__kind", kind).join(F.broadcast(known), F.col("__kind") == F.col("__name"), "left")
    return joined.select(*(col(c) for c in events.columns), F.col("__number_of").alias(name))


def numbered_features(events: DataFrame, types: Sequence[str], entity: str, number: Column, at: Column) -> DataFrame:
    """As wide_features, of events whose types are numbered already."""
    rows = events.where(F.col(entity).isNotNull())
    numbered = rows.select(F.col(entity).cast("bigint").alias("entity"), F.coalesce(number.cast("int"), F.lit(-1)).alias("kind"), at.alias("ms"))
    runs = numbered.mapInArrow(_runs, "entity bigint, kind int, n bigint, first bigint, last bigint")
    streamed = runs.repartition(shuffle_width(events), "entity").sortWithinPartitions("entity", "kind")
    fields = [f"{entity} bigint", "n_messages bigint", "n_types bigint", "first_ms bigint", "last_ms bigint"]
    fields += [f"`{p}_{t}` bigint" for t in types for p in ("n", "first_ms", "last_ms")]
    schema = pa.schema([(f.split(" ")[0].strip("`"), pa.int64()) for f in fields])
    n_types = len(types)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the entity that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_columns(batch))
            rows = np.concatenate(held, axis=1) if len(held) > 1 else held[0]
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last entity's rows begin here
            if cut:
                yield from _wide(rows[:, :cut], n_types, schema)
            held = [rows[:, cut:]]
        if held:
            yield from _wide(held[0], n_types, schema)

    return streamed.mapInArrow(stream, ", ".join(fields))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(_columns(batch))
        if sum(h.shape[1] for h in held) >= TOGETHER:
            yield _combined(np.concatenate(held, axis=1))
            held = []
    if held:
        yield _combined(np.concatenate(held, axis=1))


def _combined(rows: np.ndarray) -> pa.RecordBatch:
    """(entity, kind, time) -> a run for each entity and kind."""
    entity, kind, ms = rows[:, np.lexsort(rows[1::-1])]
    begins = np.flatnonzero(np.append(True, (entity[1:] != entity[:-1]) | (kind[1:] != kind[:-1]))[: len(entity)])
    n = np.diff(np.append(begins, len(entity)))
    if not len(begins):
        n, first, last = (np.empty(0, dtype=np.int64) for _ in range(3))
    else:
        first = np.minimum.reduceat(np.where(ms == NO_TIME, np.iinfo(np.int64).max, ms), begins)
        last = np.maximum.reduceat(ms, begins)
    columns = [pa.array(entity[begins]), pa.array(kind[begins].astype(np.int32)), pa.array(n), _times(first, last), _times(last, last)]
    return pa.RecordBatch.from_arrays(columns, names=["entity", "kind", "n", "first", "last"])


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty((batch.num_columns, batch.num_rows), dtype=np.int64)
    for i in range(batch.num_columns):
        out[i] = batch.column(i).cast(pa.int64()).fill_null(NO_TIME).to_numpy(zero_copy_only=False)
    return out


def _wide(rows: np.ndarray, n_types: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Whole entities, sorted -> wide batches."""
    entities, begins = np.unique(rows[0], return_index=True)
    for at in range(0, len(entities), ROWS):
        some = entities[at : at + ROWS]
        end = begins[at + ROWS] if at + ROWS < len(begins) else rows.shape[1]
        own = rows[:, begins[at] : end]
        place = np.searchsorted(some, own[0])
        n = np.zeros((n_types + 1, len(some)), dtype=np.int64)  # the last type stands for the unknown ones
        first = np.full((n_types + 1, len(some)), np.iinfo(np.int64).max, dtype=np.int64)
        last = np.full((n_types + 1, len(some)), NO_TIME, dtype=np.int64)
        np.add.at(n, (own[1], place), own[2])
        timed = own[3] != NO_TIME
        np.minimum.at(first, (own[1, timed], place[timed]), own[3, timed])
        np.maximum.at(last, (own[1, timed], place[timed]), own[4, timed])
        lasts, firsts = last.max(axis=0), first.min(axis=0)
        columns = [pa.array(some), pa.array(n.sum(axis=0)), pa.array((n[:n_types] > 0).sum(axis=0)), _times(firsts, lasts), _times(lasts, lasts)]
        for k in range(n_types):
            columns += [pa.array(n[k]), _times(first[k], last[k]), _times(last[k], last[k])]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _times(values: np.ndarray, last: np.ndarray) -> pa.Array:
    return pa.array(values, mask=last == NO_TIME)
