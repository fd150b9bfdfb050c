"""Sources: streams made from values, generators, clocks and files.

Each source has an explicit position column, as rows of a DataFrame have no order of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators.media import chunk_type_of, priority_of

SEQ = "seq"
#: Values taken from an iterator by the driver at once.
ITER_BATCH = 50_000


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """No elements."""
    return spark.createDataFrame([], schema)


def from_rows(spark: SparkSession, rows: Iterable[Any], schema: str) -> DataFrame:
    """The rows of a finite iterable held by the driver, with their position in seq. Scalars make rows of one column."""
    numbered = [(i, *(r if isinstance(r, (tuple, list)) else (r,))) for i, r in enumerate(rows)]
    return spark.createDataFrame(numbered, f"{SEQ} bigint, {schema}")


def emit(spark: SparkSession, item: Any, schema: str) -> DataFrame:
    """One element."""
    return from_rows(spark, [item], schema)


def evaluated(spark: SparkSession, f: Callable[[], Any], schema: str) -> DataFrame:
    """The single value of a function called now."""
    return emit(spark, f(), schema)


def repeat(spark: SparkSession, item: Column, times: int, name: str = "value") -> DataFrame:
    """A constant, times times; generated by the executors."""
    return spark.range(times).select(F.col("id").alias(SEQ), item.alias(name))


def emit_after(spark: SparkSession, item: Any, schema: str, start: str, delay: str) -> DataFrame:
    """One element with emit_ts, start plus a delay such as '5 seconds'."""
    return emit(spark, item, schema).withColumn("emit_ts", F.expr(f"timestamp '{start}' + interval {delay}"))


def unfold(spark: SparkSession, columns: str, seed: str, step: str, until: str, most: int = 100) -> DataFrame:
    """A seeded generator of SQL expressions: rows of columns beginning with seed, each the step of the one before, while
    until holds of the last. E.g. ("a, b", "0L, 1L", "b, a + b", "a < 50"); until may use seq, the row's number from 0.

    Fails if it would go on after most rows.
    """
    names = ", ".join(c.strip() for c in columns.split(","))
    return spark.sql(
        f"WITH RECURSIVE u({SEQ}, {names}) MAX RECURSION LEVEL {most} AS ("
        f"SELECT 0L, {seed} UNION ALL SELECT {SEQ} + 1, {step} FROM u WHERE ({until})) SELECT * FROM u"
    )


def unfold_with(spark: SparkSession, seed: Any, f: Callable[[Any], tuple[Any, Any] | None], schema: str, most: int) -> DataFrame:
    """As unfold for any Python function from state to (value, next state), or None at the end. Fails after most rows."""

    def values() -> Iterator[Any]:
        state, n = seed, 0
        while (out := f(state)) is not None:
            value, state = out
            n += 1
            if n > most:
                raise ValueError(f"more than {most} rows")
            yield value

    return from_rows(spark, values(), schema)


def tick(spark: SparkSession, item: Column, start: str, end: str, period: str, name: str = "value") -> DataFrame:
    """A constant at each period from start up to end, with its time in ts."""
    times = F.explode(F.expr(f"sequence(timestamp '{start}', timestamp '{end}', interval {period})"))
    return spark.range(1).select(times.alias("ts")).select("ts", item.alias(name))


def ticking(spark: SparkSession, item: Column, rows_per_second: int = 1, name: str = "value") -> DataFrame:
    """The unbounded form of tick, as a streaming source."""
    stream = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return stream.select(F.col("timestamp").alias("ts"), F.col("value").alias(SEQ), item.alias(name))


#: Bytes of a file that one row of the plan stands for.
RANGE_BYTES = 8 << 20
#: Bytes that a task holds at once, or one chunk.
BATCH_BYTES = 1 << 20


def file_chunks(spark: SparkSession, path: str, stream_id: str, chunk_size: int) -> DataFrame:
    """A file's bytes in chunks of chunk_size, numbered from 0, in the form of media chunks.

    The last chunk is final. An empty file gives no chunk. Tasks read ranges of whole chunks, of which they hold a few at a time.
    """
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    step = max(1, RANGE_BYTES // chunk_size)
    count = F.ceil(F.col("length") / chunk_size)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1, F.lit(step).cast("bigint"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for row in batch.to_pylist():
                system, name = FileSystem.from_uri(row["path"])
                with system.open_input_file(name) as file:
                    file.seek(row["first"] * chunk_size)
                    stop = min(row["first"] + step, -(-row["length"] // chunk_size))
                    together = max(1, BATCH_BYTES // chunk_size)
                    for a in range(row["first"], stop, together):
                        numbers = list(range(a, min(a + together, stop)))
                        data = [file.read(chunk_size) for _ in numbers]
                        last = [(n + 1) * chunk_size >= row["length"] for n in numbers]
                        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(data, pa.binary()), pa.array(last)], names=["sequence_number", "data", "is_final"])

    numbered = ranges.repartition(F.col("path"), F.col("first")).mapInArrow(read, "sequence_number bigint, data binary, is_final boolean")
    return as_chunks(numbered, stream_id)


def live_chunks(spark: SparkSession, stream_id: str, max_chunks: int, chunk_size: int) -> DataFrame:
    """Zero-filled chunks as of a camera, one each 33 ms."""
    zeros = F.unhex(F.repeat(F.lit("00"), F.lit(chunk_size)))
    numbered = spark.range(max_chunks).select(F.col("id").alias("sequence_number"), zeros.alias("data"), F.lit(False).alias("is_final"))
    return as_chunks(numbered, stream_id)


def as_chunks(numbered: DataFrame, stream_id: str) -> DataFrame:
    seq = F.col("sequence_number")
    return numbered.select(
        F.lit(stream_id).alias("stream_id"), "sequence_number", "data", chunk_type_of(seq).alias("chunk_type"), priority_of(seq).alias("priority"),
        (seq * 33).alias("timestamp_ms"), "is_final", F.sha2("data", 256).alias("checksum"),
    )


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)
