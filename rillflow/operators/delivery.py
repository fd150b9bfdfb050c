"""Messages delivered at least once: keep exactly one copy of each.

``RunStore`` is hash-bucketed storage of sorted runs by identifier. An upsert collapses its batch by identifier (before
and after the shuffle) and writes it as one sorted run; several batches are written as runs of their own in one pass.
Compaction merges the runs of each bucket, without a shuffle, in the order of identifier and version (by Spark's sort, which
takes sorted runs as they are), and keeps the first of equal identifiers. Applying a batch again changes nothing.

Defined cases: a null identifier equals no other (each such row is a message); ties of identifier and version can't be
told apart and give one row; an empty table gives an empty result; columns with clashing names are left alone, as only
the named ones are read. A single identifier with a large part of all rows costs one row per map task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.identity import label_key, uuid_key
from rillflow.plans.storage import new_path, new_table, shuffle_width

KEY, VERSION, RUN = "rf_key", "rf_version", "rf_run"


class RunStore:
    """Sorted runs in hash buckets, one external bucketed table in the shared folder, removed with the run's other tables."""

    def __init__(self, spark: SparkSession, buckets: int, label: str = "runs"):
        self.spark, self.buckets = spark, buckets
        self.path = new_path(spark, label)
        self.table = new_table(label)
        self.runs = 0

    def upsert(self, *batches: DataFrame) -> RunStore:
        """Write each batch (KEY, VERSION) as a run of one row per identifier, sorted within its bucket."""
        for batch in batches:
            self._write(batch.groupBy(KEY).agg(F.min(VERSION).alias(VERSION)).withColumn(RUN, F.lit(self.runs)))
            self.runs += 1
        return self

    def upsert_batches(self, rows: DataFrame, batch: Column, runs: int) -> RunStore:
        """Write rows (KEY, VERSION, ...) as so many runs, the rows of each batch in one of them, reading them once."""
        which = F.pmod(F.coalesce(batch, F.lit(0)), F.lit(runs))
        least = rows.groupBy(KEY).agg(*(F.min(F.when(which == i, F.col(VERSION))).alias(f"rf_{i}") for i in range(runs)))
        each = F.array(*(F.struct(F.lit(self.runs + i).alias(RUN), F.col(f"rf_{i}").alias(VERSION)) for i in range(runs)))
        self._write(least.select(KEY, F.inline(each)).where(F.col(VERSION).isNotNull()).select(KEY, VERSION, RUN))
        self.runs += runs
        return self

    def _write(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").partitionBy(RUN).bucketBy(self.buckets, KEY).sortBy(KEY).mode("append")
        writer.option("path", self.path).saveAsTable(self.table)

    def compacted(self) -> DataFrame:
        """One row (KEY, VERSION) per identifier: the least version over all runs. The scan keeps the buckets."""
        by_key = Window.partitionBy(KEY).orderBy(VERSION)
        merged = self.spark.table(self.table).select(KEY, VERSION, F.row_number().over(by_key).alias("rf_copy"))
        return merged.where("rf_copy = 1").drop("rf_copy")

    def compact(self) -> RunStore:
        """Replace the runs by one merged run in a new store."""
        merged = RunStore(self.spark, self.buckets)
        merged._write(self.compacted().withColumn(RUN, F.lit(0)))
        merged.runs = 1
        return merged


def activity_key(identifier: Column, row: Column) -> Column:
    """The UUID as 16 bytes, whatever its spelling; other identifiers as longer bytes; null as a key of its row alone."""
    text = uuid_key(identifier)
    return (
        F.when(text.isNull(), F.concat(F.lit("row without identifier: "), row.cast("string")).cast("binary"))
        .when(text.startswith("?"), F.concat(F.lit("other identifier: "), text).cast("binary"))
        .otherwise(F.unhex(text))
    )


def chunk_key(stream_id: Column, sequence_number: Column, row: Column) -> Column:
    """Equal for equal sequence number and stream id, letter case and surrounding blanks aside."""
    named = F.concat(sequence_number.cast("string"), F.lit(":"), label_key(stream_id))
    return F.coalesce(named, F.concat(F.lit("row without identifier: "), row.cast("string"))).cast("binary")


def surviving_versions(df: DataFrame, key: Column, version: str, batch: str, runs: int = 2) -> DataFrame:
    """The versions to keep (KEY, VERSION), by upserting df in as many runs of batches and compacting them."""
    rows = df.select(key.alias(KEY), F.col(version).alias(VERSION), F.col(batch).alias("rf_batch"))
    return RunStore(df.sparkSession, shuffle_width(df)).upsert_batches(rows, F.col("rf_batch"), runs).compacted()


def superfluous(df: DataFrame, key: Column, version: str, batch: str, runs: int = 2) -> DataFrame:
    """The versions of df that compaction removed. version must be unique; the join on it can't be skewed."""
    kept = surviving_versions(df, key, version, batch, runs).select(F.col(VERSION).alias(version))
    return df.select(version).join(kept, version, "left_anti")


def kept_rows(df: DataFrame, key: Column, version: str, batch: str, runs: int = 2) -> DataFrame:
    """The rows of df that stay: exactly one of each message."""
    kept = surviving_versions(df, key, version, batch, runs).select(F.col(VERSION).alias(version))
    return df.join(kept, version, "left_semi")


def collapse(df: DataFrame, key: Column, version: str, keep: list[Column]) -> DataFrame:
    """One row per message with the columns keep of its least version, in one shuffle by identifier.

    Copies collapse on the map side first, so an identifier delivered very often costs one row per task.
    """
    rows = df.select(key.alias(KEY), F.col(version).alias(VERSION), F.struct(*keep).alias("rf_row"))
    return rows.groupBy(KEY).agg(F.min_by("rf_row", VERSION).alias("rf_row")).select("rf_row.*")
