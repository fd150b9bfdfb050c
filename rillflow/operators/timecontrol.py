"""Time and rate control by event time, so that the same rows come out on every run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.sequence import running_extremes
from rillflow.plans.ordering import SMALL_BYTES, block_window, blocked, col, own_rows, with_position


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


STRATEGIES = ("block", "drop_oldest", "drop_newest", "error")


@dataclass(frozen=True)
class BackpressureConfig:
    """How rows that come together are held. The water marks are taken for compatibility and have no effect."""

    strategy: str = "block"
    buffer_size: int = 100
    low_watermark: int | None = None
    high_watermark: int | None = None

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.buffer_size < 1:
            raise ValueError("a buffer holds at least one row")


def auto_backpressure(df: DataFrame, order: Sequence[str], bucket: Column, config: BackpressureConfig | None = None) -> DataFrame:
    """backpressure as configured, by default lossless."""
    config = config or BackpressureConfig()
    return backpressure(df, order, bucket, config.buffer_size, config.strategy)


def throttle(df: DataFrame, order: Sequence[str], ts: str, every_us: int) -> DataFrame:
    """Add emit_us: nothing is dropped, but rows leave at least every_us apart, each no earlier than it came."""
    placed = with_position(df, [col(o) for o in order], "__place", small_bytes=SMALL_BYTES)
    spaced = (F.col("__place") - 1) * every_us
    ahead = running_extremes(placed, order, micros(col(ts)) - spaced)
    return ahead.withColumn("emit_us", F.col("running_max") + spaced).drop("running_min", "running_max", "__place")


def debounce(df: DataFrame, order: Sequence[str], ts: str, quiet_us: int) -> DataFrame:
    """The rows followed by more than quiet_us of silence, and the last."""
    framed = blocked(df, [col(o) for o in order], after=1, small_bytes=SMALL_BYTES)
    following = framed.withColumn("__next", F.lead(micros(col(ts))).over(block_window()))
    kept = own_rows(following).where(F.col("__next").isNull() | (F.col("__next") - micros(col(ts)) > quiet_us))
    return kept.drop("__next", "rn")


def sample(df: DataFrame, order: Sequence[str], ts: str, every_us: int, start_us: int = 0) -> DataFrame:
    """The last row of each interval counted from start_us; empty intervals give none. Adds interval_no."""
    number = F.floor((micros(col(ts)) - start_us) / every_us).cast("bigint")
    last = F.max_by(F.struct(*(col(c) for c in df.columns)), F.struct(*(col(o) for o in order)))
    return df.groupBy(number.alias("interval_no")).agg(last.alias("__row")).select("interval_no", "__row.*")


def timeout(df: DataFrame, order: Sequence[str], ts: str, limit_us: int) -> DataFrame:
    """Add err_kind, null for the rows; before a row that came k whole limits after the one before it, k rows with
    err_kind 'Timeout' and the times at which the limit passed, their other columns null."""
    framed = blocked(df, [col(o) for o in order], before=1, small_bytes=SMALL_BYTES)
    now = micros(col(ts))
    gaps = own_rows(framed.withColumn("__last", F.lag(now).over(block_window())))
    missed = F.floor((now - F.col("__last")) / limit_us)
    marks = gaps.where(missed >= 1).select(F.col("__last"), F.explode(F.sequence(F.lit(1).cast("bigint"), missed)).alias("__k"))
    at = F.timestamp_micros(F.col("__last") + F.col("__k") * limit_us).cast(df.schema[ts].dataType)
    marked = marks.select(*((at if c == ts else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns), F.lit("Timeout").alias("err_kind"))
    return df.withColumn("err_kind", F.lit(None).cast("string")).unionByName(marked)


def backpressure(df: DataFrame, order: Sequence[str], bucket: Column, limit: int = 100, strategy: str = "block") -> DataFrame:
    """What a buffer of limit rows lets through of the rows that come together (in one bucket, such as a trigger).

    block keeps all; drop_oldest the last limit; drop_newest the first limit; error fails if a bucket has more.
    """
    if strategy == "block":
        return df
    rows = df.withColumn("__bucket", bucket)
    if strategy == "error":
        n = F.count(F.lit(1)).over(Window.partitionBy("__bucket"))
        checked = rows.withColumn("__n", F.when(n > limit, F.raise_error(F.lit(f"more than {limit} rows in a bucket")).cast("bigint")).otherwise(n))
        return checked.where(F.col("__n") > 0).drop("__n", "__bucket")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    places = [col(o).desc() if strategy == "drop_oldest" else col(o) for o in order]
    number = F.row_number().over(Window.partitionBy("__bucket").orderBy(*places))
    # Spark keeps only limit rows of each bucket on the map side (window group limit).
    return rows.withColumn("__rn", number).where(F.col("__rn") <= limit).drop("__rn", "__bucket")


def prefetch(df: DataFrame, n: int = 1) -> DataFrame:
    """Reading ahead is Spark's own; the rows are the same."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df


def rate_limited(options: dict[str, str] | None = None, files_per_trigger: int | None = None, offsets_per_trigger: int | None = None) -> dict[str, str]:
    """Options of a streaming reader that bound what a micro-batch takes."""
    out = dict(options or {})
    if files_per_trigger is not None:
        out["maxFilesPerTrigger"] = str(files_per_trigger)
    if offsets_per_trigger is not None:
        out["maxOffsetsPerTrigger"] = str(offsets_per_trigger)
    return out
