"""Event-time windows and time-window joins. The same functions take batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators import lateness
from rillflow.plans.ordering import col

SECOND_US = 1_000_000


@dataclass(frozen=True)
class TimeWindowConfig:
    """Sizes in microseconds; windows start at multiples of the slide since the epoch."""

    size_us: int = 60 * SECOND_US
    slide_us: int = 60 * SECOND_US
    watermark_delay_us: int = 10 * SECOND_US
    allowed_lateness_us: int = 5 * SECOND_US

    def __post_init__(self) -> None:
        if self.size_us <= 0 or self.slide_us <= 0:
            raise ValueError("windows need a positive size and slide")
        if self.slide_us > self.size_us:
            raise ValueError("a slide longer than the window would lose rows")


@dataclass(frozen=True)
class TimeJoinConfig:
    window_us: int = 60 * SECOND_US
    watermark_delay_us: int = 10 * SECOND_US


def _interval(us: int) -> str:
    return f"{us} microseconds"


def window_by_time(df: DataFrame, ts: str, config: TimeWindowConfig, aggregates: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """window_start, window_end, by... and aggregates. Aggregates are partial before the shuffle; ask for the events
    themselves only as F.collect_list. A streaming df is given a watermark of delay plus lateness."""
    rows = df.withColumn(ts, col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, _interval(config.watermark_delay_us + config.allowed_lateness_us))
    w = F.window(col(ts), _interval(config.size_us), _interval(config.slide_us))
    out = rows.groupBy(w.alias("__w"), *(col(b) for b in by)).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *(col(b) for b in by), *aggregates)


def window_by_arrival(df: DataFrame, arrival: str, ts: str, config: TimeWindowConfig, aggregates: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """As window_by_time, with lateness as a policy of its own: a window is corrected by each late row until the watermark
    before that row (the greatest time of the rows that arrived before, less the delay) has passed its end by the allowed
    lateness; later rows don't count. arrival is a unique whole number that rises with arrival. Times are taken in whole
    milliseconds; rows without time are left out.
    """
    sizes = (config.size_us, config.slide_us, config.watermark_delay_us, config.allowed_lateness_us)
    if any(us % 1000 for us in sizes):
        raise ValueError("times must be whole milliseconds")
    at = F.unix_millis(col(ts).cast("timestamp"))
    rows = df.select(col(arrival).cast("bigint").alias("seq"), F.lit("").alias("stream_name"), at.alias("ms"), F.lit(None).cast("bigint").alias("event_id"))
    names = ("window_size", "slide_interval", "watermark_delay", "allowed_lateness")
    conf = df.sparkSession.range(1).select(F.lit("").alias("stream_name"), *(F.lit(us // 1000).cast("bigint").alias(n) for n, us in zip(names, sizes, strict=True)))
    admitted = lateness.window_admissions(rows, conf, lateness.registers(rows)).select(F.col("seq").alias("__seq"), F.col("window_start_ms").alias("__start"), F.col("window_end_ms").alias("__end"))
    joined = df.join(admitted, col(arrival).cast("bigint") == F.col("__seq"))
    out = joined.groupBy("__start", "__end", *(col(b) for b in by)).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.timestamp_millis("__start").alias("window_start"), F.timestamp_millis("__end").alias("window_end"), *(col(b) for b in by), *aggregates)


def completed(windows: DataFrame, watermark: Column) -> DataFrame:
    """The windows whose end the watermark has reached."""
    return windows.where(F.col("window_end") <= watermark)


def join_with_time_window(
    left: DataFrame, right: DataFrame, ts_left: str, ts_right: str, config: TimeJoinConfig, keys: Sequence[str] = (), dedup_by_timestamps: bool = False
) -> DataFrame:
    """All pairs of equal keys whose times differ by at most the window: structs left and right.

    Each left row is copied to the three windows-long buckets a partner can lie in, so the join is an equi-join on keys
    and bucket even without keys, and a hot key is spread over time. Streams get watermarks, which bound their state.
    """
    a = left.select(*(col(k).alias(f"__k{i}") for i, k in enumerate(keys)), col(ts_left).cast("timestamp").alias("__lt"), F.struct(*(col(c) for c in left.columns)).alias("left"))
    b = right.select(*(col(k).alias(f"__r{i}") for i, k in enumerate(keys)), col(ts_right).cast("timestamp").alias("__rt"), F.struct(*(col(c) for c in right.columns)).alias("right"))
    same = [F.col(f"__k{i}") == F.col(f"__r{i}") for i in range(len(keys))]
    bucket = F.floor(F.unix_micros("__lt") / config.window_us).cast("bigint")
    if left.isStreaming:
        delay, reach = _interval(config.watermark_delay_us), F.expr(f"interval {config.window_us} microseconds")
        a, b = a.withWatermark("__lt", delay), b.withWatermark("__rt", delay)
        near = [F.col("__rt") >= F.col("__lt") - reach, F.col("__rt") <= F.col("__lt") + reach]
    else:
        near = [F.abs(F.unix_micros("__lt") - F.unix_micros("__rt")) <= config.window_us]
    a = a.withColumn("__lb", F.explode(F.sequence(bucket - 1, bucket + 1)))
    b = b.withColumn("__rb", F.floor(F.unix_micros("__rt") / config.window_us).cast("bigint"))
    joined = a.join(b, _all([*same, F.col("__lb") == F.col("__rb"), *near]))
    if dedup_by_timestamps:
        joined = joined.dropDuplicates(["__lt", "__rt"])
    return joined.select("left", "right")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
