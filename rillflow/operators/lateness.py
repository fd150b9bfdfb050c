"""Event-time counts under late and out-of-order arrival, with conflict-free counters.

Arrivals may be read in portions of whole segments (``segment`` consecutive sequence numbers), in any order and again.
Two kinds of state are made of a portion; both are keyed by a period, a source and a version that follows the sequence
numbers, and both merge by the greatest version of each source, so that retries and reordering change nothing:

* registers of the greatest event time: the period is a stream, the sources are its segments. The watermark before a row
  is the greatest register of earlier sources and of the row's own source up to the row, less the delay;
* counters of events: the period is a stream's window, the sources are the events, each of which owns its deliveries and
  counts 1 however often it is sent, in whatever portions. A period's value is the sum over its sources.

Counters of a portion need the merged registers of all portions before it, so registers are merged first. Windows that
can't change any more are closed: their counters become one of the period itself, which stands for all of its sources.

Defined cases: a row without event time neither moves the watermark nor counts; a stream without configuration admits
nothing and has no late rows; before a stream's first dated row there is no watermark, so nothing is late; an event
sent again is judged again but counted once per window; one without event_id can't be recognised and is a source of its
own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.plans.sizing import broadcast_if_small
from rillflow.plans.storage import materialize

#: Sequence numbers of a segment, and segments that are summed up as one when registers are put in order.
SEGMENT, SPAN = 4_096, 4_096
PERIOD = ["stream_name", "window_start_ms", "window_end_ms"]


def _segment(segment: int) -> Column:
    return F.floor(F.col("seq") / segment).cast("bigint")


def portions(events: DataFrame, n: int, segment: int = SEGMENT) -> list[DataFrame]:
    """events cut into n portions of whole segments by sequence number, each a filter that reaches the scan."""
    least, most = events.agg(F.min("seq"), F.max("seq")).first()
    if least is None:
        return [events]
    first, last = least // segment, most // segment + 1
    bounds = [(first + (last - first) * i // n) * segment for i in range(n)] + [last * segment]
    return [events.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if a < b]


def registers(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(stream_name, source, version, high): the greatest event time of each stream and segment, up to a sequence number."""
    return events.groupBy("stream_name", _segment(segment).alias("source")).agg(F.max("seq").alias("version"), F.max("ms").alias("high"))


def merge_states(states: Sequence[DataFrame], period: Sequence[str], value: str, source: Sequence[str] = ("source",)) -> DataFrame:
    """Join of states: of each period and source the value with the greatest version (equal versions have equal values)."""
    merged = reduce(DataFrame.unionByName, states)
    return merged.groupBy(*period, *source).agg(F.max("version").alias("version"), F.max_by(value, "version").alias(value))


def _bases(merged: DataFrame, segment_span: int = SPAN) -> DataFrame:
    """(stream_name, source, base): the greatest register of the stream's earlier sources.

    Two levels: a stream's spans of sources are put in order in one task, the sources only inside their span.
    """
    spanned = merged.select("stream_name", "source", "high", F.floor(F.col("source") / segment_span).alias("span"))
    ahead = Window.partitionBy("stream_name").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spanned.groupBy("stream_name", "span").agg(F.max("high").alias("high"))
    spans = spans.select("stream_name", "span", F.max("high").over(ahead).alias("before_span"))
    inside = Window.partitionBy("stream_name", "span").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    local = spanned.select("stream_name", "span", "source", F.max("high").over(inside).alias("in_span"))
    joined = local.join(spans, local["stream_name"].eqNullSafe(spans["stream_name"]) & (local["span"] == spans["span"]))
    return joined.select(local["stream_name"], "source", F.greatest("in_span", "before_span").alias("base"))


def with_watermark_before(events: DataFrame, merged: DataFrame, segment: int = SEGMENT, carry: Sequence[str] = ()) -> DataFrame:
    """seq, stream_name, ms, the columns named in carry, source, and high_before, the greatest ms of the stream's earlier
    rows, from the merged registers of (at least) all portions up to this one. Other columns are left out, so that no name can clash."""
    rows = events.select("seq", "stream_name", "ms", *carry, _segment(segment).alias("source"))
    inside = Window.partitionBy("stream_name", "source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local_high", F.max("ms").over(inside))
    joined = local.join(_bases(merged), ["stream_name", "source"], "left")
    return joined.withColumn("high_before", F.greatest("local_high", "base")).drop("local_high", "base")


def judged(events: DataFrame, config: DataFrame, merged: DataFrame, segment: int = SEGMENT, carry: Sequence[str] = ()) -> DataFrame:
    """Dated rows of configured streams with last_start (start of their last window) and watermark."""
    conf = config.select("stream_name", "window_size", "slide_interval", "watermark_delay", "allowed_lateness")
    rows = with_watermark_before(events, merged, segment, carry).join(broadcast_if_small(conf), "stream_name")
    last_start = _floor_to(F.col("ms"), F.col("slide_interval"))
    return rows.where(F.col("ms").isNotNull()).withColumns(
        {"last_start": last_start, "watermark": F.col("high_before") - F.col("watermark_delay")}
    )


def merged_registers(parts: Sequence[DataFrame], segment: int = SEGMENT) -> DataFrame:
    """The registers of all portions, merged and written: one row per stream and segment."""
    return materialize(merge_states([registers(p, segment) for p in parts], ["stream_name"], "high"), "registers")


def too_late(events: DataFrame, config: DataFrame, segment: int = SEGMENT, merged: DataFrame | None = None) -> DataFrame:
    """The rows that not even their last window admits, so that no counter holds them."""
    merged = registers(events, segment) if merged is None else merged
    limit = F.col("last_start") + F.col("window_size") + F.col("allowed_lateness")
    return judged(events, config, merged, segment).where(F.col("watermark") >= limit)


def window_admissions(events: DataFrame, config: DataFrame, merged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per dated row and window that holds it and still admits it: stream_name, window_start_ms, window_end_ms, seq, event_id."""
    rows = judged(events, config, merged, segment, carry=["event_id"])
    first = _floor_to(F.col("ms") - F.col("window_size"), F.col("slide_interval")) + F.col("slide_interval")
    starts = F.when(first <= F.col("last_start"), F.sequence(first, F.col("last_start"), F.col("slide_interval")))
    each = rows.withColumn("window_start_ms", F.explode(starts)).withColumn("window_end_ms", F.col("window_start_ms") + F.col("window_size"))
    return each.where(F.col("watermark").isNull() | (F.col("watermark") < F.col("window_end_ms") + F.col("allowed_lateness")))


#: What tells an event's counter: its event_id, or the sequence number of a row without one; null for a closed period.
SOURCE = ["source", "identified"]


def counters(events: DataFrame, config: DataFrame, merged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(stream_name, window_start_ms, window_end_ms, source, identified, version, n): the counters of a portion."""
    admitted = window_admissions(events, config, merged, segment)
    owner = F.coalesce("event_id", "seq").alias("source"), F.col("event_id").isNotNull().alias("identified")
    return admitted.groupBy(*PERIOD, *owner).agg(F.max("seq").alias("version"), F.lit(1).cast("bigint").alias("n"))


def merge_counters(states: Sequence[DataFrame]) -> DataFrame:
    return merge_states(states, PERIOD, "n", SOURCE)


def closed(state: DataFrame, config: DataFrame, merged: DataFrame) -> DataFrame:
    """state with the counters of each window that admits nothing any more as one of the period itself.

    That is final, so what is merged later with the same period is not added to it.
    """
    reached = merged.groupBy("stream_name").agg(F.max("high").alias("reached"))
    limits = config.join(reached, "stream_name").select("stream_name", (F.col("reached") - F.col("watermark_delay") - F.col("allowed_lateness")).alias("upto"))
    rows = state.join(broadcast_if_small(limits), "stream_name", "left")
    done = F.coalesce(F.col("window_end_ms") <= F.col("upto"), F.lit(False))
    final = totals(rows.where(done).drop("upto"), ["version"])
    final = final.select(*PERIOD, F.lit(None).cast("bigint").alias("source"), F.lit(None).cast("boolean").alias("identified"), "version", F.col("n_events").alias("n"))
    return rows.where(~done).select(final.columns).unionByName(final)


def totals(state: DataFrame, latest: Sequence[str] = ()) -> DataFrame:
    """PERIOD and n_events: a closed period's own counter, else the sum over its sources; and the greatest of latest."""
    own = F.max(F.when(F.col("source").isNull(), F.col("n")))
    return state.groupBy(*PERIOD).agg(*(F.max(c).alias(c) for c in latest), F.coalesce(own, F.sum("n")).alias("n_events"))


def _floor_to(value: Column, step: Column) -> Column:
    return value - F.pmod(value, step)
