"""Sessions by inactivity gap, by pairing starts with ends.

RANGE frames find instants without a predecessor (starts) or successor (ends) within the gap. Starts and ends are
numbered separately per user and joined on equal numbers; the events up to the end less those before the start are the
session's count. To spread a hot user, frames run over blocks of time: each instant is also handed to the neighbouring
block when it lies within the gap of the border, so the frames see all they need. Numbering is per user, but only over
starts or ends, of which a user can have one per gap of the time span at most.

Defined cases: rows without user or time are left out; equal instants are one instant with several events; a single
event is a session of zero duration; a pause of exactly the gap stays inside the session; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
GAP_MS = 30 * 60_000


def _marked(events: DataFrame, gap_ms: int, block_ms: int) -> DataFrame:
    """(user_id, ms, n, block, is_start, is_end, upto): one row per user and instant, in its own block only."""
    instants = (
        events.where(F.col("user_id").isNotNull() & F.col("ms").isNotNull())
        .groupBy("user_id", F.floor(F.col("ms") / block_ms).cast("bigint").alias("home"), "ms")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    into = F.col("ms") - F.col("home") * block_ms
    blocks = F.array_compact(
        F.array(
            F.col("home"),
            F.when(into < gap_ms, F.col("home") - 1),
            F.when(into >= block_ms - gap_ms, F.col("home") + 1),
        )
    )
    spread = instants.withColumn("block", F.explode(blocks))
    by_time = Window.partitionBy("user_id", "block").orderBy("ms")
    near = {
        "before": F.count(F.lit(1)).over(by_time.rangeBetween(-gap_ms, -1)),
        "after": F.count(F.lit(1)).over(by_time.rangeBetween(1, gap_ms)),
    }
    own = F.when(F.col("block") == F.col("home"), F.col("n")).otherwise(0)
    upto = F.sum(own).over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = spread.select("user_id", "block", "home", "ms", "n", *(c.alias(k) for k, c in near.items()), upto.alias("upto"))
    return marked.where(F.col("block") == F.col("home")).select(
        "user_id", "block", "ms", "n", "upto", (F.col("before") == 0).alias("is_start"), (F.col("after") == 0).alias("is_end")
    )


def sessions(events: DataFrame, gap_ms: int = GAP_MS, block_ms: int = DAY_MS, counts: bool = True) -> DataFrame:
    """events(user_id, ms) -> user_id, session_no, session_start_ms, session_end_ms, duration_ms and n_events.

    block_ms must be at least gap_ms. Without counts, n_events is left out and one aggregate less is made.
    """
    if block_ms < gap_ms:
        raise ValueError("a block must be at least as long as the gap")
    marked = _marked(events, gap_ms, block_ms)
    ends = marked.where(F.col("is_start") | F.col("is_end"))
    if counts:
        per_block = marked.groupBy("user_id", "block").agg(F.sum("n").alias("n_block"))
        earlier = Window.partitionBy("user_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offset = per_block.select("user_id", "block", F.coalesce(F.sum("n_block").over(earlier), F.lit(0)).alias("offset"))
        ends = ends.join(offset, ["user_id", "block"]).withColumn("upto", F.col("upto") + F.col("offset"))
    per_user = Window.partitionBy("user_id").orderBy("ms")
    # Starts and ends are numbered apart; one sort of both serves the two numberings.
    numbered = ends.select(
        "user_id", "ms", "n", "upto", "is_start", "is_end",
        F.count(F.when(F.col("is_start"), 1)).over(per_user).alias("start_no"),
        F.count(F.when(F.col("is_end"), 1)).over(per_user).alias("end_no"),
    )
    started = numbered.where("is_start").select("user_id", F.col("start_no").alias("session_no"), F.col("ms").alias("session_start_ms"), (F.col("upto") - F.col("n")).alias("before"))
    ended = numbered.where("is_end").select("user_id", F.col("end_no").alias("session_no"), F.col("ms").alias("session_end_ms"), "upto")
    paired = started.join(ended, ["user_id", "session_no"])
    out = paired.withColumn("duration_ms", F.col("session_end_ms") - F.col("session_start_ms"))
    if counts:
        out = out.withColumn("n_events", F.col("upto") - F.col("before"))
    return out.drop("upto", "before")


def session_type_counts(events: DataFrame, gap_ms: int = GAP_MS, block_ms: int = DAY_MS) -> DataFrame:
    """events(user_id, ms, activity_type) -> one row per session and activity type (null is a type) with n_activities.

    Each event takes the number of starts up to it as session number: those inside its block, counted in a window, plus
    those of the user's earlier blocks.
    """
    marked = _marked(events, gap_ms, block_ms)
    inside = Window.partitionBy("user_id", "block").orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = marked.select("user_id", "block", "ms", F.count(F.when(F.col("is_start"), 1)).over(inside).alias("started"))
    per_block = starts.groupBy("user_id", "block").agg(F.max("started").alias("n_block"))
    earlier = Window.partitionBy("user_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_block.select("user_id", "block", F.coalesce(F.sum("n_block").over(earlier), F.lit(0)).alias("offset"))
    placed = starts.join(offset, ["user_id", "block"]).select("user_id", "ms", (F.col("started") + F.col("offset")).alias("session_no"))
    typed = (
        events.where(F.col("user_id").isNotNull() & F.col("ms").isNotNull())
        .groupBy("user_id", "ms", "activity_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        typed.join(placed, ["user_id", "ms"])
        .groupBy("user_id", "session_no", "activity_type")
        .agg(F.sum("n").alias("n_activities"))
    )
