"""Sources mixed to target shares of the total size, by weighted fair queueing.

Every document of a source is queued in shuffled order, the whole source again for each further repetition. A queued
document's virtual finish time is the source's cumulative size up to it divided by the source's target weight. All
queues are range-sorted by finish time and cut where the cumulative size reaches the budget, so that each source ends
within one document of its share. Both cumulative sums are taken partition by partition with offsets, so neither a
source holding a third of all documents nor the whole is summed in one task.

The budget is the largest one for which every source that has anything can keep its share without repeating a document
more than max_repeats times, or the given one if that is less: shares come before size. Defined cases: sources without target, null among them, are left out;
targets of sources that have no tokens are reported with 0 and their weight is spread over the others in proportion;
documents of null or 0 size are left out; shares or repeats that are null or not above 0 count as no target; an empty
table gives an empty selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.plans.ordering import running_sums
from rillflow.plans.sizing import written_if_small
from rillflow.plans.storage import materialize

SEED = 20_011


def plan(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """source, weight, copies, budget, horizon and limits of each source that takes part, from sized(doc_id, source, n_tokens).

    limits tells the sources that would run out first. No document with a finish time above the horizon can be selected:
    up to it each source has queued its share of the budget, as its queue then ends or lacks one document at most.
    """
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", F.col("max_repeats").cast("bigint").alias("max_repeats"))
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    # From here there is at most one row per target; sums over all of them are windows over one partition.
    every = Window.partitionBy(F.lit(0))
    weighted = wanted.join(held, "source").withColumn("weight", F.col("target_share") / F.sum("target_share").over(every))
    weighted = weighted.withColumn("reach", F.col("tokens") * F.col("max_repeats") / F.col("weight"))
    most = F.floor(F.min("reach").over(every))
    out = weighted.withColumn("budget", (F.least(F.lit(budget), most) if budget is not None else most).cast("bigint"))
    out = out.withColumn("horizon", F.col("budget") + F.max(F.col("longest") / F.col("weight")).over(every))
    copies = F.least("max_repeats", F.ceil(F.col("weight") * F.col("horizon") / F.col("tokens")))
    return out.select("source", "weight", copies.cast("bigint").alias("copies"), "budget", "horizon", (F.floor("reach") == most).alias("limits"))


def mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """-> source, doc_id, copy, n_tokens, virtual_finish, cumulative_tokens of the selected documents."""
    return mix_and_plan(sized, targets, budget, seed)[0]


def mix_and_plan(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    some = materialize(sized.select("doc_id", "source", "n_tokens").where("source IS NOT NULL AND n_tokens > 0"), "mix-sizes")
    parts = written_if_small(plan(some, targets, budget), "mix-weights")
    queued = some.join(parts.drop("limits"), "source").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    queued = queued.drop("copies").withColumn("place", F.xxhash64("doc_id", "copy", F.lit(seed)))
    summed = running_sums(queued, ["source"], [F.col("copy"), F.col("place"), F.col("doc_id")], {"queued_tokens": F.col("n_tokens")}, label="mix-queue")
    timed = summed.drop("place").withColumn("virtual_finish", F.col("queued_tokens") / F.col("weight")).where("virtual_finish <= horizon")
    timed = timed.drop("queued_tokens", "weight", "horizon")
    ordered = running_sums(timed, [], [F.col("virtual_finish"), F.col("source"), F.col("copy"), F.col("doc_id")], {"cumulative_tokens": F.col("n_tokens")}, label="mix-order")
    chosen = ordered.where(F.col("cumulative_tokens") <= F.col("budget"))
    return chosen.select("source", "doc_id", "copy", "n_tokens", "virtual_finish", "cumulative_tokens"), parts


def shares(selected: DataFrame, targets: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Per target: source, target_share, n_tokens, actual_share, n_documents, most_copies, and with the plan limits:
    whether it is the source whose documents and repeats bound the budget."""
    got = selected.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n_documents"), F.max("copy").alias("most_copies"))
    both = targets.select("source", "target_share").join(got, "source", "left")
    tokens = F.coalesce("n_tokens", F.lit(0))
    both = both.join(parts.select("source", "limits"), "source", "left") if parts is not None else both
    return both.select(
        "source", "target_share", tokens.alias("n_tokens"),
        F.coalesce(tokens / F.sum("n_tokens").over(Window.partitionBy(F.lit(0))), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        *([F.coalesce("limits", F.lit(False)).alias("limits")] if parts is not None else []),
    )
