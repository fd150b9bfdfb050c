"""Exact percentiles per group by a full distributed sort.

Values become runs (group, value, n), which is also the form to keep: runs of separate days or portions are added up by
``merge_runs``, and percentiles of the sum are those of all rows together. For percentiles the runs are range-sorted by
(group, value) over all partitions; counts per partition give each group's offset in each partition, target positions
are located by cumulative count, and neighbouring order statistics are interpolated. The error is 0.

Defined cases: null and NaN values are no values (infinite ones are); a null in a group column is a group; ties are one
run; a group without values gives no row; an empty table gives none. A value making up a third of all rows is one run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.plans.ordering import col, running_sums

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def value_runs(df: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """(group..., value, n): each distinct value with its count. Mergeable: see merge_runs."""
    rows = df.select(*(col(g) for g in group), value.cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    # -0.0 and 0.0 are one value.
    return rows.groupBy(*(col(g) for g in group), (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge_runs(runs: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    merged = runs[0]
    for more in runs[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy(*(col(g) for g in group), "value").agg(F.sum("n").alias("n"))


def percentiles_of_runs(runs: DataFrame, group: Sequence[str], wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    """group..., n_values, and for each wanted p a column p<100p> with the interpolated percentile."""
    summed = running_sums(runs.withColumn("upto", F.col("n")), group, [F.col("value")], {"upto": F.col("n")}, totals=True, label="percentiles")
    total, upto = F.col("upto_total"), F.col("upto")
    located, holds = {}, F.lit(False)
    for i, p in enumerate(wanted):
        place = (total - 1) * F.lit(float(p))  # 0-based, between two order statistics
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (at >= upto - F.col("n")) & (at < upto)
            located[f"{side}{i}"] = F.max(F.when(inside, F.col("value")))
            holds = holds | inside
    kept = summed.where(holds)  # at most two runs per percentile of each group are shuffled on
    found = kept.groupBy(*(col(g) for g in group)).agg(F.max("upto_total").alias("n_values"), *(c.alias(k) for k, c in located.items()))
    parts = []
    for i, p in enumerate(wanted):
        place = (F.col("n_values") - 1) * F.lit(float(p))
        share = place - F.floor(place)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        parts.append(F.when((share == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * share).alias(name_of(p)))
    return found.select(*(col(g) for g in group), "n_values", *parts)


def name_of(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def percentiles(df: DataFrame, group: Sequence[str], value: Column, wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    return percentiles_of_runs(value_runs(df, group, value), group, wanted)
