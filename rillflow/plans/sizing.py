"""Checked broadcasts and partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.plans.storage import materialize

#: A side is broadcast only when it has at most so many rows.
BROADCAST_ROWS = 50_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most max_rows rows, else df as it is (a shuffled join).

    For tables that can be read again cheaply; see written_if_small for results of long plans.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def written_if_small(df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """As broadcast_if_small, but df is computed once and written, and the written table is counted and sent."""
    return broadcast_if_small(materialize(df, label), max_rows)


def spread_if_few(df: DataFrame) -> DataFrame:
    """df dealt out anew if it has fewer partitions than there are cores, for work that costs far more than moving rows.

    Large inputs have more partitions than cores and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
