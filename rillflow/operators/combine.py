"""Several ordered streams into one. Inputs have the same columns; the result has src (input number) and its order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.plans.ordering import SMALL_BYTES, col, with_position

SRC = "src"


def concat(streams: Sequence[DataFrame]) -> DataFrame:
    """One after the other: the order is (src, order of the input)."""
    if not streams:
        raise ValueError("nothing to concatenate")
    return reduce(DataFrame.unionByName, (s.withColumn(SRC, F.lit(i)) for i, s in enumerate(streams)))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both; the order between the two is that of concat."""
    return concat([left, right])


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both in no particular order."""
    return left.unionByName(right)


def par_join(streams: Sequence[DataFrame]) -> DataFrame:
    """The rows of all inner streams in no particular order; all run in parallel."""
    return concat(streams).drop(SRC)


def interleave(streams: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Round robin: adds turn and src, by which the result is ordered. An exhausted input loses its turns."""
    placed = [with_position(s, [col(o) for o in order], "turn", small_bytes=SMALL_BYTES).withColumn(SRC, F.lit(i)) for i, s in enumerate(streams)]
    return reduce(DataFrame.unionByName, placed)


def zipped(left: DataFrame, right: DataFrame, order_left: Sequence[str], order_right: Sequence[str]) -> DataFrame:
    """Pairs by position up to the end of the shorter: rn, left and right as structs."""
    a = with_position(left, [col(o) for o in order_left], small_bytes=SMALL_BYTES).select("rn", F.struct(*(col(c) for c in left.columns)).alias("left"))
    b = with_position(right, [col(o) for o in order_right], small_bytes=SMALL_BYTES).select("rn", F.struct(*(col(c) for c in right.columns)).alias("right"))
    return a.join(b, "rn")


def zip_with(left: DataFrame, right: DataFrame, order_left: Sequence[str], order_right: Sequence[str], **columns: Column) -> DataFrame:
    """zipped, mapped by expressions over left and right."""
    pairs = zipped(left, right, order_left, order_right)
    return pairs.select("rn", *(c.alias(n) for n, c in columns.items()))
