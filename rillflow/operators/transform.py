"""Projection, filtering and expansion: narrow plans that Catalyst fuses into the scan.

User logic is given as Column expressions; a pandas function is the way out where none will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.plans.ordering import SMALL_BYTES, col, with_position


def mapped(df: DataFrame, **columns: Column) -> DataFrame:
    """Each element to a new one of the named columns."""
    return df.select(*(c.alias(n) for n, c in columns.items()))


def filtered(df: DataFrame, predicate: Column) -> DataFrame:
    """The elements for which predicate is true; null counts as false."""
    return df.where(predicate)


def flat_mapped(df: DataFrame, array: Column, name: str, keep: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """Each element to those of an array made from it, in order; position names a column for the place in the array."""
    kept = [col(k) for k in keep]
    if position:
        return df.select(*kept, F.posexplode(array).alias(position, name))
    return df.select(*kept, F.explode(array).alias(name))


def filter_mapped(df: DataFrame, expression: Column, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Map, leaving out what maps to null."""
    return df.select(*(col(k) for k in keep), expression.alias(name)).where(col(name).isNotNull())


def eval_mapped(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Map batches of rows by a pandas function, for calls out of Spark such as I/O."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(each, schema)


def map_parallel(df: DataFrame, columns: Mapping[str, Column], concurrency: int | None = None) -> DataFrame:
    """Map on as many partitions as concurrency says, by default those of the input. Rows keep their order columns.

    Without concurrency nothing is moved: partitions are parallel already.
    """
    return mapped(df.repartition(concurrency) if concurrency else df, **columns)


def batch_processed(df: DataFrame, order: Sequence[Column], size: int, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Cut the ordered rows into chunks of size, map each chunk by f and flatten. f sees its rows in order, with rn."""
    placed = with_position(df, order, small_bytes=SMALL_BYTES).withColumn("__chunk", F.floor((F.col("rn") - 1) / size))

    def one(chunk: pd.DataFrame) -> pd.DataFrame:
        return f(chunk.sort_values("rn").drop(columns="__chunk").reset_index(drop=True))

    return placed.groupBy("__chunk").applyInPandas(one, schema)


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, collapsed on the map side."""
    others = [c for c in df.columns if c not in keys]
    place = F.struct(*(col(o) for o in order))
    first = df.groupBy(*(col(k) for k in keys)).agg(F.min_by(F.struct(*(col(c) for c in others)), place).alias("__row"))
    return first.select(*(col(k) for k in keys), "__row.*").select(*(col(c) for c in df.columns))
