"""Errors as data: rows with ok and err (kind, message); err is null for a good row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.operators.sequence import first_where
from rillflow.plans.ordering import col

KINDS = ("IO", "Timeout", "ResourceExhausted", "Cancelled", "BackpressureOverflow", "Custom")
R = TypeVar("R")


def error(kind: str, message: Column | str) -> Column:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of error {kind}")
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("message"))


def no_error() -> Column:
    return F.lit(None).cast("struct<kind:string,message:string>")


def attempt(df: DataFrame, value: Column, kind: str, message: Column | str) -> DataFrame:
    """Add ok and err: a null value is an error. Use expressions that give null on failure, such as try_cast."""
    return df.withColumn("ok", value).withColumn("err", F.when(F.col("ok").isNull(), error(kind, message)))


def recover(df: DataFrame, value: Column) -> DataFrame:
    """Bad rows become good ones of a value that may be made from err."""
    return df.withColumn("ok", F.when(F.col("err").isNotNull(), value).otherwise(F.col("ok"))).withColumn("err", no_error())


or_else = recover


def on_error_resume_next(df: DataFrame, values: Column) -> DataFrame:
    """In place of a bad row the values of an array, in order (resume_no), each a good row; the stream goes on."""
    each = F.when(F.col("err").isNotNull(), values).otherwise(F.array("ok"))
    others = [col(c) for c in df.columns if c not in ("ok", "err")]
    return df.select(*others, F.posexplode(each).alias("resume_no", "ok")).withColumn("err", no_error())


def map_error(df: DataFrame, kind: str, message: Column) -> DataFrame:
    return df.withColumn("err", F.when(F.col("err").isNotNull(), error(kind, message)))


def collect_ok(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: the good values in order, an empty array if there are none. For results that fit into one value."""
    return _gathered(df, order, F.col("err").isNull(), F.col("ok"))


def collect_err(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return _gathered(df, order, F.col("err").isNotNull(), F.col("err"))


def _gathered(df: DataFrame, order: Sequence[str], which: Column, value: Column) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.when(which, F.struct(*(col(o).alias(f"o{i}") for i, o in enumerate(order)), value.alias("v")))))
    return df.agg(F.transform(rows, lambda x: x["v"]).alias("values"))


@dataclass(frozen=True)
class RetryPolicy:
    """none, immediate, fixed or exponential; by default three times after 100 ms."""

    kind: str = "fixed"
    max_retries: int = 3
    delay_ms: float = 100.0
    multiplier: float = 2.0

    def delay(self, attempt_no: int) -> float:
        """Milliseconds before retry attempt_no, from 0."""
        if self.kind in ("none", "immediate"):
            return 0.0
        return self.delay_ms * (self.multiplier**attempt_no if self.kind == "exponential" else 1.0)

    @property
    def retries(self) -> int:
        return 0 if self.kind == "none" else self.max_retries


def retry_with_policy(factory: Callable[[int], DataFrame], order: Sequence[str], policy: RetryPolicy) -> DataFrame:
    """Run the stream made by factory(attempt); on its first bad row start over, up to the policy's number of times.

    All attempts' rows up to and with the bad one come out, with attempt and attempt_delay_ms.
    """
    attempts = []
    for number in range(policy.retries + 1):
        stream = factory(number)
        stop = first_where(stream, order, F.col("err").isNotNull())
        delay = policy.delay(number - 1) if number else 0.0
        cut = stream if stop is None else stream.where(F.struct(*(col(o) for o in order)) <= stop)
        attempts.append(cut.withColumn("attempt", F.lit(number)).withColumn("attempt_delay_ms", F.lit(delay)))
        if stop is None:
            break
    return reduce(DataFrame.unionByName, attempts)


def retry(factory: Callable[[int], DataFrame], order: Sequence[str], times: int) -> DataFrame:
    return retry_with_policy(factory, order, RetryPolicy("immediate", times)).drop("attempt_delay_ms")


@contextmanager
def bracket(acquire: Callable[[], R], release: Callable[[R], None]) -> Iterator[R]:
    """Hold a resource around actions; it is released however they end."""
    resource = acquire()
    try:
        yield resource
    finally:
        release(resource)


def bracket_case(acquire: Callable[[], R], use: Callable[[R], DataFrame], release: Callable[[R, str], None], strict: bool = False) -> list[Any]:
    """The rows of use(resource); release is told 'Completed', or 'Errored' if the run fails or, with strict, if there
    is a bad row."""
    resource = acquire()
    case = "Errored"
    try:
        rows = use(resource).collect()
        case = "Errored" if strict and any(getattr(r, "err", None) is not None for r in rows) else "Completed"
        return rows
    finally:
        release(resource, case)
