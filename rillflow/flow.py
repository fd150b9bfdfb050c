"""A fluent layer: an ordered stream, perhaps keyed and timed, whose methods give streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame

from rillflow.functions import validation
from rillflow.operators import combine, eventtime, keyed, results, sequence, timecontrol, transform
from rillflow.plans import metrics
from rillflow.plans.pipeline import Pipe


@dataclass(frozen=True)
class Flow:
    """df with the columns of its total order, of its key and of its event time."""

    df: DataFrame
    order: tuple[str, ...]
    key: tuple[str, ...] = ()
    ts: str | None = None

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str], key: Sequence[str] = (), ts: str | None = None) -> Flow:
        if missing := [c for c in [*order, *key, *([ts] if ts else [])] if c not in df.columns]:
            raise ValueError(f"no columns {missing}")
        return cls(df, tuple(order), tuple(key), ts)

    def _with(self, df: DataFrame, order: Sequence[str] | None = None) -> Flow:
        return replace(self, df=df, order=tuple(order) if order is not None else self.order)

    def _timed(self) -> str:
        if self.ts is None:
            raise ValueError("this operator needs an event time")
        return self.ts

    def keyed_by(self, *key: str) -> Flow:
        return replace(self, key=key)

    # One to one, one to many

    def map(self, **columns: Column) -> Flow:
        """The order, key and time columns stay unless they are mapped."""
        kept = {c: self.df[c] for c in dict.fromkeys([*self.order, *self.key, *([self.ts] if self.ts else [])])}
        return self._with(transform.mapped(self.df, **(kept | columns)))

    def filter(self, predicate: Column) -> Flow:
        return self._with(transform.filtered(self.df, predicate))

    def flat_map(self, array: Column, name: str, position: str = "pos") -> Flow:
        kept = list(dict.fromkeys([*self.order, *self.key, *([self.ts] if self.ts else [])]))
        return self._with(transform.flat_mapped(self.df, array, name, kept, position), [*self.order, position])

    def filter_map(self, expression: Column, name: str) -> Flow:
        kept = list(dict.fromkeys([*self.order, *self.key, *([self.ts] if self.ts else [])]))
        return self._with(transform.filter_mapped(self.df, expression, name, kept))

    def eval_map(self, f: Callable[..., Any], schema: str) -> Flow:
        return self._with(transform.eval_mapped(self.df, f, schema))

    def map_parallel(self, concurrency: int | None = None, **columns: Column) -> Flow:
        kept = {c: self.df[c] for c in dict.fromkeys([*self.order, *self.key, *([self.ts] if self.ts else [])])}
        return self._with(transform.map_parallel(self.df, kept | columns, concurrency))

    par_eval_map = par_eval_map_unordered = map_parallel

    def with_schema_validation(self, text: Column, schema: dict[str, Any]) -> tuple[Flow, Flow]:
        """The valid rows, and the others with err."""
        good, bad = validation.with_schema_validation(self.df, text, schema)
        return self._with(good), self._with(bad)

    def batch_process(self, size: int, f: Callable[..., Any], schema: str) -> Flow:
        return self._with(transform.batch_processed(self.df, [self.df[o] for o in self.order], size, f, schema))

    def pipe(self, pipe: Pipe) -> Flow:
        return self._with(pipe.apply(self.df))

    # Slices

    def take(self, n: int) -> Flow:
        return self._with(sequence.take(self.df, self.order, n))

    def drop(self, n: int) -> Flow:
        return self._with(sequence.drop(self.df, self.order, n))

    skip = drop

    def take_while(self, predicate: Column) -> Flow:
        return self._with(sequence.take_while(self.df, self.order, predicate))

    def drop_while(self, predicate: Column) -> Flow:
        return self._with(sequence.drop_while(self.df, self.order, predicate))

    def interrupt_when(self, signal: Column) -> Flow:
        return self._with(sequence.interrupt_when(self.df, self._timed(), signal))

    # Neighbours

    def chunk(self, size: int, items: Sequence[str]) -> Flow:
        return self._with(sequence.chunk(self.df, self.order, size, items), ["chunk_no"])

    def sliding_window(self, size: int, items: Sequence[str]) -> Flow:
        return self._with(sequence.sliding_window(self.df, self.order, size, items), ["rn"])

    def group_adjacent_by(self, key: Column, items: Sequence[str]) -> Flow:
        return self._with(sequence.group_adjacent_by(self.df, self.order, key, items), ["run"])

    group_by = group_adjacent_by

    def distinct(self) -> Flow:
        return self._with(self.df.distinct())

    def distinct_by(self, *keys: str) -> Flow:
        return self._with(transform.distinct_by(self.df, keys, self.order))

    def distinct_until_changed(self, value: Column) -> Flow:
        return self._with(sequence.distinct_until_changed(self.df, self.order, value, self.key))

    def scan(self, **sums: Column) -> Flow:
        return self._with(sequence.scan(self.df, self.order, **sums))

    def fold(self, **aggregates: Column) -> DataFrame:
        return sequence.fold(self.df, **aggregates)

    reduce = fold

    # Several streams

    def concat(self, *others: Flow) -> Flow:
        return self._with(combine.concat([self.df, *(o.df for o in others)]), [combine.SRC, *self.order])

    def merge(self, other: Flow) -> Flow:
        return self.concat(other)

    def interleave(self, *others: Flow) -> Flow:
        return self._with(combine.interleave([self.df, *(o.df for o in others)], self.order), ["turn", combine.SRC])

    def either(self, other: Flow) -> Flow:
        return self._with(combine.either(self.df, other.df))

    def zip(self, other: Flow) -> Flow:
        return self._with(combine.zipped(self.df, other.df, self.order, other.order), ["rn"])

    def zip_with(self, other: Flow, **columns: Column) -> Flow:
        return self._with(combine.zip_with(self.df, other.df, self.order, other.order, **columns), ["rn"])

    # Time

    def throttle(self, every_us: int) -> Flow:
        return self._with(timecontrol.throttle(self.df, self.order, self._timed(), every_us))

    def debounce(self, quiet_us: int) -> Flow:
        return self._with(timecontrol.debounce(self.df, self.order, self._timed(), quiet_us))

    def sample(self, every_us: int, start_us: int = 0) -> Flow:
        return self._with(timecontrol.sample(self.df, self.order, self._timed(), every_us, start_us))

    def timeout(self, limit_us: int) -> Flow:
        return self._with(timecontrol.timeout(self.df, self.order, self._timed(), limit_us), [self._timed()])

    def backpressure(self, bucket: Column, limit: int = 100, strategy: str = "block") -> Flow:
        return self._with(timecontrol.backpressure(self.df, self.order, bucket, limit, strategy))

    def auto_backpressure(self, bucket: Column, config: timecontrol.BackpressureConfig | None = None) -> Flow:
        return self._with(timecontrol.auto_backpressure(self.df, self.order, bucket, config))

    def prefetch(self, n: int = 1) -> Flow:
        return self._with(timecontrol.prefetch(self.df, n))

    def window_by_time(self, config: eventtime.TimeWindowConfig, **aggregates: Column) -> DataFrame:
        return eventtime.window_by_time(self.df, self._timed(), config, aggregates, self.key)

    def join_with_time_window(self, other: Flow, config: eventtime.TimeJoinConfig) -> DataFrame:
        return eventtime.join_with_time_window(self.df, other.df, self._timed(), other._timed(), config, self.key)

    # Keyed state

    def stateful_map(self, **columns: Column) -> Flow:
        return self._with(keyed.stateful_map(self.df, self.key, self.order, **columns))

    def stateful_filter(self, predicate: Column, **state: Column) -> Flow:
        return self._with(keyed.stateful_filter(self.df, self.key, self.order, state, predicate))

    def stateful_fold(self, spread: bool = False, **sums: Column) -> Flow:
        return self._with(keyed.stateful_fold(self.df, self.key, self.order, spread, **sums))

    def stateful_reduce(self, **aggregates: Column) -> Flow:
        return self._with(keyed.stateful_reduce(self.df, self.key, self.order, **aggregates))

    def keyed_scan(self, inputs: Sequence[Column], init: Any, step: Callable[..., tuple[Any, tuple | None]], schema: str) -> Flow:
        return self._with(keyed.keyed_scan(self.df, self.key, self.order, inputs, init, step, schema))

    def scan_associative(self, value: Column, f: Callable[[Any, Any], Any], name: str, kind: str) -> Flow:
        return self._with(keyed.scan_associative(self.df, self.key, self.order, value, f, name, kind))

    def keyed_reduce(self, value: Column, f: Callable[[Any, Any], Any], schema: str) -> Flow:
        return self._with(keyed.keyed_reduce(self.df, self.key, self.order, value, f, schema))

    def distinct_until_changed_by(self, value: Column, same: Callable[[Any, Any], bool]) -> Flow:
        return self._with(keyed.distinct_until_changed_by(self.df, self.order, value, same, self.key))

    def stateful_session(self, timeout_us: int, spread: bool = False) -> Flow:
        return self._with(keyed.stateful_session(self.df, self.key, self.order, self._timed(), timeout_us, spread))

    def stateful_deduplicate(self, ttl_us: int) -> Flow:
        order = [self._timed(), *(o for o in self.order if o != self.ts)]
        return self._with(keyed.stateful_deduplicate(self.df, self.key, order, self._timed(), ttl_us))

    def stateful_throttle(self, limit: int, window_us: int, policy: str = "delay") -> Flow:
        order = [self._timed(), *(o for o in self.order if o != self.ts)]
        return self._with(keyed.stateful_throttle(self.df, self.key, order, self._timed(), limit, window_us, policy))

    def stateful_window(self, size: int, slide: int | None = None, emit_partial: bool = False, spread: bool = False, **aggregates: Column) -> DataFrame:
        return keyed.stateful_window(self.df, self.key, self.order, size, aggregates, slide, emit_partial, spread)

    def stateful_pattern(self, size: int, item: str, pattern: Callable[[Column], Column], spread: bool = False) -> DataFrame:
        return keyed.stateful_pattern(self.df, self.key, self.order, size, item, pattern, spread)

    def stateful_group_by(self, max_size: int | None = None, emit_on_key_change: bool = False, spread: bool = False, **aggregates: Column) -> DataFrame:
        return keyed.stateful_group_by(self.df, self.key, self.order, aggregates, max_size, emit_on_key_change, spread)

    def stateful_group_by_advanced(self, max_size: int | None = None, timeout_us: int | None = None, emit_on_key_change: bool = False, **aggregates: Column) -> DataFrame:
        return keyed.stateful_group_by_advanced(self.df, self.key, self.order, self._timed(), aggregates, max_size, timeout_us, emit_on_key_change)

    # Errors, ends

    def recover(self, value: Column) -> Flow:
        return self._with(results.recover(self.df, value))

    def on_error_resume_next(self, values: Column) -> Flow:
        return self._with(results.on_error_resume_next(self.df, values), [*self.order, "resume_no"])

    def map_error(self, kind: str, message: Column) -> Flow:
        return self._with(results.map_error(self.df, kind, message))

    def with_metrics(self, name: str, size: Column | None = None, error: Column | None = None) -> tuple[Flow, Any]:
        observed, seen = metrics.with_metrics(self.df, name, size, error)
        return self._with(observed), seen

    def collect(self, most: int | None = None) -> list[Any]:
        return sequence.collected(self.df, self.order, most)

    def collect_set(self, value: Column, most: int) -> set[Any]:
        return sequence.collected_set(self.df, value, most)

    def for_each(self, f: Callable[[Any], None]) -> None:
        """Call f on the driver for each row in order, one partition at a time."""
        for row in self.df.orderBy(*self.order).toLocalIterator(prefetchPartitions=True):
            f(row)
