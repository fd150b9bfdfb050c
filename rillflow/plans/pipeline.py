"""Reusable pipes and linear pipelines with branches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

Transform = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame], object]


@dataclass(frozen=True)
class Pipe:
    """A function from stream to stream that can be applied again and again."""

    run: Transform

    def apply(self, df: DataFrame) -> DataFrame:
        return df.transform(self.run)

    __call__ = apply

    def compose(self, after: Pipe) -> Pipe:
        return Pipe(lambda df: after.apply(self.apply(df)))

    @staticmethod
    def map(**columns: Column) -> Pipe:
        return Pipe(lambda df: df.select(*(c.alias(n) for n, c in columns.items())))

    @staticmethod
    def filter(predicate: Column) -> Pipe:
        return Pipe(lambda df: df.where(predicate))

    @staticmethod
    def identity() -> Pipe:
        return Pipe(lambda df: df)


def composed(pipes: Sequence[Pipe]) -> Pipe:
    return reduce(Pipe.compose, pipes, Pipe.identity())


class InvalidPipeline(ValueError):
    """A pipeline that can't run."""


class NoSource(InvalidPipeline):
    pass


class NoSink(InvalidPipeline):
    pass


@dataclass
class Pipeline:
    """A source, transforms in order, and sinks or branches. A second source takes the place of the first."""

    _source: tuple[str, Callable[[SparkSession], DataFrame]] | None = None
    _nodes: list[tuple[str, str, object]] = field(default_factory=list)

    def source(self, read: Callable[[SparkSession], DataFrame], name: str = "source") -> Pipeline:
        self._source = (name, read)
        return self

    def transform(self, f: Transform, name: str = "transform") -> Pipeline:
        self._nodes.append(("transform", name, f))
        return self

    def sink(self, write: Sink, name: str = "sink") -> Pipeline:
        self._nodes.append(("sink", name, write))
        return self

    def branch(self, *sinks: Sink, name: str = "branch") -> Pipeline:
        self._nodes.append(("branch", name, sinks))
        return self

    def validate(self) -> Pipeline:
        if self._source is None and not self._nodes:
            raise InvalidPipeline("an empty pipeline")
        if self._source is None:
            raise NoSource("a pipeline needs a source")
        if not any(kind in ("sink", "branch") for kind, _, _ in self._nodes):
            raise NoSink("a pipeline needs a sink")
        return self

    def names(self) -> list[str]:
        return [*([self._source[0]] if self._source else []), *(name for _, name, _ in self._nodes)]

    def run(self, spark: SparkSession, checkpoint: str | None = None) -> list[object]:
        """Write to all sinks and return what they returned; a branch's sinks all get every row. A stream needs a
        checkpoint folder; each of its micro-batches is kept while the sinks take it, and runs until what is there now
        is done."""
        self.validate()
        assert self._source is not None
        df = self._source[1](spark)
        if not df.isStreaming:
            return self._drive(df)
        if checkpoint is None:
            raise InvalidPipeline("a stream needs a checkpoint folder")
        query = df.writeStream.foreachBatch(lambda batch, _: self._drive(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return []

    def _drive(self, df: DataFrame) -> list[object]:
        results: list[object] = []
        for kind, _, what in self._nodes:
            if kind == "transform":
                df = df.transform(what)  # type: ignore[arg-type]
            elif kind == "sink":
                results.append(what(df))  # type: ignore[operator]
            else:
                kept = df.persist()
                try:
                    results += [write(kept) for write in what]  # type: ignore[attr-defined]
                finally:
                    kept.unpersist()
        return results
