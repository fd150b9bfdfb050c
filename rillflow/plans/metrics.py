"""Counters of running queries, health and resources."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class HealthThresholds:
    max_error_rate: float = 0.1
    max_consecutive_errors: int = 5

    @classmethod
    def strict(cls) -> HealthThresholds:
        return cls(0.01, 2)

    @classmethod
    def relaxed(cls) -> HealthThresholds:
        return cls(0.20, 20)


@dataclass
class StreamMetrics:
    """Counters of one stream and what follows from them. Seconds since started come from the clock."""

    name: str | None = None
    thresholds: HealthThresholds = field(default_factory=HealthThresholds)
    items: int = 0
    bytes: int = 0
    errors: int = 0
    retries: int = 0
    consecutive_errors: int = 0
    backpressure_events: int = 0
    peak_item_bytes: int = 0
    processing_s: float = 0.0
    started: float = field(default_factory=time.monotonic)

    def record_item(self, size: int = 0, seconds: float = 0.0) -> None:
        self.items += 1
        self.bytes += size
        self.peak_item_bytes = max(self.peak_item_bytes, size)
        self.processing_s += seconds
        self.consecutive_errors = 0

    def record_error(self) -> None:
        self.errors += 1
        self.consecutive_errors += 1

    def record_retry(self) -> None:
        self.retries += 1

    def record_backpressure(self) -> None:
        self.backpressure_events += 1

    @property
    def elapsed_s(self) -> float:
        return time.monotonic() - self.started

    @property
    def error_rate(self) -> float:
        seen = self.items + self.errors
        return self.errors / seen if seen else 0.0

    @property
    def average_bytes(self) -> float:
        return self.bytes / self.items if self.items else 0.0

    def throughput(self, elapsed_s: float | None = None) -> float:
        s = self.elapsed_s if elapsed_s is None else elapsed_s
        return self.items / s if s > 0 else 0.0

    def is_healthy(self) -> bool:
        return self.error_rate < self.thresholds.max_error_rate and self.consecutive_errors < self.thresholds.max_consecutive_errors

    def summary(self) -> str:
        return f"{self.name or 'stream'}: {self.items} items, {self.bytes} bytes, {self.errors} errors ({self.error_rate:.2%}), {self.throughput():.1f} items/s"


def with_metrics(df: DataFrame, name: str, size: Column | None = None, error: Column | None = None) -> tuple[DataFrame, Observation]:
    """df observed while it runs: rows, bytes and errors come out of the observation after the first action."""
    seen = Observation(name)
    nothing = F.lit(0).cast("bigint")
    return df.observe(
        seen, F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(size if size is not None else nothing), nothing).alias("bytes"),
        F.coalesce(F.sum(error.cast("bigint") if error is not None else nothing), nothing).alias("errors"),
    ), seen


def metrics_of(seen: Observation, name: str, thresholds: HealthThresholds | None = None) -> StreamMetrics:
    got = seen.get
    good = got["items"] - got["errors"]
    return StreamMetrics(name, thresholds or HealthThresholds(), items=good, bytes=got["bytes"], errors=got["errors"])


@dataclass(frozen=True)
class BufferConfig:
    initial_capacity: int = 1024
    max_capacity: int | None = 1_048_576
    growth: str = "exponential"


@dataclass(frozen=True)
class ResourceConfig:
    max_memory_bytes: int = 1 << 30
    max_keys: int = 100_000
    pressure_percent: float = 80.0
    max_overflows: int = 10_000
    cooldown_s: float = 30.0
    emergency_percent: float = 95.0


class ResourceManager:
    """What a query's state takes, and a circuit breaker that opens after too many overflows."""

    def __init__(self, config: ResourceConfig | None = None, clock=time.monotonic):  # noqa: ANN001
        self.config = config or ResourceConfig()
        self._clock = clock
        self.memory = self.peak_memory = self.keys = self.overflows = 0
        self.state = "Closed"
        self._opened = 0.0

    def track_memory(self, change: int) -> None:
        self.memory = max(0, self.memory + change)
        self.peak_memory = max(self.peak_memory, self.memory)
        if self.pressure() >= self.config.emergency_percent:
            self.trip()

    def track_keys(self, change: int) -> None:
        self.keys = max(0, self.keys + change)

    def track_overflow(self) -> None:
        self.overflows += 1
        if self.overflows >= self.config.max_overflows:
            self.trip()

    def trip(self) -> None:
        self.state, self._opened = "Open", self._clock()

    def is_circuit_open(self) -> bool:
        """Open until the cooldown is over; then half open, until a success closes it or an overflow opens it again."""
        if self.state == "Open" and self._clock() - self._opened >= self.config.cooldown_s:
            self.state, self.overflows = "HalfOpen", 0
        return self.state == "Open"

    def record_success(self) -> None:
        if self.state == "HalfOpen":
            self.state = "Closed"

    def pressure(self) -> float:
        return 100.0 * self.memory / self.config.max_memory_bytes

    def under_pressure(self) -> bool:
        return self.pressure() >= self.config.pressure_percent

    def update_from_progress(self, progress: dict) -> None:
        """Take over a streaming query's state sizes from its progress report."""
        state = progress.get("stateOperators", [])
        self.memory = sum(int(s.get("memoryUsedBytes", 0)) for s in state)
        self.peak_memory = max(self.peak_memory, self.memory)
        self.keys = sum(int(s.get("numRowsTotal", 0)) for s in state)


def watch(spark: SparkSession, manager: ResourceManager, name: str | None = None) -> StreamingQueryListener:
    """Keep manager up to date from the progress of streaming queries (of one name, if given) until the listener is removed."""

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
            pass

        def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
            if name is None or event.progress.name == name:
                manager.update_from_progress(json.loads(event.progress.json))

        def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
            pass

        def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
            pass

    listener = Progress()
    spark.streams.addListener(listener)
    return listener
