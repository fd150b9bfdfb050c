"""Keys of keyed operators, and settings of their state."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_key(df: DataFrame, path: str) -> Column:
    """A dotted field as a string key: null gives 'null', a field that isn't there 'missing_field_<name>', arrays and
    structs their JSON text."""
    kind: T.DataType = df.schema
    out: Column | None = None
    for name in path.split("."):
        found = next((f for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None
        if found is None:
            return F.lit(f"missing_field_{name}")
        out = F.col(f"`{name}`") if out is None else out[name]
        kind = found.dataType
    assert out is not None
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    return F.coalesce(F.to_json(out) if nested else out.cast("string"), F.lit("null"))


def custom_key(expression: Column) -> Column:
    return expression.cast("string")


class StateError(Exception):
    """State can't be kept as asked."""


@dataclass(frozen=True)
class StateConfig:
    """Times in seconds. max_size None is unbounded."""

    ttl_s: float = 24 * 3600
    cleanup_interval_s: float = 300
    max_size: int | None = None

    def validated(self) -> StateConfig:
        if self.ttl_s <= 0:
            raise StateError("the time to live must be positive")
        if self.cleanup_interval_s <= 0:
            raise StateError("the cleanup interval must be positive")
        if self.cleanup_interval_s > self.ttl_s:
            raise StateError("the cleanup interval must not exceed the time to live")
        if self.max_size is not None and self.max_size <= 0:
            raise StateError("the size must be positive")
        return self

    def with_(self, **changes: object) -> StateConfig:
        return replace(self, **changes).validated()  # type: ignore[arg-type]


#: Seconds to live, seconds between cleanups, entries.
PRESETS = {
    "high_performance": StateConfig(3600, 60, 10_000),
    "session": StateConfig(30 * 60, 5 * 60, 1_000),
    "short_lived": StateConfig(5 * 60, 30, 100),
    "long_lived": StateConfig(7 * 24 * 3600, 3600, 100_000),
}


class InMemoryState:
    """Driver-side state with time to live, for tests and small tools; the one written longest ago goes first."""

    def __init__(self, ttl_s: float, max_size: int | None = None, clock: Callable[[], float] = time.monotonic):
        self._ttl, self._max, self._clock = ttl_s, max_size, clock
        self._held: OrderedDict[str, tuple[float, bytes]] = OrderedDict()

    def get(self, key: str) -> bytes | None:
        entry = self._held.get(key)
        if entry is None:
            return None
        if self._clock() - entry[0] > self._ttl:
            del self._held[key]
            return None
        return entry[1]

    def set(self, key: str, value: bytes) -> None:
        self._held.pop(key, None)
        self._held[key] = (self._clock(), value)
        while self._max is not None and len(self._held) > self._max:
            self._held.popitem(last=False)

    def delete(self, key: str) -> None:
        self._held.pop(key, None)

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)
