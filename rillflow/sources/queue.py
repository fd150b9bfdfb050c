"""A driver-side queue whose rest can be read as a DataFrame."""

from __future__ import annotations

import threading
from collections import deque
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rillflow.sources.builders import from_rows


class QueueClosed(Exception):
    """No more items are taken."""


class QueueFull(Exception):
    """A bounded queue has no room."""


class Queue:
    """First in, first out; bounded if capacity is given. Closing stops new items, not the reading of those inside."""

    def __init__(self, capacity: int | None = None):
        if capacity is not None and capacity < 1:
            raise ValueError("a bounded queue holds at least one item")
        self._capacity = capacity
        self._items: deque[Any] = deque()
        self._closed = False
        self._changed = threading.Condition()

    @classmethod
    def bounded(cls, capacity: int) -> Queue:
        return cls(capacity)

    @classmethod
    def unbounded(cls) -> Queue:
        return cls()

    @property
    def capacity(self) -> int | None:
        return self._capacity

    def _full(self) -> bool:
        return self._capacity is not None and len(self._items) >= self._capacity

    def enqueue(self, item: Any, timeout: float | None = None) -> None:
        """Wait for room, at most timeout seconds."""
        with self._changed:
            if not self._changed.wait_for(lambda: self._closed or not self._full(), timeout):
                raise QueueFull
            if self._closed:
                raise QueueClosed
            self._items.append(item)
            self._changed.notify_all()

    def try_enqueue(self, item: Any) -> None:
        with self._changed:
            if self._closed:
                raise QueueClosed
            if self._full():
                raise QueueFull
            self._items.append(item)
            self._changed.notify_all()

    def close(self) -> None:
        with self._changed:
            self._closed = True
            self._changed.notify_all()

    def drain(self) -> list[Any]:
        """The items inside, removed."""
        with self._changed:
            items = list(self._items)
            self._items.clear()
            self._changed.notify_all()
            return items

    def dequeue(self, spark: SparkSession, schema: str) -> DataFrame:
        """What is inside as a DataFrame with positions."""
        return from_rows(spark, self.drain(), schema)

    def is_empty(self) -> bool:
        return not self._items

    def __len__(self) -> int:
        return len(self._items)
