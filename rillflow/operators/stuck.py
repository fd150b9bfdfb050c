"""Stuck stretches of measured series: flat runs found in parts of a series and put together in order.

A run is flat where first differences are zero, or all but zero (wavelet details don't tell, being 0 on any line). Normal is what is left of
a series without all its long flat runs, unless they are most of it or come back to one value often and for long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Readings of a flat run that can be stuck, and the share of the usual step up to which a step is flat.
STUCK_LENGTH, STUCK_SHARE, LEAST = 6, 0.05, 12
MOST_REPEATS, BY_CHANCE = 0.15, 0.01
#: A series rests if more than this share of its steps, its longest flat run aside, lie in long flat runs, and at a value
#: if it has so many long flat runs there that, their longest aside, hold more than MOST_REPEATS of those steps.
MOST_RESTING, REST_RUNS = 0.5, 3


def median(x: np.ndarray) -> float:
    """As numpy's, without its checks, which cost more than short arrays do."""
    ordered, n = np.sort(x), len(x)
    return float(ordered[(n - 1) // 2] + ordered[n // 2]) / 2


@dataclass(frozen=True)
class Piece:
    """Successive readings of a block with flat steps between them: how many, the places of the first and the last, and
    those readings that can tell where a level is left: the first STUCK_LENGTH and each that is greater or less than all
    before it, by number, value and the place of the reading before."""

    count: int
    first: int
    last: int
    number: np.ndarray
    value: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, at: np.ndarray) -> Piece:
        high, low = np.maximum.accumulate(x), np.minimum.accumulate(x)
        keep = np.arange(len(x)) < STUCK_LENGTH
        keep[1:] |= (high[1:] > high[:-1]) | (low[1:] < low[:-1])
        number = np.flatnonzero(keep)
        return cls(len(x), int(at[0]), int(at[-1]), number, x[number], at[np.maximum(number - 1, 0)])


class Run:
    """A flat run put together from pieces; a slow drift in small steps isn't stuck, so it is cut where it leaves its
    first values' surroundings."""

    def __init__(self, near: float) -> None:
        self.near, self.count, self.first, self.last = near, 0, 0, 0
        self.level: float | None = None
        self.stop: tuple[int, int] | None = None  # readings before the one that leaves the level, and the last of them
        self.waiting: list[tuple[int, float, int]] = []

    def add(self, piece: Piece) -> None:
        self.first = self.first if self.count else piece.first
        if self.stop is None:
            before = [self.last if n == 0 else int(b) for n, b in zip(piece.number, piece.before, strict=True)]
            self.waiting += zip((int(n) + self.count for n in piece.number), map(float, piece.value), before, strict=True)
        self.count, self.last = self.count + piece.count, piece.last
        if self.level is None and self.count >= STUCK_LENGTH:
            self.level = median(np.array([v for n, v, _ in self.waiting if n < STUCK_LENGTH]))
        if self.level is not None:
            self.stop = self.stop or next(((n, b) for n, v, b in self.waiting if abs(v - self.level) > self.near), None)
            self.waiting = []

    def found(self) -> tuple[int, int, int, float] | None:
        """First and last place, readings and level, if long enough."""
        count, last = self.stop or (self.count, self.last)
        return (self.first, last, count, self.level) if self.level is not None and count >= STUCK_LENGTH else None


@dataclass(frozen=True)
class BlockRuns:
    """What joining needs to know of a block's own possible readings: steps between them, flat ones among them, the
    first and the last value, the pieces that reach its borders (one if it is the whole block) and the runs within."""

    steps: int
    flats: int
    first: float
    last: float
    pieces: list[Piece]
    within: list[tuple[int, int, int, float]]


def block_runs(x: np.ndarray, at: np.ndarray, near: float) -> BlockRuns:
    flat = np.abs(np.diff(x)) <= near
    ends = np.flatnonzero(~flat) + 1  # where a flat run, if only of one reading, begins after another
    starts, stops = np.concatenate([[0], ends]), np.concatenate([ends, [len(x)]])
    border = [0] if len(starts) == 1 else [0, len(starts) - 1]
    within = []
    for i in np.flatnonzero(stops - starts >= STUCK_LENGTH):
        if i not in border:
            run = Run(near)
            run.add(Piece.of(x[starts[i] : stops[i]], at[starts[i] : stops[i]]))
            within += [run.found()] if run.found() else []
    pieces = [Piece.of(x[starts[i] : stops[i]], at[starts[i] : stops[i]]) for i in border]
    return BlockRuns(len(flat), int(flat.sum()), float(x[0]), float(x[-1]), pieces, within)


class SeriesRuns:
    """Joins the runs of a series' blocks, given in order, and tells which are stuck by all the series' readings."""

    def __init__(self, near: float) -> None:
        self.near, self.steps, self.flats = near, 0, 0
        self.runs: list[tuple[int, int, int, float]] = []
        self.open: Run | None = None
        self.value = 0.0

    def add(self, block: BlockRuns) -> None:
        if self.open is not None:
            goes_on = abs(block.first - self.value) <= self.near
            self.steps, self.flats = self.steps + 1, self.flats + goes_on
            if not goes_on:
                self._close()
        self.open = self.open or Run(self.near)
        self.open.add(block.pieces[0])
        if len(block.pieces) > 1:
            self._close()
            self.runs += block.within
            self.open = Run(self.near)
            self.open.add(block.pieces[1])
        self.steps, self.flats, self.value = self.steps + block.steps, self.flats + block.flats, block.last

    def _close(self) -> None:
        found = self.open.found() if self.open is not None else None
        self.runs += [found] if found else []
        self.open = None

    def stuck(self) -> list[tuple[int, int]]:
        """First and last place of the stretches that stay the same where that is not normal."""
        self._close()
        if self.steps < LEAST or not self.runs:
            return []
        flats, levels = (np.array(v) for v in zip(*((n - 1, level) for _, _, n, level in self.runs), strict=True))
        longest, total = int(flats.max()), int(flats.sum())
        # No candidate counts as usual, whether or not it is stuck; but a series most of whose steps lie in them rests.
        rest = self.steps - total
        usual = (self.flats - total) / rest if rest >= LEAST else 1.0
        if usual > MOST_REPEATS or total - longest > MOST_RESTING * (self.steps - longest):
            return []
        resting = self._resting(flats, levels, self.steps - longest)
        return [(a, b) for (a, b, _, _), k, r in zip(self.runs, flats, resting, strict=True) if not r and rest * usual ** int(k) < BY_CHANCE]

    def _resting(self, flats: np.ndarray, levels: np.ndarray, steps: int) -> np.ndarray:
        """Which runs are at a value that the series comes back to rest at, often and for long."""
        order = np.argsort(levels, kind="stable")
        group = np.zeros(len(levels), dtype=np.int64)
        group[order] = np.cumsum(np.diff(levels[order], prepend=levels[order[0]]) > self.near)
        most = np.zeros(group.max() + 1)
        np.maximum.at(most, group, flats)
        often = np.bincount(group) >= REST_RUNS
        return (often & (np.bincount(group, flats) - most > MOST_REPEATS * steps))[group]
