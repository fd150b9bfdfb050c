"""Spikes in measured series by wavelet details, for many series at once.

A batch holds the readings of many segments (series or parts of them) one after the other; all steps run over the whole
batch. An undecimated wavelet with two vanishing moments (detail at scale s: x[i] - (x[i-s] + x[i+s]) / 2, s = 1, 2, 4,
8; lines give 0) is taken on an inverse hyperbolic sine scale. Details beyond DETAIL_LIMIT robust standard deviations of
the whole series make a reading a candidate; nothing else is looked at. A candidate is a spike if it also lies, in the same
direction and by SPIKE_LIMIT deviations, on this and on the plain scale, beyond what the readings before and the readings
after its group of up to WIDEST successive readings show and extend to: a lasting change of level or the reset of a ramp
gives large details too, but agrees with one side. Spikes found are taken out and the rest is looked at again.

Robust deviations are medians of whole series, so they are taken of counts of values in buckets of 1.6 %, which add up over
the parts of a series.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SCALES = (1, 2, 4, 8)
LEAST, NEAR, WIDEST = 12, 5, 5
DETAIL_LIMIT, SPIKE_LIMIT, FALLEN, FALLEN_LIMIT = 4.0, 7.0, 0.2, 3.0
#: Readings on each side whose details tell the noise around a reading.
AROUND = 40
#: Readings that stand in for the missing side at an end of a series.
FURTHEST = 1024
#: Values are counted in buckets of equal sign, exponent and first 6 bits of the fraction (1.6 % wide).
BUCKET_BITS, BUCKET_WIDTH = 46, 18


def bucket_of(values: np.ndarray) -> np.ndarray:
    """The bucket of each value, none negative; buckets rise with values."""
    return np.ascontiguousarray(values, dtype=np.float64).view(np.int64) >> BUCKET_BITS


def value_of(bucket: np.ndarray) -> np.ndarray:
    """The middle of a bucket; 0 for that of 0."""
    middle = ((bucket.astype(np.int64) << BUCKET_BITS) + (1 << (BUCKET_BITS - 1))).view(np.float64)
    return np.where(bucket == 0, 0.0, middle)


def medians(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The median of the values of each of n segments, by buckets; 0 for a segment without."""
    key = np.sort((of.astype(np.int64) << BUCKET_WIDTH) | bucket_of(values))
    count = np.bincount(of, minlength=n)
    first = np.cumsum(count) - count
    out = np.zeros(n)
    some = count > 0
    lo, hi = (key[(first + rank)[some]] & ((1 << BUCKET_WIDTH) - 1) for rank in ((count - 1) // 2, count // 2))
    out[some] = (value_of(lo) + value_of(hi)) / 2
    return out


@dataclass(frozen=True)
class Batch:
    """Readings of n segments, one segment after the other: values, positions in their series, segment, and whether the
    reading is the segment's own (others are copies of a neighbour's). whole tells of each segment whether it holds counts."""

    x: np.ndarray
    at: np.ndarray
    of: np.ndarray
    own: np.ndarray
    whole: np.ndarray

    @property
    def n(self) -> int:
        return len(self.whole)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the segment of each reading begins, and its last place."""
        count = np.bincount(self.of, minlength=self.n)
        last = np.cumsum(count) - 1
        return (last - count + 1)[self.of], last[self.of]

    def keep(self, test: np.ndarray) -> Batch:
        return Batch(self.x[test], self.at[test], self.of[test], self.own[test], self.whole)


def steps(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of the steps to own readings, and their segments."""
    inside = (batch.of[1:] == batch.of[:-1]) & batch.own[1:]
    return np.abs(np.diff(batch.x))[inside], batch.of[1:][inside]


#: What is first measured of a series: the median of steps other than 0, and of the values' sizes.
FIRST = ("step", "size")
#: And then: deviations of details by scale, of the finest on the evened and the plain scale, of all and of those other than 0.
SECOND = ("fine", "moving", "raw_fine", "raw_moving", "d2", "d4", "d8")


def first_measures(batch: Batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values and their segments for each of FIRST."""
    step, of = steps(batch)
    yield step[step > 0], of[step > 0]
    yield np.abs(batch.x[batch.own]), batch.of[batch.own]


def second_measures(batch: Batch, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values and their segments for each of SECOND, given the medians of FIRST by segment (columns)."""
    own = batch.own
    place, of = batch.ends(), batch.of[batch.own]
    y = evened(batch, first)
    for values in (y, batch.x):
        fine = np.abs(details(values, 1, place)[own]) / np.sqrt(1.5)
        yield fine, of
        yield fine[fine != 0], of[fine != 0]
    for s in SCALES[1:]:
        yield np.abs(details(y, s, place)[own]), of


def evened(batch: Batch, first: np.ndarray) -> np.ndarray:
    """The values on a scale on which their noise hardly depends on the level.

    Counts: the square root, by which Poisson noise has deviation 1. Others: in units of the usual step, logarithmic
    above it (inverse hyperbolic sine) unless the series rests near zero, where steps don't grow with the level.
    """
    unit = np.where(first[0] > 0, first[0], 1.0)[batch.of]
    curved = (first[1] > 3 * np.where(first[0] > 0, first[0], 1.0))[batch.of]
    y = batch.x / unit
    y = np.where(curved, np.arcsinh(y), y)
    whole = batch.whole[batch.of]
    return np.where(whole, 2 * np.sqrt(np.maximum(batch.x, 0) + 0.375), y) if whole.any() else y


def details(y: np.ndarray, scale: int, place: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Undecimated detail coefficients; a segment is continued by its mirror in the end points."""
    begin, last = place
    i = np.arange(len(y))
    left, right = i - scale, i + scale
    before = np.where(left < begin, 2 * y[begin] - y[np.clip(2 * begin - left, begin, last)], y[np.maximum(left, 0)])
    after = np.where(right > last, 2 * y[last] - y[np.clip(2 * last - right, begin, last)], y[np.minimum(right, len(y) - 1)])
    return y - (before + after) / 2


def _noise(fine: np.ndarray, moving: np.ndarray, least: np.ndarray | float) -> np.ndarray:
    base = np.maximum(1.4826 * fine, least)
    moving = 1.4826 * moving
    base = np.where(base < 0.25 * moving, moving, base)  # mostly at rest: what it does when it moves is normal too
    return np.where(base > 0, base, 1.0)


def scores(batch: Batch, first: np.ndarray, second: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The spike score of each reading, 0 if it is none, from the medians of FIRST and SECOND and the number of readings of
    each segment's whole series."""
    score = np.zeros(len(batch.x))
    if not len(score):
        return score
    measured = dict(zip(SECOND, second, strict=True))
    place = batch.ends()
    begin, last = place
    y = evened(batch, first)
    base = _noise(measured["fine"], measured["moving"], np.where(batch.whole, 1.0, 0.0))
    raw_base = np.where(batch.whole, base, _noise(measured["raw_fine"], measured["raw_moving"], 0.0))
    fine, raw_fine = (details(v, 1, place) / np.sqrt(1.5) for v in (y, batch.x))
    raw_fine = np.where(batch.whole[batch.of], fine, raw_fine)
    candidate = np.abs(fine) * np.sqrt(1.5) > (DETAIL_LIMIT * np.maximum(np.sqrt(1.5) * 1.4826 * measured["fine"], base))[batch.of]
    for s in SCALES[1:]:
        candidate |= np.abs(details(y, s, place)) > (DETAIL_LIMIT * np.maximum(1.4826 * measured[f"d{s}"], base))[batch.of]
    for end, sign in ((begin, 1), (last, -1)):  # the mirror makes details at the ends 0
        tips = np.unique(end)
        inner = y[np.clip(tips[:, None] + sign * np.arange(1, NEAR + 1), begin[tips][:, None], last[tips][:, None])]
        candidate[tips] |= np.abs(y[tips] - np.median(inner, axis=1)) > (DETAIL_LIMIT * base)[batch.of[tips]]
    candidate &= (count >= LEAST)[batch.of]
    x = np.where(batch.whole[batch.of], y, batch.x)
    left = np.arange(len(y))
    open_ = np.ones(batch.n, dtype=bool)  # segments from which a spike was taken last time
    reach = NEAR + WIDEST
    while True:
        of = batch.of[left]
        targets = np.flatnonzero(candidate[left] & open_[of])
        if not len(targets):
            return score
        size = np.bincount(of, minlength=batch.n)
        stop = np.cumsum(size)
        bounds = (stop - size)[of], stop[of]
        at = batch.at[left].astype(float)
        far = beyond(y[left], at, bounds, targets)
        base_t = base[of[targets]]
        hopeful = np.flatnonzero((far > 0.7 * base_t * SPIKE_LIMIT) & (size[of[targets]] >= LEAST))
        targets, far = targets[hopeful], far[hopeful]
        t = left[targets]
        own = far / np.maximum(_around(fine, t, place), 0.7 * base[batch.of[t]])
        raw_far = beyond(x[left], at, bounds, targets)
        raw = raw_far / np.maximum(_around(raw_fine, t, place), 0.7 * raw_base[batch.of[t]])
        # A fall to next to nothing is as far as values can fall, however small that is in plain deviations.
        fallen = ~batch.whole[batch.of[t]] & (batch.x[t] >= 0) & (batch.x[t] < FALLEN * (batch.x[t] + raw_far))
        good = (own > SPIKE_LIMIT) & (raw > np.where(fallen, FALLEN_LIMIT, SPIKE_LIMIT))
        targets, own = targets[good], own[good]
        # One that stands beside a far greater one waits until that is out of the way.
        passed = np.zeros(len(left) + 2 * reach * (batch.n + 1))
        shifted = targets + 2 * reach * (of[targets] + 1)
        passed[shifted] = own
        greatest = passed[shifted[:, None] + np.arange(-reach, reach + 1)].max(axis=1) if len(shifted) else own
        new = 2 * own >= greatest
        if not new.any():
            return score
        score[left[targets[new]]] = own[new]
        open_ = np.zeros(batch.n, dtype=bool)
        open_[of[targets[new]]] = True
        left = np.delete(left, targets[new])


def _around(fine: np.ndarray, t: np.ndarray, place: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The robust deviation of the details around each of some places, in their segments."""
    i = t[:, None] + np.arange(-AROUND, AROUND + 1)
    inside = (i >= place[0][t][:, None]) & (i <= place[1][t][:, None])
    values = np.where(inside, np.abs(fine[np.clip(i, 0, len(fine) - 1)]), np.inf)
    values.sort(axis=1)
    n, row = inside.sum(axis=1), np.arange(len(t))
    return 1.4826 * (values[row, (n - 1) // 2] + values[row, n // 2]) / 2


def _row_medians(rows: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Medians of rows, of their first n values after sorting if given."""
    ordered = np.sort(rows, axis=1)
    if n is None:
        k = rows.shape[1]
        return (ordered[:, (k - 1) // 2] + ordered[:, k // 2]) / 2
    row = np.arange(len(rows))
    return (ordered[row, np.maximum(n - 1, 0) // 2] + ordered[row, np.minimum(n // 2, rows.shape[1] - 1)]) / 2


def _side(y: np.ndarray, at: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], a: np.ndarray, sign: int) -> tuple[np.ndarray, ...]:
    """Of the NEAR values before each place a (sign -1) or from it on (1) inside its segment: their median, the median of the slopes between
    them, and the middle of their positions. Where fewer exist, the median is of those and the slope 0; where none exists, all are NaN.
    bounds are those of the segment of each a."""
    i = a[:, None] + (np.arange(-NEAR, 0) if sign < 0 else np.arange(NEAR))
    inside = (i >= bounds[0][:, None]) & (i < bounds[1][:, None])
    n = inside.sum(axis=1)
    i = np.clip(i, 0, len(y) - 1)
    w, t = y[i], at[i]
    middle = np.where(n > 0, _row_medians(np.where(inside, w, np.inf), n), np.nan)
    p, q = np.triu_indices(NEAR, 1)
    full = n == NEAR
    gap = t[:, q] - t[:, p]
    slope = np.where(full, _row_medians((w[:, q] - w[:, p]) / np.where(full[:, None], gap, 1.0)), 0.0)
    centre = np.where(n > 0, np.where(full, t[:, NEAR // 2], 0.0), np.nan)
    return middle, slope, centre


def beyond(y: np.ndarray, at: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], targets: np.ndarray) -> np.ndarray:
    """How far each target lies beyond what both sides of a group of up to WIDEST values, itself included, show.

    at holds the values' positions, rising in each segment; bounds the begin and end of each value's segment. What a side
    shows is the median of its NEAR values and their robust line extended; a value counts as beyond by the least distance to
    any of them if it is above all or below all. A group counts by its least member; a value by its best group. For a group
    at an end, the nearest FURTHEST values of the segment but those at the other end stand in for the side that doesn't exist,
    as it can't be told from a change of level otherwise.
    """
    best = np.zeros(len(targets))
    if not len(targets):
        return best
    begin, stop = bounds[0][targets], bounds[1][targets]
    sides = {}
    for d in range(-WIDEST + 1, 1):
        sides["left", d] = _side(y, at, (begin, stop), targets + d, -1)
    for d in range(1, WIDEST + 1):
        sides["right", d] = _side(y, at, (begin, stop), targets + d, 1)
    tips = np.flatnonzero((targets - begin < WIDEST) | (stop - targets <= WIDEST))
    for w in range(1, WIDEST + 1):
        for k in range(w):
            a, b = targets - k, targets - k + w
            fits = (a >= begin) & (b <= stop) & (stop - begin > w)
            if not fits.any():
                continue
            (lm, ls, lc), (rm, rs, rc) = sides["left", -k], sides["right", w - k]
            high_out, low_out = np.full(len(targets), -np.inf), np.full(len(targets), np.inf)
            for i in tips[fits[tips]]:
                far = WIDEST if stop[i] - begin[i] > w + WIDEST else 0  # what is odd at the other end doesn't hide what is here
                after, before = y[begin[i] + w : min(stop[i] - far, begin[i] + w + FURTHEST)], y[max(begin[i] + far, stop[i] - w - FURTHEST) : stop[i] - w]
                for is_end, others in ((a[i] == begin[i], after), (b[i] == stop[i], before)):
                    if is_end:
                        high_out[i], low_out[i] = max(high_out[i], others.max()), min(low_out[i], others.min())
            worst = np.full(len(targets), np.inf)
            for j in range(w):
                p = np.clip(a + j, 0, len(y) - 1)
                t = at[p]
                shown = (lm, lm + ls * (t - lc), rm, rm + rs * (t - rc))
                high, low = np.maximum(np.fmax.reduce(shown), high_out), np.minimum(np.fmin.reduce(shown), low_out)
                worst = np.minimum(worst, np.maximum(np.maximum(y[p] - high, low - y[p]), 0))
            best = np.where(fits, np.maximum(best, worst), best)
    return best
