"""Texts of varying length into containers of fixed capacity, by multiway differencing.

Items are dealt by hash into blocks of about WINDOWS containers' worth of tokens. In a block they are dealt into groups
that add up to GROUP windows as nearly as may be. Each group is differenced: the largest differencing method keeps a heap
of partial partitions, each a vector of window sums, and merges the two of greatest spread by putting the largest sums of
one on the smallest of the other, until one partition into near-equal windows is left. Windows filled to the last token
are closed; the items of all others, among them those of windows that exceed the capacity, are dealt anew and differenced
again, for up to ROUNDS rounds. What is left is differenced as a whole, with a number of windows that rises while the
capacity is exceeded, up to the number best-fit decreasing needs, whose placement is taken then: so no block takes more
windows than by best fit. Last, the items of windows with more than LOOSE of their capacity unused are put together over
all blocks and packed once more.

Only a text longer than the capacity is split: into full pieces and a rest, which is an item like others. Defined cases:
a null or empty text has 0 tokens and goes to a container of its block, as does each empty piece; equal sizes are taken
in the order of ids; capacities below 1 or null are refused; an empty table needs no containers. Each block of the second
packing leaves at most part of its last windows unused.
"""

from __future__ import annotations

import heapq
import operator
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.plans.sizing import written_if_small
from rillflow.plans.storage import materialize, shuffle_width

WINDOWS, GROUP, ROUNDS, CHECKED, MOST_KINDS = 2048, 16, 12, 4, 100
#: Part of a window that may stay unused without its items being packed once more with those of other blocks.
LOOSE = 1 / 256
_SUM = operator.itemgetter(0)


def difference(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Partition items into k windows of near-equal sums: lists of item numbers, some perhaps empty."""
    if not len(sizes):
        return [[] for _ in range(k)]
    # Windows (sum, items) in falling order; those still empty are left out, so a spread is the largest sum less the least or 0.
    heap: list[tuple[int, int, list[tuple]]] = [(-int(s) if k > 1 else 0, i, [(int(s), i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heap[0][2]
        both = len(a) + len(b) - k  # so many windows get sums of both, the smallest of a with the largest of b
        if both <= 0:
            merged = a + b
        else:
            if len(a) < len(b):
                a, b = b, a
            both = min(both, len(b))
            head = len(a) - both
            merged = a[:head] + [(x + y, (t, u)) for (x, t), (y, u) in zip(a[head:], b[both - 1 :: -1], strict=True)] + b[both:]
        merged.sort(key=_SUM, reverse=True)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heapreplace(heap, (-spread, n, merged))
        n += 1
    windows = [_leaves(tree) for _, tree in heap[0][2]]
    return windows + [[] for _ in range(k - len(windows))]


def _leaves(tree: int | tuple) -> list[int]:
    """The items of a window, which is a tree of pairs."""
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo.extend(t)
        else:
            out.append(t)
    return out


def groups(sizes: np.ndarray, items: np.ndarray, target: int) -> Iterator[np.ndarray]:
    """Deal items into groups whose sums reach the target as nearly as may be; the last is what is left.

    A group is a stretch of the items as they come, filled up from a stock, the last of them, by the largest that fit.
    """
    n = max(1, round(int(sizes[items].sum()) / target))
    cut = len(items) - len(items) // n if n > 1 else len(items)
    stock = sorted((int(sizes[i]), int(i)) for i in items[cut:])
    group: list[int] = []
    room = target
    for i in items[:cut]:
        if sizes[i] > room and n > 1:
            while (j := bisect_right(stock, (room, len(sizes))) - 1) >= 0 and room:
                size, more = stock.pop(j)
                group.append(more)
                room -= size
            yield np.array(group, dtype=np.int64)
            group, room = [], target
        group.append(int(i))
        room -= int(sizes[i])
    yield np.array(group + [i for _, i in stock], dtype=np.int64)


def best_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item, from the largest, into the window it leaves least room in."""
    rooms: list[tuple[int, int]] = []  # room and number of each window, rising
    windows: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(rooms, (sizes[i], -1))
        room, w = rooms.pop(at) if at < len(rooms) else (capacity, len(windows))
        if w == len(windows):
            windows.append([])
        windows[w].append(i)
        insort(rooms, (room - sizes[i], w))
    return windows


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of item numbers, none above the capacity; every item (at most the capacity long) in exactly one.

    Rounds after which more windows would be needed in the end than by best-fit decreasing from the start are taken back.
    """
    sizes = sizes.astype(np.int64)
    full: list[list[int]] = [[int(i)] for i in np.flatnonzero(sizes == capacity)]
    left = np.flatnonzero((sizes > 0) & (sizes < capacity))
    rng = np.random.default_rng(len(left))  # the same items are always dealt alike
    closed: list[list[int]] = []
    fitted = best_fit(sizes[left].tolist(), capacity)
    most = len(fitted)
    for _ in range(ROUNDS // CHECKED):
        now, open_ = [], left
        for _ in range(CHECKED):
            if sizes[open_].sum() > GROUP * capacity:
                more, open_ = _round(sizes, rng.permutation(open_), capacity)
                now += more
        rest = best_fit(sizes[open_].tolist(), capacity)
        if not now or len(closed) + len(now) + len(rest) > most:
            break
        closed, left, fitted = closed + now, open_, rest
    own = sizes[left].tolist()
    out = full + closed + [left[w].tolist() for w in _near_equal(own, capacity, len(fitted)) or fitted]
    empty = np.flatnonzero(sizes <= 0).tolist()
    if empty:
        out = out or [[]]
        out[0] += empty
    return out


def _round(sizes: np.ndarray, items: np.ndarray, capacity: int) -> tuple[list[list[int]], np.ndarray]:
    """The windows that differencing fills to the last token, and the other items."""
    closed: list[list[int]] = []
    open_: list[int] = []
    for group in groups(sizes, items, GROUP * capacity):
        own = sizes[group].tolist()
        for w in difference(own, -(-sum(own) // capacity)):
            (closed.append if sum(own[i] for i in w) == capacity else open_.extend)(group[w].tolist())
    return closed, np.array(open_, dtype=np.int64)


def _near_equal(sizes: list[int], capacity: int, most: int) -> list[list[int]] | None:
    """Near-equal windows, their number rising while one exceeds the capacity; None if it would reach most."""
    for k in range(-(-sum(sizes) // capacity), most):
        windows = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
    return None


def pieces(sized: DataFrame, capacities: DataFrame) -> DataFrame:
    """sized(doc_id, n_tokens) x capacities -> container_kind, capacity_tokens, doc_id, piece, first_token, n_tokens."""
    kinds = capacities.select("container_kind", F.expr("assert_true(capacity_tokens >= 1)").alias("ok"), F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    # Each document meets every kind of container: the kinds are a fixed handful, collected into an array.
    known = kinds.where("ok IS NULL").select("container_kind", "capacity_tokens").limit(MOST_KINDS + 1).collect()
    if len(known) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    offers = F.array(*(F.struct(F.lit(r[0]).alias("container_kind"), F.lit(r[1]).alias("capacity_tokens")) for r in known))
    each = sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("size"), F.explode(offers).alias("kind")).select("doc_id", "size", "kind.*")
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens")))
    split = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    first = F.col("piece") * F.col("capacity_tokens")
    return split.select("container_kind", "capacity_tokens", "doc_id", "piece", first.alias("first_token"), F.least("capacity_tokens", F.col("size") - first).alias("n_tokens"))


PACKED = "container_kind string, capacity_tokens bigint, container_id bigint, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint, loose boolean"


def pack_documents(sized: DataFrame, capacities: DataFrame) -> DataFrame:
    """-> container_kind, container_id, doc_id, piece, first_token, n_tokens: every piece in exactly one container."""
    cut = pieces(materialize(sized.select("doc_id", "n_tokens"), "sized"), capacities)
    first = materialize(_packed(cut, stage=0), "packed")
    again = _packed(first.where("loose"), stage=1)
    return first.where("NOT loose").unionByName(again).drop("capacity_tokens", "loose")


def _packed(cut: DataFrame, stage: int) -> DataFrame:
    """The pieces of each block with their containers, and whether these are loose."""
    need = F.sum("n_tokens") / (F.col("capacity_tokens") * WINDOWS)
    blocks = cut.groupBy("container_kind", "capacity_tokens").agg(F.greatest(F.lit(1), F.round(need)).cast("bigint").alias("n_blocks"))
    dealt = cut.join(written_if_small(blocks.select("container_kind", "n_blocks"), "blocks"), "container_kind")
    dealt = dealt.select(
        "container_kind", "capacity_tokens", "doc_id", "piece", "first_token", "n_tokens",
        (F.pmod(F.xxhash64("doc_id", "piece", F.lit(stage)), F.col("n_blocks")) * 2 + stage).alias("block"),
    )
    spread = dealt.repartition(shuffle_width(cut), "container_kind", "block").sortWithinPartitions("container_kind", "block", "doc_id", "piece")
    return spread.mapInPandas(_pack_blocks, PACKED)


def _pack_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        held.append(batch)
        last = batch.iloc[-1]
        first = batch.iloc[0]
        if (first["container_kind"], first["block"]) == (last["container_kind"], last["block"]) == (held[0].iloc[0]["container_kind"], held[0].iloc[0]["block"]):
            continue  # a block that may go on
        rows = pd.concat(held)
        open_ = ((rows["container_kind"] == last["container_kind"]) & (rows["block"] == last["block"])).to_numpy()
        held = [rows[open_]]
        for _, block in rows[~open_].groupby(["container_kind", "block"], sort=False):
            yield _contained(block)
    for _, block in pd.concat(held).groupby(["container_kind", "block"], sort=False) if held else ():
        yield _contained(block)


def _contained(block: pd.DataFrame) -> pd.DataFrame:
    sizes, capacity = block["n_tokens"].to_numpy(dtype=np.int64), int(block["capacity_tokens"].iloc[0])
    window, loose = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=bool)
    for j, items in enumerate(pack(sizes, capacity)):
        window[items] = j
        loose[items] = sizes[items].sum() < capacity * (1 - LOOSE)
    out = block[["container_kind", "capacity_tokens", "doc_id", "piece", "first_token", "n_tokens"]].copy()
    out.insert(2, "container_id", block["block"].to_numpy() * (1 << 24) + window)
    return out.assign(loose=loose)
