"""Prediction by partial matching over bytes: exact code lengths of texts under frozen statistics of several classes.

A class's model is a variable-order context tree: for each context of up to ORDER bytes the counts of the bytes that
followed. A byte seen in the longest context costs -log2(c / (n + q)), where n is the context's count and q the number
of different bytes in it; one not seen costs the escape -log2(q / (n + q)) and is looked up in the next shorter context;
below order 0 all 256 bytes cost 8 bits. Statistics are frozen after training, so that the cost of every known
(context, byte) can be resolved once for all classes, and texts are scored by sorted-array lookups over whole batches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from os import PathLike

import numpy as np

ORDER = 5
#: Bytes scored at once.
CHUNK = 1 << 17
GAP = b"\n" * (ORDER + 1)


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """For each place the byte and the k bytes before it as one number, the oldest byte highest; from place k on."""
    out = np.zeros(len(data) - k, dtype=np.uint64)
    for j in range(k, -1, -1):
        out = (out << np.uint64(8)) | data[k - j : len(data) - j]
    return out


class ByteModels:
    """Context trees of several classes in common tables."""

    def __init__(self, texts: Mapping[str, Sequence[str]], order: int = ORDER):
        self.classes = sorted(texts)
        self.order = order
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by order and class: grams, counts
        for k in range(order + 1):
            per_class = []
            for c in self.classes:
                data = np.frombuffer(GAP + b"".join(t.encode() + GAP for t in texts[c]), dtype=np.uint8).astype(np.uint64)
                per_class.append(np.unique(_grams(data, k), return_counts=True))
            counts.append(per_class)
        self.known: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        for k in range(order + 1):
            self._resolve(k, counts[k])

    def _resolve(self, k: int, per_class: list[tuple[np.ndarray, np.ndarray]]) -> None:
        known = np.unique(np.concatenate([g for g, _ in per_class]))
        contexts = np.unique(known >> np.uint64(8))
        escape = np.zeros((len(contexts), len(self.classes)), dtype=np.float32)
        if k:
            shorter = known & np.uint64((1 << (8 * k)) - 1)
            cost = self.cost[k - 1][np.searchsorted(self.known[k - 1], shorter)].copy()
        else:
            cost = np.full((len(known), len(self.classes)), 8.0, dtype=np.float32)
        for c, (grams, n_gram) in enumerate(per_class):
            at, first, distinct = np.unique(grams >> np.uint64(8), return_index=True, return_counts=True)
            if not len(grams):
                continue
            total = np.add.reduceat(n_gram, first)
            row = np.searchsorted(contexts, at)
            escape[row, c] = -np.log2(distinct / (total + distinct))
            mine = np.searchsorted(contexts, known >> np.uint64(8))
            cost[:, c] += escape[mine, c]
            which = np.searchsorted(at, grams >> np.uint64(8))
            cost[np.searchsorted(known, grams), c] = -np.log2(n_gram / (total[which] + distinct[which]))
        self.known.append(known)
        self.cost.append(cost.astype(np.float32))
        self.contexts.append(contexts)
        self.escape.append(escape)

    def save(self, path: str | PathLike) -> None:
        """Write the frozen statistics as one file, to be loaded instead of trained."""
        tables = {f"{name}_{k}": a[k] for k in range(self.order + 1) for name, a in self._tables().items()}
        np.savez_compressed(path, classes=np.array(self.classes), order=np.array(self.order), **tables)

    @classmethod
    def load(cls, path: str | PathLike) -> ByteModels:
        models = cls.__new__(cls)
        with np.load(path) as kept:
            models.classes, models.order = kept["classes"].tolist(), int(kept["order"])
            for name in ("known", "cost", "contexts", "escape"):
                setattr(models, name, [kept[f"{name}_{k}"] for k in range(models.order + 1)])
        return models

    def _tables(self) -> dict[str, list[np.ndarray]]:
        return {"known": self.known, "cost": self.cost, "contexts": self.contexts, "escape": self.escape}

    def code_lengths(self, texts: Sequence[str]) -> np.ndarray:
        """Bits of each text (rows) under each class (columns)."""
        bits = np.zeros((len(texts), len(self.classes)))
        parts: list[bytes] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "replace")
            for at in range(0, len(raw), CHUNK):
                # A later part of a very long text begins with the bytes before it as its context.
                parts.append(GAP[:-1] + raw[at : at + CHUNK] if not at else raw[at - self.order : at + CHUNK])
                owner.append(i)
                size += len(parts[-1])
            if size >= CHUNK:
                self._add(bits, parts, owner)
                parts, owner, size = [], [], 0
        if parts:
            self._add(bits, parts, owner)
        return bits

    def _add(self, bits: np.ndarray, parts: list[bytes], owner: list[int]) -> None:
        data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
        ends = np.cumsum([len(p) for p in parts])
        begins = np.concatenate([[0], ends[:-1]])
        scored = np.ones(len(data), dtype=bool)
        for j in range(self.order):
            scored[np.minimum(begins + j, len(data) - 1)] = False
        place = np.flatnonzero(scored)
        full = np.zeros(len(data), dtype=np.uint64)
        full[self.order :] = _grams(data, self.order)
        gram = full[place]
        cost = np.zeros((len(place), len(self.classes)), dtype=np.float32)
        todo = np.arange(len(place))
        for k in range(self.order, -1, -1):
            g = gram[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(self.known[k], g), len(self.known[k]) - 1)
            hit = self.known[k][at] == g
            cost[todo[hit]] += self.cost[k][at[hit]]
            todo, g = todo[~hit], g[~hit]
            if not len(todo):
                break
            context = g >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            seen = self.contexts[k][at] == context
            cost[todo[seen]] += self.escape[k][at[seen]]
        else:
            cost[todo] += 8.0
        part = np.searchsorted(ends, place, side="right")
        sums = np.zeros((len(parts), len(self.classes)))
        np.add.at(sums, part, cost) if len(parts) < 2 else self._sum(sums, part, cost)
        np.add.at(bits, np.array(owner), sums)

    @staticmethod
    def _sum(sums: np.ndarray, part: np.ndarray, cost: np.ndarray) -> None:
        present, first = np.unique(part, return_index=True)
        sums[present] = np.add.reduceat(cost.astype(np.float64), first, axis=0)
