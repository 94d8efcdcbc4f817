"""Tokenising by distinct units: cut texts where no token can reach across, encode each distinct unit once.

A worker keeps a bounded open-addressing table from the hash of a unit to its ids, all in
numpy. Only units that are not in it reach the encoder, as one list per chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from cloakframe.llm.common import Multipliers, span_hashes


class UnitTable:
    """Unit -> ids. Emptied when it holds `limit` units, so its size is bounded."""

    def __init__(self, encode: Callable[[list[str]], list], bits: int = 21) -> None:
        self.encode, self.mask, self.limit = encode, np.uint64((1 << bits) - 1), 1 << (bits - 1)
        self.by = Multipliers(11)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.zeros(int(self.mask) + 1, np.int32)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used, self.n = np.zeros(1 << 15, np.int32), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        todo, slot = np.arange(len(h)), h & self.mask
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def _insert(self, h: np.ndarray, value: np.ndarray) -> None:
        todo, slot = np.arange(len(h)), h & self.mask
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            won = free & (self.keys[slot] == h[todo])
            self.values[slot[won]] = value[todo[won]]
            todo, slot = todo[~won], (slot[~won] + np.uint64(1)) & self.mask

    def _append(self, ids: list) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(sizes.sum()), self.n + len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : n] = sizes
        if total:
            self.flat[self.used : self.used + total] = np.concatenate([np.asarray(x, np.int32) for x in ids if len(x)])
        self.used, self.n = self.used + total, n

    def ids(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, number of ids of each); units begin at `first` and cover `points`."""
        lens = np.diff(np.append(first, len(points)))
        h = span_hashes(points, lens, self.by)
        h[h == 0] = 1
        if self.n > self.limit // 2 and self.n + len(np.unique(h)) > self.limit:
            self.clear()
        at = self._find(h)
        if (new := np.flatnonzero(at < 0)).size:
            distinct, index = np.unique(h[new], return_index=True)
            index = new[index]
            units = [points[first[i] : first[i] + lens[i]].tobytes().decode("utf-32-le") for i in index]
            if self.n + len(units) > self.limit:  # one chunk with more distinct units than the table takes
                distinct_ids = self.encode(units)
                back = np.searchsorted(distinct, h[new])
                known = {int(i): self.flat[self.start[at[i]] : self.start[at[i]] + self.size[at[i]]] for i in np.flatnonzero(at >= 0)}
                parts = [known[i] if i in known else None for i in range(len(h))]
                for i, b in zip(new, back, strict=True):
                    parts[i] = np.asarray(distinct_ids[b], np.int32)
                return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            value = np.arange(self.n, self.n + len(units), dtype=np.int32)
            self._append(self.encode(units))
            self._insert(distinct, value)
            at[new] = value[np.searchsorted(distinct, h[new])]
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(total)], sizes


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of texts as code points and offsets in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, heads[offsets]


def per_text(sizes: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of each text's ids, from the number of ids of each unit."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return total[np.searchsorted(first, offsets, "left")]
