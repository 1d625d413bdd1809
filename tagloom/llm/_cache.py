"""Ids of text spans, each distinct span encoded once: a table of 64-bit hashes and one pool of ids."""

from __future__ import annotations

import numpy as np

from tagloom.llm import _text as tx

#: Entries after which the cache begins anew, and the longest span (bytes) that it holds.
MOST_KEPT, LONGEST_KEPT = 2_400_000, 48


class Table:
    """Open addressing from 64-bit hashes to slots, all keys of a call at once."""

    def __init__(self, bits: int = 16):
        self.bits = bits
        self.shift, self.mask, self.size = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.key = np.zeros(1 << bits, np.uint64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots, -1 where a hash isn't held."""
        out = np.full(len(h), -1, np.int64)
        at, slot = np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(at):
            k = self.key[slot]
            hit = k == h[at]
            out[at[hit]] = slot[hit]
            on = ~hit & (k != 0)
            at, slot = at[on], (slot[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Slots for distinct hashes that aren't held yet."""
        out = np.empty(len(h), np.int64)
        at, slot = np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(at):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[at[free]]
            won = free & (self.key[slot] == h[at])
            out[at[won]] = slot[won]
            at, slot = at[~won], (slot[~won] + 1) & self.mask
        self.size += len(h)
        return out


class SpanCache:
    """Cuts texts into spans that are encoded on their own; one for each file and Python worker.

    Subclasses give ``spans`` (starts, lengths, each document's first span) and ``_encode`` (ids of
    all spans in order, and their number for each span). Tables begin small and double, so that a
    worker that is kept for later stages holds no more than its spans need. A cache serves either
    ``ids`` or ``counts``; for the latter no ids are kept.
    """

    _made: dict

    def _clear(self) -> None:
        self.held, self.pool, self.filled = Table(), np.zeros(1 << 16, np.uint32), 0
        self.at, self.n = np.zeros(len(self.held.key), np.int32), np.zeros(len(self.held.key), np.int32)

    @classmethod
    def of(cls, path: str, use: str = "ids") -> "SpanCache":
        if (path, use) not in cls._made:
            cls._made[path, use] = cls(path)
        return cls._made[path, use]

    def _add(self, keys: np.ndarray) -> np.ndarray:
        """Slots for new hashes, in a table at most half full."""
        bits = self.held.bits
        while (self.held.size + len(keys)) * 2 > 1 << bits:
            bits += 1
        if bits > self.held.bits:
            old, wider = np.flatnonzero(self.held.key), Table(bits)
            to = wider.add(self.held.key[old])
            at, n = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
            at[to], n[to] = self.at[old], self.n[old]
            self.held, self.at, self.n = wider, at, n
        return self.held.add(keys)

    def _hashed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts, lengths and hashes of all cuts, first cut of each document, and their slots, -1 where they are new."""
        starts, lens, first = self.spans(data, offsets)
        h = tx.hash_spans(data, starts, lens)
        h |= np.uint64(h == 0)
        if self.held.size > MOST_KEPT:
            self._clear()
        return starts, lens, h, first, self.held.find(h)

    def look(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all cuts: place in the pool and number of ids; first cut of each document; the pool."""
        starts, lens, h, first, slot = self._hashed(data, offsets)
        at, n = self.at[slot], self.n[slot]
        miss = np.flatnonzero(slot < 0)
        pool = self.pool
        if len(miss):
            key, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            ids, counts = self._encode(data, starts[one], lens[one])
            keep = lens[one] <= LONGEST_KEPT
            order = np.argsort(~keep, kind="stable")  # what is kept comes first in the pool
            kept = np.repeat(keep, counts)
            ids = np.concatenate((ids[kept], ids[~kept]))
            place = np.empty(len(key), np.int64)
            place[order] = self.filled + np.cumsum(counts[order]) - counts[order]
            if self.filled + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool[: self.filled], np.empty(self.filled + len(ids), np.uint32)))
            pool = self.pool
            pool[self.filled : self.filled + len(ids)] = ids
            self.filled += int(counts[keep].sum())
            new = self._add(key[keep])
            self.at[new], self.n[new] = place[keep], counts[keep]
            at[miss], n[miss] = place[back], counts[back]
        return at, n, first, pool

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each document: how often each of its distinct cuts stands in it, times the cut's count."""
        starts, lens, h, first, _ = self._hashed(data, offsets)
        distinct, one, back = np.unique(h, return_index=True, return_inverse=True)
        slot = self.held.find(distinct)
        n = self.n[slot].astype(np.int64)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            n[miss] = self._encode(data, starts[one[miss]], lens[one[miss]])[1]
            keep = miss[lens[one[miss]] <= LONGEST_KEPT]
            new = self._add(distinct[keep])  # may replace the tables
            self.n[new] = n[keep]
        # frequencies of (document, distinct cut), joined to the counts
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pair, often = np.unique(owner * len(distinct) + back, return_counts=True)
        return np.bincount(pair // max(1, len(distinct)), weights=often * n[pair % max(1, len(distinct))], minlength=len(first) - 1).astype(np.int64)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offset of each document's first one."""
        at, n, first, pool = self.look(data, offsets)
        total = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        return pool[np.arange(total[-1]) + np.repeat(at - total[:-1], n)], total[first]
