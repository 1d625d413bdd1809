"""Byte-level BPE through distinct pre-tokens.

A text is cut before every single space between two visible characters. The pattern of byte-level
BPE always ends a pre-token there and looks back at nothing, so the pieces of a text are those of
its cuts, one after the other. Each distinct cut is given to the tokenizers library once and kept
in a compact cache (a table of 64-bit hashes, one pool of ids); all else is array arithmetic.
"""

from __future__ import annotations

import os

import numpy as np

from tagloom.llm import _text as tx
from tagloom.llm._cache import LONGEST_KEPT, SpanCache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the cuts, and each document's first cut (one entry more than documents)."""
    n = int(offsets[-1])
    space = np.flatnonzero(data[:n] == 0x20)
    space = space[(space > 1) & (space < n - 1)]
    before, after = data[space - 1], data[space + 1]
    # next to a space: printable ASCII, or U+00C0..U+00FF (lead byte C3), none of which is white space
    ok = (_VISIBLE[before] | ((before >= 0x80) & (data[space - 2] == 0xC3))) & (_VISIBLE[after] | (after == 0xC3))
    space = space[ok]
    flag = np.zeros(n + 1, bool)
    flag[space] = True
    filled = offsets[:-1] < offsets[1:]
    flag[offsets[1:][filled] - 1] = False  # a space that ends a text has the next text behind it
    flag[offsets[:-1][filled]] = True
    starts = np.flatnonzero(flag[:n])
    lens = np.diff(np.append(starts, n))
    return starts, lens, np.searchsorted(starts, offsets)


class Pieces(SpanCache):
    """Ids of cuts by the tokenizer file at ``path``; one for each Python worker."""

    _made: dict = {}
    spans = staticmethod(cuts)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.width[i] = len(piece)  # one character stands for one byte
        self._clear()

    def _encode(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans in order, and their number for each span."""
        counts = np.zeros(len(starts), np.int64)
        led = (data[starts] == 0x20) & (lens > 1) & (_VISIBLE[data[starts + 1]] | (data[starts + 1] == 0xC3)) & (lens <= LONGEST_KEPT)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        run = np.flatnonzero(led)
        # spans that begin with a space are joined, 64 KB at a time, and told apart by the pieces' widths
        block = np.cumsum(lens[run]) >> 16
        edges = np.searchsorted(block, np.arange(block[-1] + 2)) if len(run) else [0]
        groups = [run[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
        texts = [tx.gather(data, starts[g], lens[g]).tobytes().decode() for g in groups]
        for g, e in zip(groups, self.lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends, wanted = np.cumsum(self.width[ids]), np.cumsum(lens[g])
            stop = np.searchsorted(ends, wanted, "right")
            if not np.array_equal(ends[stop - 1], wanted):
                raise ValueError("a piece crosses a cut")
            counts[g] = np.diff(stop, prepend=0)
            parts.append((g, ids))
        alone = np.flatnonzero(~led)
        texts = [data[s : s + k].tobytes().decode() for s, k in zip(starts[alone], lens[alone], strict=True)]
        own = [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        counts[alone] = [len(x) for x in own]
        to = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for g, ids in parts:
            out[np.repeat(to[g] - (np.cumsum(counts[g]) - counts[g]), counts[g]) + np.arange(len(ids))] = ids
        for i, ids in zip(alone, own, strict=True):
            out[to[i] : to[i] + len(ids)] = ids
        return out, counts
