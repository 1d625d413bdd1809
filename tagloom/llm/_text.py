"""Vectorised byte kernels over Arrow string columns.

A column is seen as one run of UTF-8 bytes and the document offsets into it; words, lines and
n-grams are found and hashed with a fixed number of numpy passes, without a Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: White space of the word pattern [^\x20\x09-\x0D]+ .
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
#: Odd multipliers, one for each place of an n-gram.
PLACES = np.array([(0xD6E8FEB86659FD93 * (2 * k + 3) ** 5 + 2 * k) % 2**64 | 1 for k in range(32)], dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * _M2
    h ^= h >> U64(27)
    h *= _M3
    h ^= h >> U64(31)
    return h


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (with eight zero bytes after the end) and document offsets; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    n = len(array)
    if n == 0:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if data is not None:
        raw[:-8] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of at most ``most`` text bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:start+len]; ``data`` ends with eight spare bytes."""
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = (lens.astype(U64) + U64(1)) * _M1
    if not len(starts):
        return h
    h ^= lanes[starts] & _MASK[np.minimum(lens, 8)]
    h *= _M2
    h ^= h >> U64(32)
    more, at = np.flatnonzero(lens > 8), 8
    while len(more):
        rest = lens[more] - at
        x = h[more] ^ (lanes[starts[more] + at] & _MASK[np.minimum(rest, 8)])
        x *= _M3
        x ^= x >> U64(29)
        h[more] = x
        more, at = more[rest > 8], at + 8
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words (runs without a byte of ``gap``), and the index of each document's first word (one entry more than documents)."""
    n = int(offsets[-1])
    solid = ~gap[data[:n]]
    # a word begins where a solid byte follows white space or a document's start
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = solid[first]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[last] = solid[last]
    starts = np.flatnonzero(begin)
    lens = np.flatnonzero(stop) + 1 - starts
    return starts, lens, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside a document, and the word index at which each begins."""
    m = len(hashes) - size + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = hashes[:m] * PLACES[0]
    for k in range(1, size):
        h += hashes[k : m + k] * PLACES[k]
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)[:m]
    at = np.flatnonzero(np.arange(m) + size <= ends)
    return mix(h[at]), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes; a text of fewer words than ``size`` is one shingle, no words none."""
    data = LOWER[data]
    starts, lens, first = words(data, offsets)
    h = hash_spans(data, starts, lens)
    g, at = grams(h, first, size)
    cut = np.searchsorted(at, first)
    out = []
    for d in range(len(offsets) - 1):
        a, b = cut[d], cut[d + 1]
        if b > a:
            x = g[a:b].copy()
            x.sort()
            out.append(x if b - a == 1 else x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif first[d + 1] > first[d]:
            w = h[first[d] : first[d + 1]]
            out.append(mix((w * PLACES[8 : 8 + len(w)]).sum(keepdims=True) + U64(len(w))))
        else:
            out.append(g[:0])
    return out


def gather(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.uint8)
    shift = starts - np.concatenate(([0], np.cumsum(lens)[:-1]))
    return data[np.arange(total) + np.repeat(shift, lens)]
