"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

Distinct words of equal length stand as rows of one matrix and advance together, a character a
step. At each step the hashes of all substrings that end there are looked up among the sorted hashes
of the model's pieces; a maximum over the candidates chooses the last piece and stores its length as
the backpointer. Which candidates score depends on the model's kind:

* unigram: the score of the path so far plus the piece's own; the best path wins.
* BPE: the library's merges give each prefix one last piece, and a row of pieces is what merging
  gives exactly when each two neighbours are (Berglund and van der Merwe, 2023). So the candidate
  that may stand behind the last piece of its prefix scores, and it is the only one. Two pieces may
  stand side by side if undoing their merges, the latest first, never uncovers two symbols whose
  merge would have come earlier than the merge undone last. Ids equal the library's.

Characters that no piece covers become byte pieces or the unknown piece. A word begins at each space
after another character (no piece holds a space anywhere but in front), and the ids of a word are
kept from slice to slice.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import _text as tx
from tagloom.llm._cache import SpanCache, Table
from tagloom.llm._work import table

SPACE = 0x2581
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_P = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.int64(1) << 40
#: Pairs of pieces whose verdict is kept, at most.
VERDICTS = 2_000_000


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


class Sorted:
    """Sorted 64-bit keys with values; a bit map turns most misses away before the search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        order = np.argsort(keys)
        self.keys, self.values, self.shift = keys[order], values[order], np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[self.keys >> self.shift] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are held, and their values."""
        at = np.flatnonzero(self.there[keys >> self.shift])
        if not len(at):
            return at, self.values[:0]
        spot = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[spot] == keys[at]
        return at[hit], self.values[spot[hit]]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) * _P


def _hashes(points: np.ndarray) -> np.ndarray:
    """Rolling hashes of a matrix of code points: column j covers the first j characters."""
    h = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for j in range(points.shape[1]):
        h[:, j + 1] = h[:, j] * _P + tx.mix(points[:, j].astype(np.uint64) + np.uint64(77))
    return h


class Model:
    """What a model file says, as arrays. ``split`` and ``rank`` hold the merges of a BPE model."""

    def __init__(self, path: str):
        raw = open(path, "rb").read()
        self.text, self.score, self.type = [], [], []
        self.kind, prefix, squeeze, charsmap = UNIGRAM, True, True, b""
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                self.text.append(piece.get(1, b"").decode())
                self.score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.type.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(fields(value))
                charsmap, prefix, squeeze = spec.get(2, b""), spec.get(3, 1), spec.get(4, 1)
        if self.kind not in (UNIGRAM, BPE) or charsmap or squeeze or not prefix or USER in self.type or UNUSED in self.type:
            raise ValueError("only unigram and BPE models without normalisation, with the space in front, are known")
        if any(chr(SPACE) in t.lstrip(chr(SPACE)) for t in self.text):
            raise ValueError("a piece holds a space behind another character")
        self.score = np.array(self.score)
        self.unknown = self.type.index(UNKNOWN)
        self.byte = np.full(256, self.unknown, np.int32)
        for i, (t, kind) in enumerate(zip(self.text, self.type, strict=True)):
            if kind == BYTE:
                self.byte[int(t[3:5], 16)] = i
        self.falls_back = BYTE in self.type
        normal = [i for i, kind in enumerate(self.type) if kind == NORMAL]
        self.longest = max((len(self.text[i]) for i in normal), default=1)
        # rank: place in the order of merges; equal scores don't occur among a BPE model's merges
        self.rank = np.full(len(self.text) + 1, -1, np.int64)
        order = sorted(normal, key=lambda i: (-self.score[i], i))
        self.rank[order] = np.arange(len(order))
        self.left = np.arange(len(self.text) + 1, dtype=np.int32)
        self.right = self.left.copy()
        self._by = {self.text[i]: i for i in normal}
        if self.kind == BPE:
            normal = [i for i in normal if self._merge(i)]
        keys = np.concatenate([self._key(self.text[i]) for i in normal]) if normal else np.zeros(0, np.uint64)
        self.pieces = Sorted(keys, np.array(normal, np.int32))
        if self.kind == BPE:
            self.known = Table(22)
            self.verdict = np.zeros(1 << 22, bool)
            # every way in which two pieces make a third counts as a merge, not only the one that made it
            by, pairs = self._by, {}
            for i in normal:
                t = self.text[i]
                for k in range(1, len(t)):
                    if (one := by.get(t[:k])) is not None and (two := by.get(t[k:])) is not None:
                        pairs[one, two] = self.rank[i]
            both = np.array(list(pairs), np.int64).reshape(-1, 2)
            self.merges = Sorted(_pairs(both[:, 0], both[:, 1]), np.array(list(pairs.values()), np.int64), 22)
        self.power = np.cumprod(np.array([1] + [int(_P)] * self.longest, np.uint64))
        # bytes of each piece for decoding
        plain = [bytes([int(t[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else t.replace(chr(SPACE), " ").encode() for t, kind in zip(self.text, self.type, strict=True)]
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_len = np.array([len(x) for x in plain], np.int64)
        self.plain_at = np.cumsum(self.plain_len) - self.plain_len

    @staticmethod
    def _key(text: str) -> np.ndarray:
        return tx.mix(_hashes(np.array([[ord(c) for c in text]], np.int64))[:, -1] + np.uint64(len(text)))

    def _merge(self, i: int) -> bool:
        """Merge a piece's own characters; note its last merge. False if merging gives other pieces."""
        parts = list(self.text[i])
        while len(parts) > 2:
            best = min(((self.rank[k], j) for j in range(len(parts) - 1) if (k := self._by.get(parts[j] + parts[j + 1])) is not None), default=None)
            if best is None:
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:
            if parts[0] not in self._by or parts[1] not in self._by:
                return False
            self.left[i], self.right[i] = self._by[parts[0]], self._by[parts[1]]
        return True

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pieces b stay unmerged behind pieces a (-1: an uncovered character, which merges with nothing). Verdicts are kept."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero(a >= 0)
        key = tx.mix(_pairs(a[at], b[at])) | np.uint64(1)
        if self.known.size > VERDICTS:
            self.known = Table(22)
        slot = self.known.find(key)
        out[at] = self.verdict[slot]
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            new, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
            one = at[miss[one]]
            fresh = self._apart(a[one], b[one])
            self.verdict[self.known.add(new)] = fresh
            out[at[miss]] = fresh[back]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        u, v, limit = a, b, np.full(len(at), _NEVER)
        while len(at):
            cross = np.full(len(at), _NEVER)
            made, rank = self.merges.find(_pairs(u, v))
            cross[made] = rank
            merged = cross < limit
            out[at[merged]] = False
            # the merge that came last is undone; characters have none
            one, two = self.left[u] != u, self.left[v] != v
            ru, rv = np.where(one, self.rank[u], -1), np.where(two, self.rank[v], -1)
            first = one & (ru > rv)
            second = two & ~first
            # of equal merges the left one comes first: across the border before the right piece's, after the left one's
            limit = np.where(first, ru, np.where(second, rv + 1, limit))
            u, v = np.where(first, self.right[u], u), np.where(second, self.left[v], v)
            on = ~merged & (first | second)
            at, u, v, limit = at[on], u[on], v[on], limit[on]
        return out

    def segment(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of equal length (rows of code points): ids by end position (-1: none ends there, -2: uncovered), and the flags of ends."""
        rows, n = points.shape
        h = _hashes(points)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0.0
        last = np.full((rows, n + 1), -1, np.int32)  # piece that ends here, -1: uncovered character
        back = np.ones((rows, n + 1), np.int32)
        lost = float(self.score.min()) - 10.0
        for i in range(1, n + 1):
            spans = min(i, self.longest)
            value = np.full((rows, spans), -np.inf)
            ids = np.full((rows, spans), -1, np.int32)
            for k in range(1, spans + 1):
                got, found = self.pieces.find(tx.mix(h[:, i] - h[:, i - k] * self.power[k] + np.uint64(k)))
                if not len(got):
                    continue
                ids[got, k - 1] = found
                if self.kind == UNIGRAM:
                    value[got, k - 1] = best[got, i - k] + self.score[found]
                else:
                    fine = got if k == i else got[self.apart(last[got, i - k], found)]
                    value[fine, k - 1] = 0.0
            bare = np.flatnonzero(ids[:, 0] < 0)
            value[bare, 0] = best[bare, i - 1] + lost if self.kind == UNIGRAM else 0.0
            choice = value.argmax(1)
            every = np.arange(rows)
            best[:, i] = value[every, choice]
            last[:, i] = ids[every, choice]
            back[:, i] = choice + 1
        ends = np.zeros((rows, n + 1), bool)
        at = np.full(rows, n)
        live = np.arange(rows)
        while len(live):
            ends[live, at[live]] = True
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        return last, ends


class Codec(SpanCache):
    """Ids of words by a model file; one for each Python worker."""

    _made: dict = {}

    def __init__(self, path: str):
        self.model = Model(path)
        self._clear()

    @staticmethod
    def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = int(offsets[-1])
        space = data[:n] == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        return starts, np.diff(np.append(starts, n)), np.searchsorted(starts, offsets)

    def _encode(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        points = np.frombuffer(tx.gather(data, starts, lens).tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.concatenate(([0], np.cumsum((tx.gather(data, starts, lens) & 0xC0) != 0x80)))
        to = np.concatenate(([0], np.cumsum(lens)))
        first = lead[to]
        size = np.diff(first)
        points[points == 0x20] = SPACE
        pieces = np.empty(len(points), np.int32)  # by the character at which a piece ends
        ends = np.zeros(len(points), bool)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            step = max(1, 2_000_000 // (int(n) * 40))
            for a in range(0, len(rows), step):
                place = first[rows[a : a + step]][:, None] + np.arange(n)
                last, stop = m.segment(points[place])
                pieces[place], ends[place] = last[:, 1:], stop[:, 1:]
        at = np.flatnonzero(ends)
        ids, repeat = pieces[at].astype(np.int64), np.ones(len(at), np.int64)
        owner = np.searchsorted(first, at, "right") - 1
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            text = [chr(p).encode() for p in points[at[bare]].tolist()]
            if m.falls_back:
                repeat[bare] = [len(t) for t in text]
                ids = np.repeat(ids, repeat)
                ids[ids < 0] = m.byte[np.frombuffer(b"".join(text), np.uint8)]
            else:
                # neighbouring uncovered characters are one unknown piece
                follows = np.zeros(len(at), bool)
                follows[1:] = (ids[1:] < 0) & (ids[:-1] < 0) & (owner[1:] == owner[:-1])
                repeat[follows] = 0
                ids = np.where(ids < 0, m.unknown, ids)[~follows]
        return ids.astype(np.uint32), np.bincount(owner, weights=repeat, minlength=len(starts)).astype(np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offset of each text's first one."""
        data, offsets = tx.column(column)
        filled = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][filled], 0x20)  # the space in front
        offsets = offsets + np.concatenate(([0], np.cumsum(filled)))
        return self.ids(data, offsets)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of runs of ids; the space in front goes, bytes that aren't UTF-8 become U+FFFD."""
        m = self.model
        size = m.plain_len[ids]
        raw = tx.gather(m.plain, m.plain_at[ids], size).tobytes()
        to = np.concatenate(([0], np.cumsum(size)))[first]
        return [raw[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip(to[:-1], to[1:], strict=True)]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 and round_trip of each row of ``docs`` (doc_id, text).

    ids are those of the sentencepiece library for the model file at ``model`` (readable on every
    machine), of the whole text, without begin or end; ids_crc32 is taken over them as little-endian
    unsigned 32-bit integers; round_trip says whether decoding them gives the text back. Null or
    empty text: no ids. Null and repeated doc_ids: a row each. Nothing is shuffled; other columns
    are left out; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for batch in tx.slices(batches, "text", 2 << 20):
            ids, first = codec.encode(batch.column("text"))
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            same = [a == (b or "") for a, b in zip(codec.decode(ids, first), batch.column("text").to_pylist(), strict=True)]
            listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), listed, pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(model)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            first = np.concatenate(([0], np.cumsum([len(r or ()) for r in rows]))).astype(np.int64)
            ids = np.array([i for r in rows for i in r or ()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codec.decode(ids, first), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_sentencepiece": query}
ORACLE: dict[str, str] = {}
