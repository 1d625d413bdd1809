"""Ranked lexical search: dual-sorted wavelet trees, one for each shard of documents, searched best-first.

A shard holds the postings of a few megabytes of text. The list of a term is ordered by impact (the part
of a document's score that the term adds, before the term's weight), all lists stand behind each
other, and a wavelet tree over the documents' places in ascending doc_id keeps that order in each of its
nodes. So a node is a range of doc_ids, a list is one interval in it, and the first entry of
that interval has the largest impact that the term has anywhere in the range: the sum of these over a query's
terms bounds every score below the node, and at a leaf it is the score. Opening the nodes with the
largest bounds first, and none that can't reach the k-th score found, gives the exact top k.

The tree lies in the level-wise layout (a wavelet matrix): at every level the entries whose next bit of
the place is 0 go before those where it is 1, in unchanged order. Impacts are stored once, by list; a
task that loads a shard carries them down the levels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm import _text as tx
from tagloom.llm._work import new_dir, stored, table

#: Bytes of text of a shard (a longer text is one alone), and of a row group of the index.
SHARD, ROW_GROUP = 8 << 20, 32 << 20
#: Items and (item, term) pairs of a block of queries, and pairs that are searched side by side.
BLOCK_ITEMS, BLOCK_PAIRS, SIDE_BY_SIDE = 1024, 200_000, 1500
#: Nodes of a query that are opened together: at first, and at most.
WIDTH, WIDEST = 16, 512
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Bytes that part terms: ASCII but letters and digits.
GAP = np.ones(256, bool)
GAP[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = False
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id: behind all others

INDEX = "docs binary, terms binary, starts binary, impacts binary, bits binary, all_docs long, all_terms long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in tx.slices(batches, "text"):
        data, offsets = tx.column(batch.column("text"))
        n = np.diff(tx.words(data, offsets, GAP)[2])
        docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


def _shard(doc_ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, all_docs: int, all_terms: int) -> dict[str, bytes]:
    """The lists of one shard by impact, and the bits of their wavelet tree, a level after the other."""
    order = np.argsort(doc_ids, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    data = tx.LOWER[data]
    starts, lens, first = tx.words(data, offsets, GAP)
    counts = np.diff(first)
    spread = np.array([25 + 75 * n * all_docs // max(1, all_terms) for n in counts.tolist()], np.int64)  # whole numbers of any size
    terms, term = np.unique(tx.hash_spans(data, starts, lens), return_inverse=True)
    d = max(1, len(order))
    pair, tf = np.unique(term.astype(np.int64) * d + np.repeat(place, counts), return_counts=True)
    term, at = pair // d, pair % d
    impact = 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * spread[order][at])
    by = np.argsort((term << 20) | ((1 << 20) - 1 - impact), kind="stable")  # an impact is below 1,000,000
    impact, at, packed = impact[by].astype("<i4"), at[by], []
    for level in range((d - 1).bit_length() - 1, -1, -1):
        bit = (at >> level & 1).astype(bool)
        packed.append(np.packbits(bit).tobytes())
        at = np.concatenate((at[~bit], at[bit]))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms))))).astype("<i8")
    return {"docs": doc_ids[order].astype("<i8").tobytes(), "terms": terms.astype("<u8").tobytes(), "starts": bounds.tobytes(), "impacts": impact.tobytes(), "bits": b"".join(packed)}


def _build(all_docs: int, all_terms: int, most: int):
    schema = pa.schema([(c, pa.binary()) for c in ("docs", "terms", "starts", "impacts", "bits")] + [("all_docs", pa.int64()), ("all_terms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text", most):
            ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            made = _shard(ids, *tx.column(batch.column("text")), all_docs, all_terms)
            yield pa.RecordBatch.from_pylist([made | {"all_docs": all_docs, "all_terms": all_terms}], schema=schema)

    return run


def build_index(docs: DataFrame, at: str | None = None, most: int = SHARD) -> str:
    """Index all rows of ``docs`` (doc_id, text) below the folder ``at``, by default a new one in the shared folder; returns it.

    Terms are the runs of letters, digits and characters beyond ASCII, with A-Z lower-cased, told apart
    by 64-bit hashes. Texts are read twice: impacts depend on the mean length of all documents. A null or
    empty text has no terms; rows that repeat a doc_id are documents of their own; other columns are
    left out. Shards are formed where the rows lie, so nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sums = rows.select("text").mapInArrow(_count, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).head()
    at = at or new_dir(docs.sparkSession, "search-index")
    made = rows.mapInArrow(_build(sums["docs"] or 0, sums["terms"] or 0, most), INDEX)
    made.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(at)
    return at


@dataclass
class Queries:
    """A block of queries, flat: ``hashes`` and ``often`` of the distinct terms of item i stand from first[i] to first[i + 1]."""

    items: list[int | None]
    first: np.ndarray
    hashes: np.ndarray
    often: np.ndarray


def _hashes(terms: list[str]) -> np.ndarray:
    raw = [t.encode() for t in terms]
    lens = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    return tx.hash_spans(data, np.cumsum(lens) - lens, lens)


def _blocks(queries: DataFrame) -> Iterator[Queries]:
    """The rows of ``queries`` in blocks that the driver and every task can hold."""
    items, per, terms = [], [0], Counter()
    terms_of: list[str] = []
    often: list[int] = []

    def block() -> Queries:
        return Queries(list(items), np.cumsum(per), _hashes(terms_of), np.array(often, np.int64))

    for row in queries.toLocalIterator():
        terms = Counter(TERM.findall((row["text"] or "").translate(_LOWER)))
        if items and (len(items) >= BLOCK_ITEMS or len(often) + len(terms) > BLOCK_PAIRS):
            yield block()
            items, per, terms_of, often = [], [0], [], []
        items.append(row["item_id"])
        per.append(len(terms))
        terms_of += terms.keys()
        often += terms.values()
    if items:
        yield block()


def _frequencies(wanted: np.ndarray):
    """Documents of each term in the shards of a partition, as (slot in ``wanted``, df)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                t, s = np.frombuffer(terms.as_buffer(), "<u8"), np.frombuffer(starts.as_buffer(), "<i8")
                at = np.searchsorted(t, wanted)
                hit = at < len(t)
                hit[hit] = t[at[hit]] == wanted[hit]
                df[hit] += s[at[hit] + 1] - s[at[hit]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["slot", "df"])

    return run


class Shard:
    """A loaded shard: ``ones[level, i]`` 1-bits before i, ``impacts[level, i]`` in the order of that level."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        self.docs, self.terms, self.starts = read("docs", "<i8"), read("terms", "<u8"), read("starts", "<i8")
        impact = read("impacts", "<i4")
        n, self.levels = len(impact), (max(1, len(self.docs)) - 1).bit_length()
        bits = read("bits", np.uint8).reshape(self.levels, (n + 7) // 8)
        self.ones = np.zeros((self.levels, n + 1), np.int32)
        self.impacts = np.empty((self.levels + 1, n), np.int32)
        self.impacts[0] = impact
        for k in range(self.levels):
            bit = np.unpackbits(bits[k], count=n).astype(bool)
            np.cumsum(bit, out=self.ones[k, 1:])
            zeros = n - int(self.ones[k, -1])
            np.compress(~bit, self.impacts[k], out=self.impacts[k + 1, :zeros])
            np.compress(bit, self.impacts[k], out=self.impacts[k + 1, zeros:])
        self.zeros = (n - self.ones[:, -1]).astype(np.int64)

    def lists(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each term begins and ends; empty if the shard has none."""
        at = np.minimum(np.searchsorted(self.terms, hashes), max(0, len(self.terms) - 1))
        known = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        at = np.where(known, at, 0)
        return np.where(known, self.starts[at], 0), np.where(known, self.starts[np.minimum(at + 1, len(self.starts) - 1)], 0)


class Best:
    """The k best documents of each query so far, by score and then doc_id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least, self.last = np.zeros(queries, np.int64), np.full(queries, _LAST)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        ok = score > 0
        q, s, d = (np.concatenate(x) for x in ((self.query, query[ok]), (self.score, score[ok]), (self.doc, doc[ok])))
        by = np.lexsort((d, -s, q))
        q, s, d = q[by], s[by], d[by]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = nth < self.k
        self.query, self.score, self.doc = q[kept], s[kept], d[kept]
        full = nth == self.k - 1
        self.least[q[full]], self.last[q[full]] = s[full], d[full]

    def wants(self, query: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a score of ``bound`` at ``doc`` or behind it could still be among the best."""
        least = self.least[query]
        return (bound > least) | ((bound == least) & (bound > 0) & (doc < self.last[query]))


def best_first(shard: Shard, best: Best, query: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Bring the shard's documents into ``best``; a..b is the root interval of (query, weight), sorted by query.

    The frontier is an arena: a node keeps the place of its intervals there, and what is opened or can't
    matter any more is left behind.
    """
    there = (b > a) & (weight > 0)
    query, weight, a, b = query[there], weight[there], a[there], b[there]
    if not len(query):
        return
    roots, start = np.unique(query, return_index=True)
    n_query, n_level, n_place = roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), np.int64)
    n_bound, n_start, n_size = np.add.reduceat(weight * shard.impacts[0, a], start), start, np.diff(np.append(start, len(query)))
    width = WIDTH
    if not shard.levels:  # one document
        best.add(n_query, n_bound, shard.docs[n_place])
        return
    while len(n_query):
        live = best.wants(n_query, n_bound, shard.docs[n_place])
        n_query, n_level, n_place, n_bound, n_start, n_size = (x[live] for x in (n_query, n_level, n_place, n_bound, n_start, n_size))
        if not len(n_query):
            return
        by = np.lexsort((n_place, -n_bound, n_query))
        sorted_query = n_query[by]
        nth = np.arange(len(by)) - np.searchsorted(sorted_query, sorted_query)
        opened, kept = by[nth < width], by[nth >= width]
        width = min(WIDEST, 2 * width)
        # the intervals of the opened nodes, in both children
        size = n_size[opened]
        node = np.repeat(np.arange(len(opened)), size)
        at = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + n_start[opened][node]
        level, w = n_level[opened][node], weight[at]
        r_a, r_b, zeros = shard.ones[level, a[at]], shard.ones[level, b[at]], shard.zeros[level]
        c_a, c_b = np.concatenate((a[at] - r_a, zeros + r_a)), np.concatenate((b[at] - r_b, zeros + r_b))
        child = np.concatenate((node, node + len(opened)))
        some = np.flatnonzero(c_b > c_a)
        child, c_a, c_b, c_w, c_level = child[some], c_a[some], c_b[some], np.concatenate((w, w))[some], np.concatenate((level, level))[some] + 1
        start = np.flatnonzero(np.concatenate(([True], child[1:] != child[:-1])))
        bound = np.add.reduceat(c_w * shard.impacts[c_level, c_a], start)
        which = child[start]
        right, parent = which >= len(opened), opened[which % len(opened)]
        q, lv = n_query[parent], n_level[parent] + 1
        first = n_place[parent] + np.where(right, np.int64(1) << (shard.levels - lv), 0)
        count = np.diff(np.append(start, len(child)))
        leaf = lv == shard.levels
        best.add(q[leaf], bound[leaf], shard.docs[first[leaf]])
        inner = ~leaf & best.wants(q, bound, shard.docs[first])
        base = len(a)
        a, b, weight = np.concatenate((a, c_a)), np.concatenate((b, c_b)), np.concatenate((weight, c_w))
        n_query, n_level, n_place, n_bound, n_start, n_size = (np.concatenate((old[kept], new[inner])) for old, new in ((n_query, q), (n_level, lv), (n_place, first), (n_bound, bound), (n_start, base + start), (n_size, count)))


def _search(first: np.ndarray, hashes: np.ndarray, weights: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(first) - 1, k)
        query = np.repeat(np.arange(len(first) - 1), np.diff(first))
        cuts, begin = [], 0
        for i in range(1, len(first)):  # queries that are searched side by side
            if i == len(first) - 1 or first[i + 1] - first[begin] > SIDE_BY_SIDE:
                cuts.append((int(first[begin]), int(first[i])))
                begin = i
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[row] for c in ("docs", "terms", "starts", "impacts", "bits")})
                a, b = shard.lists(hashes)
                for x, y in cuts:
                    best_first(shard, best, query[x:y], weights[x:y], a[x:y], b[x:y])
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.doc, mask=best.doc == _LAST), pa.array(best.score)], names=["query", "doc_id", "score"])

    return run


def search(spark: SparkSession, index: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each row of ``queries`` (item_id, text).

    Scores above 0 only; equal scores by doc_id, a null one last. Fewer than ``k`` such documents: all.
    A null or empty text has no results; rows that repeat an item_id are answered each on its own; other
    columns are left out. Queries are taken in blocks of BLOCK_ITEMS items and BLOCK_PAIRS terms (a
    longer text is a block alone), each against all shards: one job for the frequencies of its terms,
    one for the search. A task carries the k-th scores from shard to shard and gives k rows a query.
    """
    shards = spark.read.schema(INDEX).parquet(index)
    meta = shards.select("all_docs").head()
    all_docs, found = meta["all_docs"] if meta else 0, []
    for block in _blocks(queries.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        wanted = np.unique(block.hashes)
        df = np.zeros(len(wanted), np.int64)
        for r in shards.select("terms", "starts").mapInArrow(_frequencies(wanted), "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect():
            df[r["slot"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        weights = weight[np.searchsorted(wanted, block.hashes)] * block.often
        hits = shards.drop("all_docs", "all_terms").mapInArrow(_search(block.first, block.hashes, weights, k), "query long, doc_id long, score long")
        nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = F.broadcast(spark.createDataFrame(list(enumerate(block.items)), "query long, item_id long"))  # BLOCK_ITEMS rows at most
        found.append(hits.withColumn("rank", nth).where(F.col("rank") <= k).join(names, "query").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if len(found) == 1:
        return found[0]
    kept = [stored(f, "search-block") for f in found]
    out = kept[0]
    for f in kept[1:]:
        out = out.unionByName(f)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_search": query}
ORACLE = {
    "op12_search": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
i as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item_id, term, count(*)::bigint as often from i group by all),
n as (select count(*) as n, sum(len(t))::bigint as l from d where len(t) > 0),
p as (select doc_id, len(t)::bigint as size, unnest(t) as term from d),
tf as (select doc_id, size, term, count(*)::bigint as tf from p group by all),
df as (select term, count(*)::bigint as df from tf group by term),
w as (select term, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)))::bigint as w from df, n),
s as (select item_id, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n.n) // n.l))))::bigint as score
  from q join tf using (term) join w using (term), n group by all),
r as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank, doc_id, score from s where score > 0)
select * from r where rank <= 10
"""
}
