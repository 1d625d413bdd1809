"""N-gram Jaccard self-join by size: subsets of small sets, inverted lists of large ones.

A document's set holds its distinct shingles. Two sets of sizes a <= b link when their Jaccard
similarity is ``threshold`` or more, that is when they share c(a, b) = ceil(t (a + b) / (1 + t))
shingles. Documents with the same set are one node.

* Light sets (fewer shingles than the boundary) write each subset of c(a, b) shingles, for every
  pair of sizes that can link, as a key: equal keys are links, nothing is left to verify.
* Heavy sets, and light ones that can link with them, stand in the inverted lists of the first
  a - ceil(t a) + 1 of their shingles, in one order for all sets in which very frequent shingles
  come last; two sets that link meet in a list. Members of a list are compared in two rounds: each
  with the list's first member and with its neighbour in size; then, after linked sets have been
  joined into components, every pair of different components that sizes and places in the lists
  allow. So thousands of near copies cost a few comparisons each, and no link between components is lost.

The boundary is the size at which the keys that light sets write cost least together with the lists
and comparisons of the others, from a histogram of sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import _text as tx
from tagloom.llm._graph import components
from tagloom.llm._work import remove, stored, table

U64 = np.uint64
#: So many of the most frequent shingles come last in the lists' order (16 bytes each on every machine).
#: The order decides only how many pairs are compared, never which link.
HOT = 250_000
#: Light sets are below this size at most.
LARGEST_LIGHT = 24
#: Cost of comparing a heavy set, in keys for each of its shingles.
COMPARE = 0.25
#: Turns in which members of a list are compared with a central one before all that is left is compared, and candidates for that one.
TURNS, PIVOTS = 2, 4
LIST = "key long, fp long, n int, pos int"


def share(a: int, b: int, t: Fraction) -> int:
    """Shingles that sets of these sizes must share."""
    return ceil(t * (a + b) / (1 + t))


def prefix(n: int, t: Fraction) -> int:
    return n - ceil(t * n) + 1


def size_pairs(n: int, below: int, t: Fraction) -> list[tuple[int, int]]:
    """Pairs of light sizes (a <= b) that can link and of which n is one."""
    return [(a, n) for a in range(max(1, ceil(t * n)), n)] + [(n, b) for b in range(n, min(below - 1, floor(n / t)) + 1)]


def boundary(sizes: dict[int, int], t: Fraction) -> int:
    """The size from which sets are heavy, at least cost; ``sizes``: number of sets of each size."""

    def cost(x: int) -> float:
        light = sum(k * sum(comb(n, share(a, b, t)) for a, b in size_pairs(n, x, t)) for n, k in sizes.items() if 0 < n < x)
        return light + sum(k * (prefix(n, t) + COMPARE * n) for n, k in sizes.items() if n >= ceil(t * x))

    return min(range(2, LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def sketch(s: np.ndarray) -> bytes:
    """How many shingles fall into each of 64 parts of the hash range, 255 standing for more."""
    return np.minimum(np.bincount((s >> U64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def fingerprint(s: np.ndarray) -> int:
    """Hash of a set of shingles."""
    return int(tx.mix(tx.mix(s + U64(0x2545F4914F6CDD1D)).sum(keepdims=True) + U64(len(s) * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)[0])


def _scan(size: int):
    """Rows of kind 0: (doc_id, n, fingerprint, sketch); of kind 1: shingles met in several documents of the task, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        loose: list[np.ndarray] = []
        held = 0

        def settle(least: int) -> None:
            nonlocal keys, counts, loose, held
            every = np.concatenate((keys, *loose))
            weight = np.concatenate((counts, np.ones(len(every) - len(keys), np.int64)))
            keys, back = np.unique(every, return_inverse=True)
            counts = np.bincount(back, weights=weight, minlength=len(keys)).astype(np.int64)
            if len(keys) > 2_000_000:  # shingles met once so far can't become frequent unless they are met again
                keys, counts = keys[counts > 1], counts[counts > 1]
            keys, counts = keys[counts >= least], counts[counts >= least]
            if least > 1 and len(keys) > HOT:
                top = np.sort(np.argpartition(-counts, HOT)[:HOT])
                keys, counts = keys[top], counts[top]
            loose, held = [], 0

        for batch in tx.slices(batches, "text"):
            sets = tx.shingle_sets(*tx.column(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], names=["kind", "doc_id", "n", "fp", "sketch"])
            loose += sets
            held += sum(map(len, sets))
            if held > 3_000_000:
                settle(1)
        settle(2)
        for a in range(0, len(keys), 50_000):
            k, c = keys[a : a + 50_000], counts[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int32)), pa.nulls(len(k), pa.int64()), pa.array(c), pa.array(k.view(np.int64)), pa.nulls(len(k), pa.binary())], names=["kind", "doc_id", "n", "fp", "sketch"])

    return run


def _lists(size: int, t: Fraction, below: int, hot: np.ndarray, rank: np.ndarray):
    """Keys of light sets (pos -1) and entries of inverted lists, once for each set of a task; ``hot``: sorted hashes, ``rank``: their places."""
    firsts = {}

    def light(s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        n = len(s)
        for a, b in size_pairs(n, below, t):
            subsets = np.array(list(combinations(range(n), share(a, b, t))), np.int64)
            yield a, tx.mix((s[subsets] * tx.PLACES[0]).sum(1) + tx.mix(s[subsets]).sum(1) + U64((a * 1_000_003 + b) * 0x9E3779B97F4A7C15 % 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        heavy_from = ceil(t * below)
        for batch in tx.slices(batches, "text"):
            key, fp, n, pos = [], [], [], []
            for s in tx.shingle_sets(*tx.column(batch.column("text")), size):
                m = len(s)
                if not m or (f := fingerprint(s)) in seen:
                    continue
                seen.add(f)
                if m >= heavy_from:
                    if (k := firsts.get(m)) is None:
                        k = firsts[m] = prefix(m, t)
                    order = s
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                        warm = hot[at] == s
                        if warm.any():
                            order = np.concatenate((s[~warm], s[warm][np.argsort(rank[at[warm]], kind="stable")]))
                    key.append(order[:k]), fp.append(np.full(k, f)), n.append(np.full(k, m, np.int32)), pos.append(np.arange(k, dtype=np.int32))
                if m < below:
                    for a, h in light(s):
                        key.append(h), fp.append(np.full(len(h), f)), n.append(np.full(len(h), m, np.int32)), pos.append(np.full(len(h), -a, np.int32))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(fp)), pa.array(np.concatenate(n)), pa.array(np.concatenate(pos))], names=["key", "fp", "n", "pos"])

    return run


def _runs(t: Fraction):
    """From rows sorted by (key, pos < 0, n, fp): kind 0 entries of lists that hold a set of nearly their size, 1 pairs to compare, 2 links.

    Equal keys of light sets for sizes (a, b): whoever is there shares c(a, b) shingles with a set
    of size a, so all link with the first, if it is of size a. Of a list that goes on from batch to
    batch only the first and the last row are held.
    """
    top, bottom = t.numerator, t.denominator
    names = ["kind", "key", "a", "b", "n", "pos"]

    def out(kind: int, key=None, a=None, b=None, n=None, pos=None) -> pa.RecordBatch:
        zero = np.zeros(len(a), np.int64)
        long = [pa.array(np.ascontiguousarray(zero if x is None else x)) for x in (key, a, b)]
        ints = [pa.array((zero if x is None else x).astype(np.int32)) for x in (n, pos)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *long, *ints], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # first and last row of the list that goes on, one row if they are the same
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, n, pos = (np.concatenate((np.array([h[k] for h in held], np.int64), batch.column(c).to_numpy().astype(np.int64))) for k, c in enumerate(("key", "fp", "n", "pos")))
            carried = len(held)
            same = (key[1:] == key[:-1]) & ((pos[1:] < 0) == (pos[:-1] < 0))
            keep = np.concatenate(([True], ~(same & (fp[1:] == fp[:-1]))))
            keep[:carried] = True
            key, fp, n, pos = key[keep], fp[keep], n[keep], pos[keep]
            light = pos < 0
            same = np.concatenate(([False], (key[1:] == key[:-1]) & (light[1:] == light[:-1])))
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
            new = same.copy()
            new[:carried] = False
            i = np.flatnonzero(new & light)
            i = i[n[first[i]] == -pos[first[i]]]
            if len(i):
                yield out(2, a=fp[first[i]], b=fp[i])
            i = np.flatnonzero(new & ~light)
            x, y = np.concatenate((first[i], i - 1)), np.concatenate((i, i))
            most = np.minimum(n[x] - pos[x], n[y] - pos[y])
            fits = (top * n[y] <= bottom * n[x]) & (most * (top + bottom) >= top * (n[x] + n[y]))
            if fits.any():
                x, y = fp[x[fits]], fp[y[fits]]
                ab = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
                yield out(1, a=ab[:, 0], b=ab[:, 1])
            # an entry counts if its neighbour in size is near enough for a link; a held one may have been written
            near = new & ~light & (top * n <= bottom * np.concatenate((n[:1], n[:-1])))
            wanted = near.copy()
            wanted[:-1] |= near[1:]
            if carried == 2:  # the first one's neighbour isn't the second one here
                wanted[0] = False
            for r in range(carried):
                wanted[r] &= not held[r][4]
            w = np.flatnonzero(wanted)
            if len(w):
                yield out(0, key[w], fp[w], None, n[w], pos[w])
            ends = dict.fromkeys((int(first[-1]), len(key) - 1))
            held = [(int(key[r]), int(fp[r]), int(n[r]), int(pos[r]), bool(wanted[r]) or (r < carried and held[r][4])) for r in ends]

    return run


def _cross(t: Fraction, turn: int | None = None):
    """Pairs of one list that are in different components and may link, from rows sorted by (key, n, fp) with their root.

    With a ``turn`` only few of them: each member with one of the list's most central ones. A
    document that others were copied from has no rare shingles of its own, so the list's shingle
    comes early among its shingles, while each copy's own ones come before it.
    """
    top, bottom = t.numerator, t.denominator

    def pivots(fp: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
        chosen = np.lexsort((fp, pos / n))[turn * PIVOTS : (turn + 1) * PIVOTS]
        for a in range(0, len(fp) if len(chosen) else 0, 65536):
            i, j = np.arange(a, min(a + 65536, len(fp)))[:, None], chosen[None, :]
            fits = (root[i] != root[j]) & (top * n[i] <= bottom * n[j]) & (top * n[j] <= bottom * n[i])
            fits &= np.minimum(n[i] - pos[i], n[j] - pos[j]) * (top + bottom) >= top * (n[i] + n[j])
            w = np.flatnonzero(fits.any(1))
            x, y = fp[i[w, 0]], fp[chosen[fits[w].argmax(1)]]
            if len(w):
                yield np.stack((np.minimum(x, y), np.maximum(x, y)), 1)

    def pairs_of(fp: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, parts: np.ndarray) -> Iterator[np.ndarray]:
        names, back, counts = np.unique(root, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        main = back == counts.argmax()
        n64, pos64 = n.astype(np.int64), pos.astype(np.int64)
        if turn is not None:
            yield from pivots(fp, n64, pos64, root)
            return
        for i in np.flatnonzero(~main):
            lo, hi = np.searchsorted(n64 * bottom, n64[i] * top), np.searchsorted(n64 * top, n64[i] * bottom, "right")
            j = np.arange(lo, hi)
            j = j[(root[j] != root[i]) & (main[j] | (j > i))]
            # in the list of their first common shingle all that they share comes from there on
            most = np.minimum(n64[i] - pos64[i], n64[j] - pos64[j])
            j = j[most * (top + bottom) >= top * (n64[i] + n64[j])]
            # they share at most the smaller count of each part of the hash range
            most = np.minimum(parts[i], parts[j]).sum(1, dtype=np.int64)
            j = j[(most * (top + bottom) >= top * (n64[i] + n64[j])) | (parts[i].max() == 255)]
            if len(j):
                yield np.stack((np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None
        found: list[np.ndarray] = []
        size = 0

        def settle() -> pa.RecordBatch:
            nonlocal found, size
            ab = np.unique(np.concatenate(found), axis=0)
            found, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ab[:, 0])), pa.array(np.ascontiguousarray(ab[:, 1]))], names=["a", "b"])

        def every() -> Iterator[list[np.ndarray]]:
            nonlocal left
            for batch in batches:
                if batch.num_rows:
                    cols = [batch.column(c).to_numpy() for c in ("key", "fp", "n", "pos", "root")]
                    cols.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, 64) if turn is None else np.zeros((batch.num_rows, 0), np.uint8))
                    if left is not None:
                        cols = [np.concatenate(x) for x in zip(left, cols, strict=True)]
                    others = np.flatnonzero(cols[0] != cols[0][-1])
                    cut = int(others[-1]) + 1 if len(others) else 0
                    left = [c[cut:] for c in cols]
                    if cut:
                        yield [c[:cut] for c in cols]
            if left is not None:
                yield left

        for key, fp, n, pos, root, parts in every():
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            # lists whose members differ in their component
            differs = np.add.reduceat(np.concatenate(([0], (root[1:] != root[:-1]) & (key[1:] == key[:-1]))), edges[:-1]) > 0 if len(key) else []
            for r in np.flatnonzero(differs):
                a, b = edges[r], edges[r + 1]
                for ab in pairs_of(fp[a:b], n[a:b], pos[a:b], root[a:b], parts[a:b]):
                    found.append(ab)
                    size += len(ab)
                    if size > 1_000_000:
                        yield settle()
        if found:
            yield settle()

    return run


def _likely(t: Fraction):
    """The pairs (a, b) whose sketches and sizes allow a link: sets share at most the smaller count of each part of the hash range."""
    top, bottom = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 64) for c in ("sketch_a", "sketch_b"))
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            fine = (most * (top + bottom) >= top * sizes) | (x == 255).any(1) | (y == 255).any(1)
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    return run


def _verify(size: int, t: Fraction):
    top, bottom = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in tx.slices(batches, "text_b", 2 << 20):
            sets = tx.shingle_sets(*tx.column(batch.column("text_b")), size)
            a, texts, linked = batch.column("a").to_numpy(), batch.column("text_a"), np.zeros(batch.num_rows, bool)
            for i, y in enumerate(sets):
                if last is None or a[i] != last:
                    last, x = a[i], tx.shingle_sets(*tx.column(texts.slice(i, 1)), size)[0]
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if top * len(large) > bottom * len(small):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                linked[i] = bottom * both >= top * (len(x) + len(y) - both)
            w = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([pa.array(a[w]), pa.array(batch.column("b").to_numpy()[w])], names=["u", "v"])

    return run


def _texts(size: int):
    """Texts whose set has the wanted fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text"):
            fp, sets = batch.column("fp").to_numpy(), tx.shingle_sets(*tx.column(batch.column("text")), size)
            same = pa.array(np.array([fingerprint(s) for s in sets], np.int64) == fp)
            yield pa.RecordBatch.from_arrays([batch.column("fp").filter(same), batch.column("text").filter(same)], names=["fp", "text"])

    return run


def ngram_join(docs: DataFrame, size: int = 5, threshold: Fraction | str = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row of ``docs`` (doc_id, text).

    Words are those of A-Z lower-cased text between white space; a text of fewer words than ``size``
    is one shingle. Null, empty or blank text: no shingles, linked with nothing, a component of its
    own. A row without doc_id is linked with nothing and has no component. Rows that repeat a doc_id
    are one document (links of either text count). Other columns are left out; an empty table gives
    none. Sets are compared by 64-bit hashes of their shingles.
    """
    t, spark = Fraction(threshold), docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stored(docs.mapInArrow(_scan(size), "kind int, doc_id long, n long, fp long, sketch binary"), "ngram-scan", "kind")
    found = scanned.where("kind = 0").select("doc_id", "n", "fp", "sketch")
    classes = stored(found.where("n > 0 and doc_id is not null").groupBy("fp", "n").agg(F.min("doc_id").alias("doc_id"), F.max("sketch").alias("sketch")), "ngram-classes")
    sizes = {r["n"]: r["k"] for r in classes.where(F.col("n") <= 2 * LARGEST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}  # a row for each small size
    below = boundary(sizes, t)
    counts = scanned.where("kind = 1").groupBy("fp").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "fp").limit(HOT).toPandas()  # HOT rows at most
    counts = counts.sort_values("fp", key=lambda c: c.to_numpy().view(U64))
    hot, rank = counts["fp"].to_numpy(np.int64).view(U64), counts["n"].to_numpy(np.int64)

    known = docs.where("doc_id is not null").select("text")
    lists = known.mapInArrow(_lists(size, t, below, hot, rank), LIST)
    runs = lists.repartition("key").sortWithinPartitions("key", F.col("pos") < 0, "n", "fp").mapInArrow(_runs(t), "kind int, key long, a long, b long, n int, pos int")
    runs = stored(runs, "ngram-runs", "kind")

    first = stored(runs.where("kind = 1").select("a", "b").distinct(), "ngram-pairs")
    wanted = runs.where("kind = 0").select(F.col("a").alias("fp")).distinct()
    at = classes.join(wanted, "fp", "left_semi").select("fp", "doc_id")
    # these tables grow with the input, so no join broadcasts them at a size where it could. Equal rows go where the join
    # has brought them together; rows of one doc_id and set with different texts may both stay and link alike
    wanted_texts = docs.join(at.hint("merge"), "doc_id").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "fp", "text_hash"])
    texts = stored(wanted_texts.select("fp", "text").mapInArrow(_texts(size), "fp long, text string"), "ngram-texts")

    sketches = classes.select("fp", "n", "sketch")

    def compared(pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs; texts are fetched only for those that sizes and sketches leave."""
        for c in "ab":
            pairs = pairs.join(sketches.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge"), c)
        likely = stored(pairs.mapInArrow(_likely(t), "a long, b long"), "ngram-likely")
        if likely.isEmpty():
            return likely.select(F.col("a").alias("u"), F.col("b").alias("v"))
        b = likely.hint("merge").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
        first_texts = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")).join(likely.select("a").distinct(), "a", "left_semi")
        linked = b.join(first_texts, "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(_verify(size, t), "u long, v long")
        linked = stored(linked, "ngram-linked")
        remove(spark, likely)
        return linked

    links = runs.where("kind = 2").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(compared(first))
    roots = stored(components(links), "ngram-roots")
    entries = runs.where("kind = 0").select("key", F.col("a").alias("fp"), "n", "pos")
    tested, turn = first, 0
    while True:
        last = turn == TURNS
        rooted = entries.join(roots.hint("merge"), entries["fp"] == roots["node"], "left").select("key", "fp", "n", "pos", F.coalesce("root", "fp").alias("root"))
        if last:  # only members of lists that are in several components are compared by their sketches
            several = rooted.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one < other").select("key")
            rooted = rooted.join(several.hint("merge"), "key", "left_semi").join(sketches.select("fp", "sketch").hint("merge"), "fp")
        crossing = rooted.repartition("key").sortWithinPartitions("key", "n", "fp").mapInArrow(_cross(t, None if last else turn), "a long, b long")
        crossing = stored(crossing.distinct().join(tested, ["a", "b"], "left_anti"), "ngram-crossing")
        if not crossing.isEmpty() and not (more := compared(crossing)).isEmpty():
            roots = stored(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "ngram-roots")
        elif not last:
            turn = TURNS - 1  # another member would hardly do better
        if last:
            break
        tested = tested.unionByName(crossing)
        turn += 1

    remove(spark, runs, texts)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "n", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    by_fp = rooted.join(least, "root").select("fp", "least")
    # a doc_id that stands in several rows belongs to the smallest of their components
    out = found.join(by_fp, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns.

    Of rows that repeat a doc_id one stays; rows without a doc_id all stay.
    """
    joined = stored(ngram_join(docs, **how), "ngram-joined")
    gone = joined.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    if joined.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": query}
ORACLE: dict[str, str] = {}
