"""Near-duplicates among embeddings: spherical k-means cells, blocked cosine products inside cells.

Equal directions are one node with a weight. Centroids are fitted on a bounded sample; every node
then lives in the cell of its nearest centroid and also visits each cell whose centroid is nearly as
near (its cosine less by MARGIN at most). A pair is compared where one of the two visits, or lives
in, the other's cell. The cosines of two linked vectors with a centroid differ by little: at cosine
0.9 the difference vector is 0.45 long and spread over all dimensions, so the margin is several
standard deviations. Recall against brute force is measured in the tests and stated in the README.

A comparison of two blocks gives no pairs: it adds up the links of each row and writes, for each row
that has one, an edge to the smallest node it reaches inside the block. So thousands of near copies
write a few rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm._graph import components
from tagloom.llm._work import stored, table

#: Nodes that the centroids are fitted on, at most, and rounds of the fit.
SAMPLE, ROUNDS = 16384, 12
#: Nodes in a block of a cell.
BLOCK = 1024
#: Visitors that one task's block meets in a row.
SEGMENT = 16 * BLOCK
#: A node visits cells whose centroid's cosine is less than its own centroid's by this at most.
MARGIN = 0.2


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dims and the unit vector as little-endian doubles; null for what links with nothing."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("embedding")
        out = []
        for v in lists:
            x = v.as_py()
            if x and None not in x:
                # scaled by the largest component first, so that no square over- or underflows
                x = np.array(x, np.float64)
                with np.errstate(all="ignore"):
                    top = np.abs(x).max()
                    x = x / top if np.isfinite(top) and top > 0 else None
                out.append(None if x is None else (x / np.sqrt((x * x).sum()) + 0.0).astype("<f8").tobytes())
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([len(x) // 8 if x else 0 for x in out], pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dims", "unit"])


def fit(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means, begun with rows spread over the sample."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, sample)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def _place(centroids: dict[int, np.ndarray], margin: float):
    """A row for each cell in which a node lives or that it visits; ``cells`` lists them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for n in np.unique(dims):
                whole = batch.filter(pa.array(dims == n))
                for s in range(0, whole.num_rows, BLOCK):
                    part = whole.slice(s, BLOCK)
                    near = _matrix(part.column("unit")) @ centroids[int(n)].T
                    home = near.argmax(1)
                    row, cell = np.nonzero(near >= near.max(1, keepdims=True) - margin)
                    cells = np.split(cell, np.flatnonzero(np.diff(row)) + 1)
                    at = pa.array(row)
                    listed = pa.array(cells, pa.list_(pa.int32())).take(at)
                    yield pa.RecordBatch.from_arrays([*(part.column(x).take(at) for x in ("node", "weight", "dims", "unit")), pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), listed], names=["node", "weight", "dims", "unit", "cell", "home", "cells"])

    return run


class _Rows:
    """Rows of one side of a comparison."""

    def __init__(self, parts: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(parts).combine_chunks()
        self.node, self.weight, self.home = (whole.column(c).to_numpy() for c in ("node", "weight", "home"))
        self.unit = _matrix(whole.column("unit"))
        self.cells = whole.column("cells").to_pylist()

    def visits(self, i: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.array([c in self.cells[r] for r, c in zip(i, cell, strict=True)], bool)


def _block(left: _Rows, right: _Rows, cell: int, threshold: float) -> pa.RecordBatch | None:
    """Links between rows shown in ``cell`` and rows that live there: what each node gains, and an edge for each."""
    sim = left.unit @ right.unit.T
    links = sim >= threshold
    i, j = np.nonzero(np.abs(sim - threshold) < 1e-9)
    if len(i):  # near the threshold the value must not depend on how the product was blocked
        links[i, j] = (left.unit[i] * right.unit[j]).sum(1) >= threshold
    links &= left.node[:, None] != right.node[None, :]
    guest = left.home != cell
    rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if not len(rows):
        return None
    # a pair of two cells that visits either way is compared in the smaller cell only
    for r in rows[guest[rows] & (left.home[rows] < cell)]:
        j = np.flatnonzero(links[r])
        links[r, j] = ~right.visits(j, np.full(len(j), left.home[r]))
    links = links[np.ix_(rows, cols)]
    a, b = left.node[rows], right.node[cols]
    gain_a = links.astype(np.float64) @ right.weight[cols].astype(np.float64)
    # two residents meet twice, once in either order, so only the left one gains
    gain_b = (links & guest[rows][:, None]).T.astype(np.float64) @ left.weight[rows].astype(np.float64)
    names, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    label, ia, ib = np.arange(len(names)), back[: len(a)], back[len(a) :]
    while True:  # smallest node that each reaches inside the block
        before = label.copy()
        low = np.where(links, label[ib][None, :], len(names)).min(1)
        np.minimum.at(label, ia, low)
        low = np.where(links, label[ia][:, None], len(names)).min(0)
        np.minimum.at(label, ib, low)
        label = label[label]
        if (label == before).all():
            break
    node = np.concatenate((a, b))
    gain = np.rint(np.concatenate((gain_a, gain_b))).astype(np.int64)
    some = (gain > 0) | (names[label[back]] != node)
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(names[label[back]][some]), pa.array(gain[some])], names=["u", "v", "gain"])


def _compare(threshold: float):
    """Rows sorted by (dims, cell, segment, block, side): the block's residents first, then those that meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, residents, right = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dims", "cell", "segment", "block", "side")], 1)
            edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1), [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if tuple(keys[a, :4]) != group:
                    group, residents, right = tuple(keys[a, :4]), [], None
                if keys[a, 4] == 0:
                    residents.append(batch.slice(a, b - a))
                    continue
                if not residents:
                    continue
                right = right or _Rows(residents)
                for s in range(a, b, BLOCK):
                    found = _block(_Rows([batch.slice(s, min(BLOCK, b - s))]), right, int(keys[a, 1]), threshold)
                    if found is not None:
                        yield found

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE, cells: int | None = None, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding).

    Two vectors link when their cosine in double precision is ``threshold`` or more; n_links counts
    other rows, component_id is the smallest vec_id reachable by links, kept marks that row. Vectors
    that are null, empty, zero or hold a null or a non-finite number link with nothing, and vectors
    of different length don't link. Equal directions are one node, so that thousands of copies cost
    one comparison. Rows that repeat a vec_id count as other rows; a row without vec_id takes part,
    but has no component and isn't kept. Other columns are left out; an empty table gives none.

    Cells are split into blocks of residents and segments of those that meet them, so a full cell
    is many tasks. ``sample``: nodes that the centroids are fitted on, at most.
    """
    units = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_unit, "vec_id long, dims int, unit binary").withColumn("node", F.when(F.col("unit").isNotNull(), F.xxhash64("unit"))), "cos-units")
    nodes = stored(units.where("node is not null").groupBy("node", "dims").agg(F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"), F.min("vec_id").alias("least")), "cos-nodes")
    count = nodes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length of vectors
    centroids = {}
    for r in count:
        rows = nodes.where(F.col("dims") == r["dims"]).select("node", "unit").orderBy("node").limit(sample).collect()  # by hash: a bounded, repeatable sample
        x = np.stack([np.frombuffer(v["unit"], "<f8") for v in rows])
        k = cells or int(min(4096, max(1, r["n"] ** 0.5), len(x)))
        centroids[r["dims"]] = fit(x, k)
    if not centroids:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    shown = stored(nodes.select("node", "weight", "dims", "unit").mapInArrow(_place(centroids, margin), "node long, weight long, dims int, unit binary, cell int, home int, cells array<int>"), "cos-shown")
    fill = shown.groupBy("dims", "cell").agg(F.ceil(F.count_if(F.col("home") == F.col("cell")) / BLOCK).alias("blocks"), F.ceil(F.count(F.lit(1)) / SEGMENT).alias("segments"))
    shown = shown.join(F.broadcast(fill), ["dims", "cell"])  # at most 4096 cells for each length of vectors
    place = F.xxhash64("node", F.lit("segment"))
    met = shown.where("blocks > 0").withColumn("segment", F.pmod(place, "segments")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("side", F.lit(1))
    here = shown.where("home = cell").withColumn("block", F.pmod("node", "blocks")).withColumn("segment", F.explode(F.expr("sequence(0, segments - 1)"))).withColumn("side", F.lit(0))
    order = ["dims", "cell", "segment", "block"]
    cols = ["node", "weight", "dims", "cell", "home", "cells", "unit", "segment", "block", "side"]
    sides = met.select(cols).unionByName(here.select(cols)).repartition(*order).sortWithinPartitions(*order, "side")
    links = stored(sides.mapInArrow(_compare(threshold), "u long, v long, gain long"), "cos-links")
    degree = links.groupBy("u").agg(F.sum("gain").alias("others")).withColumnRenamed("u", "node")
    roots = components(links.select("u", "v")).withColumnRenamed("node", "linked")
    per = nodes.join(degree, "node", "left").join(roots, F.col("node") == F.col("linked"), "left").select("node", "least", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    per = stored(per, "cos-per")
    smallest = per.groupBy("root").agg(F.min("least").alias("component_id"))
    figures = per.join(smallest, "root").select("node", "n_links", "component_id")
    out = units.select("vec_id", "node").join(figures, "node", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_cosine": query}
ORACLE: dict[str, str] = {}
