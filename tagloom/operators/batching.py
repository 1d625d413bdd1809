"""Batches of one bucket: samplers, rolling blocks, micro-batch groups and the cursor that is safe to resume from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions.rand import uniform
from tagloom.operators.ingest import global_ordinals
from tagloom.operators.scans import CHUNK, numbered, scan
from tagloom.sources import shared


#: Parts of a bucket that are ranked apart.
PARTS = 64


def bucket_batches(samples: DataFrame, batch: int, seed: int, epoch: int = 0, drop_last: bool = True) -> DataFrame:
    """bucket, batch_no, batch_order and sample_ids: each bucket shuffled by hash and cut, the batches shuffled again.

    A bucket is ranked in parts of the hash's range, so a few buckets keep many tasks busy. A batch's
    order is its uniform, so no global sort is needed to deal batches out.
    """
    hashed = samples.withColumn("__u", uniform("batch", seed + epoch, F.col("id")))
    cut = numbered(hashed, ["bucket"], F.floor(F.col("__u") * PARTS), ["__u", "id"], "place").withColumn("batch_no", F.floor(F.col("place") / batch))
    whole = cut.groupBy("bucket", "batch_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("sample_ids"))
    whole = whole.where(F.size("sample_ids") == batch) if drop_last else whole
    return whole.withColumn("batch_order", uniform("order", seed + epoch, F.col("bucket"), F.col("batch_no")))


def encode_batches(samples: DataFrame, size: int, order: str = "id", part: int = 1024) -> DataFrame:
    """Samples with encode_batch: runs of ``size`` in each bucket by a whole number ``order``, the last of a bucket as long as it is."""
    return numbered(samples, ["bucket"], F.floor(F.col(order) / part), [order], "__place").withColumn("encode_batch", F.floor(F.col("__place") / size)).drop("__place")


def batch_counts(samples: DataFrame, batch: int, drop_last: bool = True) -> DataFrame:
    per = samples.groupBy("bucket").agg(F.count(F.lit(1)).alias("samples"))
    return per.withColumn("batches", F.floor(F.col("samples") / batch) if drop_last else F.ceil(F.col("samples") / batch))


def rolling_blocks(samples: DataFrame, block: int) -> DataFrame:
    """Samples with block: runs of ``block`` samples by (shard, place); the last one may be short."""
    numbered = global_ordinals(samples, "shard_index", ["sample_index"], "position")
    return numbered.withColumn("block", F.floor(F.col("position") / block))


def taken(counts: DataFrame, names: list[str], batch: int, accumulate: int, few: bool = False) -> DataFrame:
    """block, bucket, held (samples of earlier blocks), from, upto (its groups that go after the block) and first (number of the first one).

    ``counts``: block, bucket, n. Up to block k all buckets together have G whole groups, and a multiple
    of ``accumulate`` has gone, so R = G mod accumulate wait. They are the last ones in the order of
    bucket names: of the buckets from b on, s(k) = min(R(k), s(k-1) + new groups) wait. With N(k) groups so
    far in these buckets, s(k) = N(k) + min(0, min over j <= k of R(j) - N(j)). So running sums and minima say
    what every block gives, and nothing is folded one by one. ``few``: there are at most scans.CHUNK blocks.
    """
    per = counts.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    grid = per.select("block", "m", F.posexplode(F.array(*map(F.lit, names))).alias("i", "bucket")).select("block", "i", "bucket", F.coalesce(F.try_element_at("m", F.col("bucket")), F.lit(0)).alias("n"))
    of_block, back = W.partitionBy("block"), W.partitionBy("block").orderBy(F.desc("i"))
    rows = scan(grid, ["i"], "block", {"h": ("sum", F.col("n"))}, few=few).withColumn("whole", F.floor(F.col("h") / batch))
    rows = rows.withColumns({"sofar": F.sum("whole").over(back), "rest": F.sum("whole").over(of_block) % accumulate})
    rows = scan(rows, ["i"], "block", {"low": ("min", F.col("rest") - F.col("sofar"))}, few=few).withColumn("s", F.col("sofar") + F.least(F.lit(0), F.col("low")))
    rows = rows.withColumn("upto", F.col("whole") - F.col("s") + F.coalesce(F.lag("s").over(back), F.lit(0)))
    rows = scan(rows, ["i"], "block", {"past": ("max", F.col("upto"))}, before=True, few=few).withColumn("from", F.coalesce("past", F.lit(0)))
    ahead = F.coalesce(F.sum(F.col("upto") - F.col("from")).over(of_block.orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("block", "bucket", (F.col("h") - F.col("n")).alias("held"), "from", "upto", (F.sum("from").over(of_block) + ahead).alias("first"))


def groups(samples: DataFrame, block: int, batch: int, accumulate: int) -> DataFrame:
    """Samples with emitted_block and group_no, null for those that stay behind at the end.

    After each block the buckets, in the order of their names, give whole groups of ``batch`` samples;
    of all groups only a multiple of ``accumulate`` is taken and the rest waits. ``taken`` says how many from
    counts alone; windows inside a block number the samples. The driver sees the names of the buckets,
    of which a stage has a few.
    """
    if block % accumulate:
        raise ValueError("a block holds a whole number of accumulated steps")
    return grouped(rolling_blocks(samples, block), batch, accumulate)


def grouped(blocks: DataFrame, batch: int, accumulate: int) -> DataFrame:
    """As ``groups``, for samples that have their block and position. Counts and plan, a row for each block and bucket, are written once."""
    spark = blocks.sparkSession
    counts = shared.kept(blocks.groupBy("block", "bucket").agg(F.count(F.lit(1)).alias("n")), shared.new_dir(spark, "block-counts"))
    buckets = counts.groupBy("bucket").agg(F.min("block").alias("first"), F.max("block").alias("last")).collect()  # a row a bucket
    names = sorted(r["bucket"] for r in buckets)
    few = max((r["last"] for r in buckets), default=0) - min((r["first"] for r in buckets), default=0) < CHUNK
    if not names:
        return blocks.withColumn("emitted_block", F.lit(None).cast("bigint")).withColumn("group_no", F.lit(None).cast("bigint"))
    plan = shared.kept(taken(counts, names, batch, accumulate, few), shared.new_dir(spark, "block-plan"))
    whole = plan.where("upto > from").select("bucket", F.explode(F.expr("sequence(`from`, upto - 1)")).alias("g"), F.col("block").alias("emitted_block"), "first", "from")
    whole = whole.select("bucket", "g", "emitted_block", (F.col("first") + F.col("g") - F.col("from")).cast("bigint").alias("group_no"))
    rank = F.row_number().over(W.partitionBy("block", "bucket").orderBy("position"))
    placed = blocks.join(plan.select("block", "bucket", "held"), ["block", "bucket"]).withColumn("g", F.floor((F.col("held") + rank - 1) / batch))
    return placed.join(whole, ["bucket", "g"], "left").select(*blocks.columns, "emitted_block", "group_no")


def _place(shard: int, sample: int) -> Column:
    return F.struct(F.lit(shard).cast("bigint").alias("shard_index"), F.lit(sample).cast("bigint").alias("sample_index"))


def safe_cursors(grouped: DataFrame, trained: tuple[int, int] | None = None, few: bool = False) -> DataFrame:
    """group_no, shard_index and sample_index of the cursor that may be stored after each group.

    It lies just before the first sample that has been seen but not trained: in later groups of the
    same block, or left waiting by then; if there is none, at the last trained one. A shard never
    changes on the way back, so the place may be -1. ``trained``: the last (shard, place) of an earlier call.
    ``few``: there are at most scans.CHUNK blocks.
    """
    at = F.struct("shard_index", "sample_index")
    per = grouped.where("group_no is not null").groupBy("group_no", "emitted_block").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    inside = W.partitionBy("emitted_block").orderBy("group_no")
    later = F.min("low").over(inside.rowsBetween(1, W.unboundedFollowing))
    # a row for each block: what was trained before it, and what waits after it
    highs = per.groupBy(F.col("emitted_block").alias("k")).agg(F.max("high").alias("high"))
    blocks = scan(highs, [], "k", {"past": ("max", F.col("high"))}, before=True, few=few).select("k", "past")
    waits = grouped.groupBy("block", F.col("emitted_block").alias("goes")).agg(F.min(at).alias("at"))
    passing = waits.where("goes > block").select(F.explode(F.expr("sequence(block, goes - 1)")).alias("k"), "at")
    ever = blocks.select("k", F.lit(None).cast("struct<shard_index:bigint,sample_index:bigint>").alias("at")).unionByName(waits.where("goes is null").select(F.col("block").alias("k"), F.col("at").cast("struct<shard_index:bigint,sample_index:bigint>").alias("at")))
    ever = scan(ever.groupBy("k").agg(F.min("at").alias("low")), [], "k", {"at": ("min", F.col("low"))}, few=few).select("k", "at")
    still = passing.select("k", F.col("at").cast("struct<shard_index:bigint,sample_index:bigint>").alias("at")).unionByName(ever).groupBy("k").agg(F.min("at").alias("still"))
    out = per.withColumn("later", later).withColumn("here", F.max("high").over(inside)).join(blocks, F.col("emitted_block") == F.col("k")).drop("k").join(still, F.col("emitted_block") == F.col("k"), "left")
    out = out.withColumn("trained", F.greatest("here", F.coalesce("past", "here"), *([_place(*trained)] if trained else [])))
    first = F.when(F.col("later").isNull(), F.col("still")).when(F.col("still").isNull(), F.col("later")).otherwise(F.least("later", "still"))
    cursor = F.when(first.isNotNull(), F.struct(first["shard_index"].alias("shard_index"), (first["sample_index"] - 1).alias("sample_index"))).otherwise(F.struct(F.col("trained.shard_index").alias("shard_index"), F.col("trained.sample_index").alias("sample_index")))
    return out.select("group_no", cursor.alias("c")).select("group_no", "c.shard_index", "c.sample_index")


def buffered_order(samples: DataFrame, buffer: int, seed: int, order: str) -> DataFrame:
    """A shuffle that moves no sample out of its run of ``buffer``: place in the new order."""
    numbered = samples.withColumn("run", F.floor(F.col(order) / buffer))
    return numbered.withColumn("place", (F.col("run") * buffer + F.row_number().over(W.partitionBy("run").orderBy(uniform("buffer", seed, F.col(order)), order)) - 1).cast("bigint"))


def shard_order(shards: DataFrame, seed: int, epoch: int, name: str = "source") -> DataFrame:
    """Shards of an epoch with their place: one order for all workers."""
    hashed = shards.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), F.col(name))))
    return numbered(hashed, [], F.substr("__h", F.lit(1), F.lit(2)), ["__h", name], "place").drop("__h")


def worker_share(shards: DataFrame, worker: int, workers: int) -> DataFrame:
    return shards.where(F.pmod("place", F.lit(workers)) == worker)


#: Batches that one task cuts into text windows.
RUN = 65_536


def _next_starts(before: np.ndarray, window: int) -> np.ndarray:
    """For a window that starts at each batch, the place of the batch that starts the next one; the number of batches if that lies beyond."""
    return np.searchsorted(before, before + window, "left")


def _runs_ends(before: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each batch on, as a start: where the first window beyond the run starts (captions before it), windows begun in the run, and the last one's start.

    Pointers double: after r rounds each has passed 2 ** r windows or stands at the last one of the run.
    """
    n = len(before)
    to, count = _next_starts(before, window), np.ones(n, np.int64)
    last = np.arange(n)
    while True:
        on = np.flatnonzero(to < n)
        if not len(on):
            return before[last] + window, count, before[last]
        at = to[on]
        count[on], last[on], to[on] = count[on] + count[at], last[at], to[at]


def _run_summary(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    rows = rows.sort_values("batch_no", kind="stable")
    before = rows["__before"].to_numpy(np.int64)
    end = int(before[-1] + rows["size"].iloc[-1])
    target, count, last = _runs_ends(before, window)
    entries = int(np.searchsorted(before, before[0] + window, "left")) + 1  # no window from an earlier run ends behind these
    return pd.DataFrame({"run": [rows["__run"].iloc[0]], "until": [end], "keys": [before[:entries]], "targets": [target[:entries]], "counts": [count[:entries]], "lasts": [last[:entries]]})


def _run_windows(rows: pd.DataFrame, window: int, encode: int) -> pd.DataFrame:
    rows = rows.sort_values("batch_no", kind="stable")
    before = rows["__before"].to_numpy(np.int64)
    at, number, opened = int(np.searchsorted(before, rows["__entry"].iloc[0], "left")), int(rows["__windows"].iloc[0]), int(rows["__opened"].iloc[0])
    to, begins = _next_starts(before, window), np.zeros(len(before), bool)
    while at < len(before):
        begins[at] = True
        at = to[at]
    nth = np.cumsum(begins)
    start = np.concatenate(([opened], before[begins]))[nth]
    return rows.assign(text_window=number - 1 + nth, encoder_batch=(before - start) // encode).drop(columns=["__before", "__run", "__entry", "__windows", "__opened"])


def text_windows(batches: DataFrame, window: int, encode: int, run: int = RUN) -> DataFrame:
    """Batches (batch_no, size, ...) with text_window and the first encoder batch of each, for batches of any size.

    A window takes whole batches until it holds ``window`` captions, so it may hold more. Where the next one
    starts is the first batch with ``window`` more captions before it, found by search in running sums.
    Runs of ``run`` batches (by batch_no, which counts them) are solved apart, for every batch at which a
    window of an earlier run can end; the driver walks over one row a run to say where each is
    entered, and the runs then number their windows. Batches may be empty; sizes aren't negative or null.
    """
    if window < 1 or encode < 1:
        raise ValueError("window and encoder batch hold a caption at least")
    sums = scan(batches, [], "batch_no", {"__before": ("sum", F.col("size").cast("bigint"))}, before=True).withColumn("__run", F.floor(F.col("batch_no") / run))
    summary = sums.select("batch_no", "size", "__before", "__run").groupBy("__run").applyInPandas(lambda g: _run_summary(g, window), "run long, until long, keys array<long>, targets array<long>, counts array<long>, lasts array<long>")
    entry, windows, opened, entries = 0, 0, 0, []
    for r in summary.orderBy("run").toLocalIterator():
        entries.append((r["run"], entry, windows, opened))
        k = int(np.searchsorted(r["keys"], entry, "left"))
        if k < len(r["keys"]):
            entry, windows, opened = r["targets"][k], windows + r["counts"][k], r["lasts"][k]
    where = F.broadcast(batches.sparkSession.createDataFrame(entries, "__run long, __entry long, __windows long, __opened long"))  # a row a run
    fields = ", ".join(f"`{n}` {t}" for n, t in batches.dtypes)
    return sums.join(where, "__run").groupBy("__run").applyInPandas(lambda g: _run_windows(g, window, encode), f"{fields}, text_window long, encoder_batch long")


def present_in_all(samples: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, samples and, for each column, whether all samples of the batch have it: only then the batch carries it."""
    return samples.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), *[F.bool_and(F.col(c).isNotNull()).alias(c) for c in columns])


def cache_budget(files: DataFrame, budget: int, order: str, size: str = "nbytes") -> DataFrame:
    """Files with the bytes up to each and whether it still fits the budget."""
    upto = F.sum(size).over(W.partitionBy("shard_index").orderBy(order))
    return files.withColumn("upto", upto).withColumn("fits", F.col("upto") <= budget)
