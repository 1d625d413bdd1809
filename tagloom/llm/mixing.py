"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Of all rates between 0 and ``cap`` that give a source its target of words, those nearest to one
copy of everything (least relative entropy) are min(cap, exp(t * size)), one tilt t for each source.
The tilts are the roots of the convex dual's gradient; Newton steps, kept inside a bracket, find
them over the histogram of document sizes, a row for each source and size. Sums are taken in
fixed point, so that no order of addition changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm._work import remove, stored, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Fixed-point units of a word and of a document.
UNIT, DOC = 1024, 1 << 20
#: Documents of one source and size that are ranked together.
RANKED = 4096
STEPS = 60


def targets(sizes: DataFrame, total_share: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """key, source_size, target of each source, from (key, source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``total_share`` of all
    sizes; a target stops at ``cap`` times its source's size and the others share the excess. That
    is one water level over the sources in the order of limit / weight. A row for each source.
    """
    cycle = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    full = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    lower = full.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    spent = F.coalesce(F.sum("limit").over(lower), F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(float(total_share)) - spent) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0)))
    leveled = ranked.withColumn("level", level).withColumn("holds", F.col("limit") / F.col("weight") >= F.col("level"))
    water = F.min(F.when(F.col("holds"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every)["level"]
    return leveled.withColumn("water", water).select("key", "source_size", F.least("limit", F.coalesce("water", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _fixed(words: Column) -> Column:
    return F.round(words * F.lit(float(UNIT))).cast("long")


def tilts(hist: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """key, source_size, target, mean and the tilt t of each source: rate = min(cap, exp(t * size / mean)).

    Each step is one distributed sum over the histogram; the state, a row for each source, is
    written to the shared folder after it.
    """
    spark = hist.sparkSession
    docs = hist.groupBy("key").agg(F.sum("docs").alias("docs"))
    state = goals.join(docs, "key").withColumn("mean", F.col("source_size") / F.col("docs"))
    top = F.log(F.lit(float(cap))) * F.greatest("mean", F.lit(1.0))  # every rate is at the cap
    state = state.select("key", "source_size", "target", "mean", F.lit(0.0).alias("t"), F.lit(-64.0).alias("lo"), top.alias("hi"), F.lit(False).alias("done"))
    state = stored(state, "tilts")
    tilt = F.exp(F.least(F.col("t") * F.col("size") / F.col("mean"), F.lit(50.0)))
    words = F.col("size") * F.col("docs")
    for _ in range(STEPS):
        now = hist.where("size > 0").join(state.where("not done"), "key").groupBy("key").agg(
            F.sum(_fixed(words * F.least(tilt, F.lit(float(cap))))).alias("got"),
            F.sum(_fixed(F.when(tilt < cap, words * tilt * F.col("size") / F.col("mean")).otherwise(0.0))).alias("slope"),
        )
        off = F.col("got") / UNIT - F.col("target")
        lo, hi = F.when(off < 0, F.col("t")).otherwise(F.col("lo")), F.when(off > 0, F.col("t")).otherwise(F.col("hi"))
        step = F.col("t") - off / F.when(F.col("slope") > 0, F.col("slope") / UNIT)
        inside = (step > lo) & (step < hi)
        # a first bound is itself a candidate: all at the cap, or as good as nothing
        moved = F.when(F.abs(F.coalesce(off, F.lit(0.0))) <= 0.5, F.col("t")).when(inside, step).otherwise(F.when((F.col("target") >= F.col("source_size") * cap), F.col("hi")).otherwise((lo + hi) / 2))
        end = F.col("done") | F.coalesce(F.abs(off) <= 0.5, F.lit(True)) | (F.col("hi") - F.col("lo") < 1e-12) | (F.col("target") >= F.col("source_size") * cap)
        after = state.join(now, "key", "left").select("key", "source_size", "target", "mean", F.when(F.col("done"), F.col("t")).otherwise(moved).alias("t"), F.when(F.col("done") | off.isNull(), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("done") | off.isNull(), F.col("hi")).otherwise(hi).alias("hi"), end.alias("done"))
        before, state = state, stored(after, "tilts")
        remove(spark, before)
        if state.where("not done").isEmpty():
            break
    return state.select("key", "source_size", "target", "mean", F.round("t", 9).alias("t"))


def cells(hist: DataFrame, state: DataFrame, cap: float, mends: int = 4) -> DataFrame:
    """key, size, docs, copies (all of the cell together) and the source's figures, for each source and size.

    Rates become whole copies by systematic rounding in descending size; then, ``mends`` times, the
    one document whose size comes nearest to what is still missing or too much gains or loses a copy.
    """
    whole = hist.join(state, "key")
    rate = F.when(F.col("size") > 0, F.least(F.exp(F.least(F.col("t") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap)))).otherwise(F.lit(1.0))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") >= F.col("source_size") * cap, float(cap)).when(F.col("target") <= 0, 0.0).otherwise(rate)
    part = F.round(F.col("docs") * rate * F.lit(float(DOC))).cast("long")
    w = W.partitionBy("key").orderBy(F.col("size").desc())
    whole = whole.withColumn("part", part).withColumn("upto", F.sum("part").over(w) + DOC // 2)
    whole = whole.withColumn("copies", F.expr(f"least(upto div {DOC} - (upto - part) div {DOC}, cast(docs * {float(cap)} as bigint))")).drop("part", "upto")
    for _ in range(mends):
        got = whole.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.first("target").alias("goal")).select("key", F.round(F.col("goal") - F.col("got")).cast("long").alias("short"))
        open_ = whole.join(got, "key").where((F.col("size") > 0) & (F.abs(F.abs("short") - F.col("size")) < F.abs("short")) & F.when(F.col("short") > 0, F.col("copies") < F.floor(F.col("docs") * F.lit(float(cap)))).otherwise(F.col("copies") > 0))
        best = open_.groupBy("key").agg(F.min(F.struct(F.abs(F.abs("short") - F.col("size")).alias("left"), F.col("size").alias("size"), F.signum("short").cast("long").alias("by"))).alias("best")).select("key", "best.size", "best.by")
        whole = stored(whole.join(best, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("by"), "cells")
    return whole


def mix(docs: DataFrame, total_share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), cap: float = 2.0) -> DataFrame:
    """``row`` (the document as a struct), size, source_size, target and copies of each row of ``docs`` (doc_id, text, source).

    Size is the number of words. A document is taken as a whole, 0 to ``cap`` times; which documents
    of one source and size get the odd copy follows a hash of doc_id and text, ranked in groups of
    at most some thousands, so a hot source or size is spread. Null text: size 0, kept once. A null
    source is a source of its own, the last. Rows that repeat are documents of their own. An empty
    table gives none. Other columns stay in ``row`` untouched, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.when(F.col("row.source").isNotNull(), F.concat(F.lit("s"), F.col("row.source").cast("string"))).otherwise(F.lit("n"))
    sized = docs.select(row.alias("row")).withColumn("key", key).withColumn("size", F.coalesce(F.regexp_count(F.col("row.text"), F.lit(WORDS)), F.lit(0)).cast("long"))
    hist = stored(sized.select(F.col("row.source").alias("source"), "key", "size").groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("docs")), "sizes")
    sizes = hist.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    goals = stored(targets(sizes, total_share, weights, cap), "targets")
    hist = hist.drop("source")
    plan = cells(hist, tilts(hist, goals, cap), cap).withColumn("base", F.expr("copies div docs")).withColumn("odd", F.expr("copies % docs"))
    plan = plan.withColumn("buckets", F.ceil(F.col("docs") / RANKED)).select("key", "size", "source_size", "target", "base", "odd", "buckets")
    order = F.xxhash64("row.doc_id", "row.text")
    planned = sized.withColumn("order", order).join(plan, ["key", "size"]).withColumn("bucket", F.pmod("order", "buckets"))
    # how many odd copies go to each bucket of a cell: in equal parts, the first buckets one more
    within = planned.where("odd > 0 and buckets > 1").groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("here"), F.first("odd").alias("odd"))
    upto = F.sum("here").over(W.partitionBy("key", "size").orderBy("bucket"))
    within = within.select("key", "size", "bucket", F.greatest(F.lit(0), F.least(F.col("here"), F.col("odd") - (upto - F.col("here")))).alias("share"))
    rank = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("order", "row.doc_id"))
    taken = planned.join(within, ["key", "size", "bucket"], "left").withColumn("rank", rank)
    return taken.select("row", "size", "source_size", "target", (F.col("base") + F.when(F.col("rank") <= F.coalesce("share", "odd"), 1).otherwise(0)).alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as many times as it has copies."""
    return mix(docs, **how).where("copies > 0").select(F.explode(F.expr("sequence(1, cast(copies as int))")).alias("copy"), "row").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # only the hash and the size of a text are needed here; the text itself isn't moved
    return mix(docs).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op8_mixing": query}
ORACLE: dict[str, str] = {}
