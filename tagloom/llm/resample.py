"""Importance resampling towards a target: documents are drawn by hashed n-gram gains and Gumbel noise.

Every text becomes an array of feature buckets by higher-order functions. Bucket totals of corpus and
target are the only thing counted by a shuffle; they give one gain a bucket, a literal array in which a
document's weight is an ``aggregate`` over ``element_at``: scoring explodes nothing. Adding Gumbel
noise to the log weights and taking the largest sums draws without replacement, in proportion to the
weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm._work import remove, stored, table

BUCKETS = 10_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: monotonically_increasing_id holds the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def words(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, with only A-Z lower-cased; null: none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), lambda w: w != "")


def buckets(words_: Column, longest: int = 1, count: int = BUCKETS) -> Column:
    """Bucket of every run of 1 to ``longest`` words: crc32 of its UTF-8 bytes modulo ``count``."""
    bucket = lambda run: (F.crc32(run.cast("binary")) % count).cast("int")

    def of(n: int) -> Column:
        starts = F.when(F.size(words_) >= n, F.sequence(F.lit(1), F.size(words_) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words_, i, F.lit(n)), " ")))

    runs = [F.transform(words_, bucket), *map(of, range(2, longest + 1))]
    return runs[0] if longest == 1 else F.concat(*runs)


def totals(featured: DataFrame, count: int) -> list[int]:
    """How often each bucket occurs in column ``buckets``; ``count`` rows reach the driver at most."""
    out = [0] * count
    for r in featured.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(target share / corpus share)) of each bucket, both smoothed by one."""
    many, few, k = float(sum(corpus) + len(corpus)), float(sum(target) + len(target)), len(corpus)
    return [math.floor(1000 * math.log((target[b] + 1) * many / ((corpus[b] + 1) * few))) for b in range(k)]


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of the Gumbel variate g that seed and document give; a null id counts as an empty one."""
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, longest: int = 1, count: int = BUCKETS, least: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs`` (doc_id, text), towards ``target`` (text).

    Of the rows with ``least`` words or more, floor(percent * rows / 100) with the highest scores are
    drawn and ranked 1, 2, 3...; the rank of the others is null. Equal scores rank by doc_id, nulls
    first; rows that repeat a doc_id and its score follow each other in any order. Null and empty texts
    have weight 0 and aren't drawn; an empty target is one whose buckets are all equally rare. Other
    columns are left out; an empty table gives none.

    Texts are cut into words once; the buckets are kept in the shared folder until the scores stand
    there. Scores (a few numbers a row) are sorted by range, so no task holds all ranks, and the driver
    sees one number for each range.
    """
    spark = docs.sparkSession
    w = words(F.col("text"))
    featured = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), w.alias("w")).select("doc_id", F.size("w").alias("n_words"), buckets(F.col("w"), longest, count).alias("buckets"))
    featured = stored(featured, "resample-buckets")
    of_target = totals(target.select(w.alias("w")).select(buckets(F.col("w"), longest, count).alias("buckets")), count)
    gain = F.split(F.lit(",".join(map(str, gains(totals(featured, count), of_target)))), ",").cast("array<bigint>")
    weight = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda total, b: total + F.element_at(gain, b + 1))
    scored = featured.select("doc_id", F.size("buckets").cast("bigint").alias("n_features"), weight.alias("weight"), (F.col("n_words") >= least).alias("may"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    order = [F.desc("may"), F.desc("score"), F.asc("doc_id")]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed, "resample-scores")
    remove(spark, featured)
    part, place = F.shiftright("at", _PLACE_BITS), F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count_if("may").alias("n")).collect()  # a row for each range
    before, upto = [], 0
    for r in sorted(sizes):
        before.append((r["part"], upto))
        upto += r["n"]
    drawn = percent * upto // 100
    offsets = F.broadcast(spark.createDataFrame(before, "part bigint, before bigint"))
    rank = F.col("before") + place + 1
    return placed.withColumn("part", part).join(offsets, "part", "left").select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (rank <= drawn), rank).alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_resample": query}
ORACLE = {
    # crc32 by its polynomial, a byte at a time, for each distinct word
    "op13_resample": rf"""
with tab as (select list(x order by i) as t from (
  select i, list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as x from range(0, 256) r(i))),
d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SEPARATORS}'), lambda w: w <> '') as w from documents),
b as (select list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SEPARATORS}'), lambda w: w <> '') as w from benchmark),
dw as (select doc_id, unnest(w) as w from d), bw as (select unnest(w) as w from b),
v as (select distinct w from (select w from dw union all select w from bw)),
h as (select w, xor(list_reduce(list_transform(range(0, octet_length(encode(w))::bigint), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::bigint, 2))::bigint),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255)::integer + 1]), 4294967295), 4294967295) % {BUCKETS} as bucket from v, tab),
s as (select bucket, count(*) as s from dw join h using (w) group by all), t as (select bucket, count(*) as t from bw join h using (w) group by all),
n as (select (select count(*) from dw) as big_s, (select count(*) from bw) as big_t),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (big_s + {BUCKETS}) / ((coalesce(s, 0) + 1)::double * (big_t + {BUCKETS}))))::bigint as gain from (select distinct bucket from h) left join s using (bucket) left join t using (bucket), n),
weights as (select doc_id, sum(gain)::bigint as weight from dw join h using (w) join g using (bucket) group by doc_id),
x as (select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from d left join weights using (doc_id)),
r as (select *, n_features >= 20 as may, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as r from x)
select doc_id, n_features, weight, score, case when may and r <= (10 * (select count(*) from x where n_features >= 20)) // 100 then r end as rank from r
"""
}
