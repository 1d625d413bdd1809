"""From archive members to samples: sidecars, indexed metadata, gates, filters and their accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions import geometry, paths, tags


def shard_listing(files: DataFrame, split: str, name: str = "filename") -> DataFrame:
    """Archives of a split, by name."""
    return files.where(F.startswith(F.col(name), F.lit(f"{split}/")) & F.endswith(F.lower(F.col(name)), F.lit(".tar"))).orderBy(name)


def shard_slice(files: DataFrame, order: list[Column], start: int, limit: int) -> DataFrame:
    """In the given order, without the first ``start``, at most ``limit``."""
    return files.orderBy(*order).offset(start).limit(limit)


def samples(members: DataFrame) -> DataFrame:
    """shard_index, key, first_ord and the last image, json and text member of each key; members of other kinds don't count."""
    kinds = members.withColumn("kind", paths.member_kind(F.col("name"))).withColumn("key", paths.member_key(F.col("name"))).where("kind is not null")
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("name")), F.when(F.col("kind") == kind, F.col("member_ord"))).alias(kind)
    return kinds.groupBy("shard_index", "key").agg(F.min("member_ord").alias("first_ord"), last("image"), last("json"), last("text"))


def sidecar_source(json: Column, text: Column) -> Column:
    return F.when(json.isNotNull(), "json").when(text.isNotNull(), "text").otherwise("none")


def latent_pairs(members: DataFrame) -> DataFrame:
    """shard_index, key and whether both halves of a latent sample are there."""
    named = members.withColumn("part", paths.latent_key(F.col("name"))).where("part is not null")
    return named.groupBy("shard_index", F.col("part.key").alias("key")).agg((F.count_if(F.col("part.kind") == "latent") > 0).alias("has_latent"), (F.count_if(F.col("part.kind") == "json") > 0).alias("has_json"))


def with_metadata(samples_: DataFrame, index: DataFrame, columns: list[str], id_: str = "sample_key") -> DataFrame:
    """Left join with the index by id; where it matches, its values stand, also where they are null."""
    side = index.select(F.col("id").cast("string").alias("__id"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = samples_.join(side, F.col(id_) == F.col("__id"), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    for c in columns:
        joined = joined.withColumn(c, F.when(hit, F.col(f"__{c}")).otherwise(F.col(c) if c in samples_.columns else F.lit(None)))
    return joined.withColumn("matched", hit).drop("__id", "__hit", *[f"__{c}" for c in columns])


def match_rates(keys: DataFrame, index: DataFrame, least: float = 0.70) -> DataFrame:
    """shard_index, images, matched, rate and passes: how many distinct image names the index knows.

    Names are those of images without their folders; a rate equal to ``least`` passes.
    """
    names = keys.select("shard_index", paths.basename(F.col("key")).alias("name")).distinct()
    known = index.select(F.col("id").cast("string").alias("name")).distinct().withColumn("hit", F.lit(1))
    per = names.join(known, "name", "left").groupBy("shard_index").agg(F.count(F.lit(1)).alias("images"), F.count("hit").alias("matched"))
    rate = F.col("matched") / F.greatest("images", F.lit(1))
    return per.select("shard_index", "images", "matched", rate.alias("rate"), (rate >= least).alias("passes"))


def gated(rates: DataFrame) -> DataFrame:
    """The rates, or an error at the first shard that doesn't pass."""
    return rates.withColumn("passes", F.when(F.col("passes"), True).otherwise(F.raise_error(F.format_string("shard %s: only %s of its images are in the index", F.col("shard_index").cast("string"), F.col("rate").cast("string"))).cast("boolean")))


def fate(rating: Column, width: Column, height: Column, stage: int, allowed: list[str] | None, max_upscale: float) -> Column:
    """accepted, rating, upscale or invalid: what becomes of a sample. Sizes that are missing or not positive are invalid."""
    bucket = geometry.choose(width, height, geometry.stage_buckets(stage))
    return (
        F.when(~tags.rating_allowed(rating, allowed), "rating")
        .when(bucket.isNull(), "invalid")
        .when(geometry.upscale(width, height, bucket) > max_upscale, "upscale")
        .otherwise("accepted")
    )


def resumed(samples_: DataFrame, shard: int, sample: int) -> DataFrame:
    """Samples after the cursor, by shard and place."""
    return samples_.where((F.col("shard_index") > shard) | ((F.col("shard_index") == shard) & (F.col("sample_index") > sample)))


def ordinals(samples_: DataFrame, order: str) -> DataFrame:
    """sample_index, each shard's samples counted from 0."""
    return samples_.withColumn("sample_index", F.row_number().over(W.partitionBy("shard_index").orderBy(order)).cast("bigint") - 1)


def global_ordinals(samples_: DataFrame, part: str, order: list[str], name: str = "index") -> DataFrame:
    """A running number over (part, order): rows are ranked inside parts and the parts' sizes, a row each, are added."""
    sizes = samples_.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(part, (F.sum("__n").over(W.orderBy(part)) - F.col("__n")).alias("__before"))
    ranked = samples_.withColumn("__at", F.row_number().over(W.partitionBy(part).orderBy(*order)) - 1)
    return ranked.join(before, part).withColumn(name, (F.col("__before") + F.col("__at")).cast("bigint")).drop("__at", "__before")


def pending(sources: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Sources without an output yet."""
    return sources.join(done.select(key).distinct(), key, "left_anti")


def zipped(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of two tables side by side by the ordinal ``on``; an error at the first row that the other table lacks.

    Other columns must differ in name. Ordinals are unique in each table.
    """
    a, b = left.withColumn("__left", F.lit(True)), right.withColumn("__right", F.lit(True))
    both = a.join(b, on, "full")
    lone = F.raise_error(F.format_string("row %s has no partner", F.col(on).cast("string")))
    return both.withColumn(on, F.when(F.col("__left") & F.col("__right"), F.col(on)).otherwise(lone.cast(both.schema[on].dataType))).drop("__left", "__right")
