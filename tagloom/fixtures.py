"""Views that turn the driver's tables into image-and-tag shaped inputs, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RATINGS = ("g", "s", "q", "e", "safe", "Explicit", "u")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index source rows: id, rating, score, sizes, tag strings and flags, derived from ``documents``."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    return d.select(
        i.alias("id"),
        F.element_at(F.array(*map(F.lit, RATINGS)), (i % 7).cast("int") + 1).alias("rating"),
        (i * 31 % 101).cast("int").alias("score"),
        (256 + (i * 7919) % 1793).alias("image_width"),
        (256 + (i * 104729) % 1801).alias("image_height"),
        F.when(i % 13 == 0, "").otherwise(F.array_join(words, " ")).alias("tag_string_general"),
        F.when(i % 3 == 0, F.concat(F.lit("char_"), (i % 17).cast("string"))).otherwise("").alias("tag_string_character"),
        F.col("lang").alias("tag_string_copyright"),
        F.concat(F.lit("artist_"), "source").alias("tag_string_artist"),
        F.when(i % 11 == 0, "highres").otherwise("").alias("tag_string_meta"),
        (i % 29 == 0).alias("is_deleted"),
        F.lit(None).cast("boolean").alias("is_banned"),
        (i % 31 == 0).alias("is_flagged"),
    )


POSTS = """
posts as (select doc_id as id,
 (['g','s','q','e','safe','Explicit','u'])[cast(doc_id%7 as int)+1] as rating,
 cast(doc_id*31%101 as int) as score,
 256+(doc_id*7919)%1793 as image_width, 256+(doc_id*104729)%1801 as image_height,
 case when doc_id%13=0 then ''
  else array_to_string(list_filter(regexp_split_to_array(lower(text),'[^a-z]+'), lambda x: x<>''),' ') end as tag_string_general,
 case when doc_id%3=0 then concat('char_',cast(doc_id%17 as varchar)) else '' end as tag_string_character,
 lang as tag_string_copyright, concat('artist_',source) as tag_string_artist,
 case when doc_id%11=0 then 'highres' else '' end as tag_string_meta,
 doc_id%29=0 as is_deleted, cast(null as boolean) as is_banned, doc_id%31=0 as is_flagged
from documents)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members: shard_index, name, member_ord, nbytes; with orphans, missing sidecars and ignored kinds."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    kinds = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(e).alias("ext")) for o, e in enumerate((".webp", ".json", ".txt", ".nfo"))])
    k = d.select("doc_id", F.octet_length("text").alias("nbytes"), F.explode(kinds).alias("k"))
    kept = ((F.col("k.o") == 0) & (i % 17 != 0)) | ((F.col("k.o") == 1) & (i % 5 != 0)) | ((F.col("k.o") == 2) & (i % 4 == 0)) | ((F.col("k.o") == 3) & (i % 10 == 0))
    return k.where(kept).select(F.floor(i / 100).alias("shard_index"), F.concat(F.lit("d"), (i % 3).cast("string"), F.lit("/"), i.cast("string"), "k.ext").alias("name"), (i * 4 + F.col("k.o")).alias("member_ord"), F.col("nbytes").cast("long").alias("nbytes"))


MEMBERS = """
members as (select cast(floor(doc_id/100) as bigint) as shard_index,
 concat('d',cast(doc_id%3 as varchar),'/',cast(doc_id as varchar),k.ext) as name,
 doc_id*4+k.o as member_ord, octet_length(encode(text))::bigint as nbytes
from documents cross join (values (0,'.webp'),(1,'.json'),(2,'.txt'),(3,'.nfo')) k(o,ext)
where (k.o=0 and doc_id%17<>0) or (k.o=1 and doc_id%5<>0) or (k.o=2 and doc_id%4=0) or (k.o=3 and doc_id%10=0))"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    local = e.select(F.lit("local").alias("root"), F.format_string("step-%08d", i * 250).alias("name"), (i * 250).alias("step"), (i % 3 != 0).alias("has_model"), (i % 4 != 0).alias("has_state"))
    mirror = e.select(F.lit("mirror").alias("root"), F.format_string("step-%08d", i * 500).alias("name"), (i * 500).alias("step"), (i % 5 != 0).alias("has_model"), F.lit(True).alias("has_state"))
    return local.unionByName(mirror)


CHECKPOINTS = """
checkpoints as (select 'local' as root, printf('step-%08d', event_id*250) as name, event_id*250 as step, event_id%3<>0 as has_model, event_id%4<>0 as has_state
 from events
 union all select 'mirror', printf('step-%08d', event_id*500), event_id*500, event_id%5<>0, true from events)"""


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, clean and noise (array<double>), and t in [0, 1]."""
    e = table(spark, sf_dir, "embeddings")
    x = F.col("embedding").cast("array<double>")
    return e.select("vec_id", x.alias("clean"), F.reverse(x).alias("noise"), (F.col("vec_id") % 11 / F.lit(10.0)).alias("t"))


LATENTS = """
latents as (select vec_id, embedding::double[] as clean, list_reverse(embedding::double[]) as noise, (vec_id % 11) / 10.0::double as t from embeddings)"""


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, key, ord, pixels of one channel, shape and metadata: 50 documents a source, two shapes; every 19th sample and every 7th source can't be encoded."""
    i = F.col("doc_id")
    h, w = F.when(i % 2 == 0, 32).otherwise(48), F.when(i % 2 == 0, 48).otherwise(32)
    broken = (i % 19 == 0) | (F.floor(i / 50) % 7 == 3)
    value = lambda b: (F.pmod(F.col("doc_id") * 7 + b * 3, F.lit(32)) / 8 - 2).cast("float")
    upto = lambda c: F.sequence(F.lit(0), (F.col(c) / 16).cast("int") - 1)
    d = table(spark, sf_dir, "documents").select(i, h.alias("h"), w.alias("w"), broken.alias("broken"))
    # blocks of 16 x 16 equal pixels, a value each: rows are repeated, pixels aren't computed one by one
    row = lambda r: F.flatten(F.transform(upto("w"), lambda c: F.array_repeat(value(r * (F.col("w") / 16).cast("int") + c), 16)))
    whole = F.flatten(F.transform(upto("h"), lambda r: F.flatten(F.array_repeat(row(r), 16))))
    pixels = F.when(F.col("broken"), F.slice(whole, 1, 100)).otherwise(whole)
    return d.select(
        F.concat(F.lit("/raw/"), F.format_string("%04d", F.floor(i / 50)), F.lit(".tar")).alias("source"),
        F.concat(F.lit("d"), (i % 3).cast("string"), F.lit("/"), i.cast("string")).alias("key"),
        i.alias("ord"), pixels.alias("pixels"), F.array(F.lit(1), "h", "w").alias("shape"),
        F.to_json(F.struct(F.concat("w", F.lit("x"), "h").alias("bucket"))).alias("metadata"),
    )


RAW = """
raw as (select doc_id, concat('/raw/', printf('%04d', doc_id//50), '.tar') as source, concat('d', doc_id%3, '/', doc_id) as key,
 doc_id%19=0 or (doc_id//50)%7=3 as broken, case when doc_id%2=0 then [1,2,3] else [1,3,2] end as shape,
 list_transform(range(0, 6), lambda b: ((doc_id*7 + b*3)%32/8.0::double - 2)) as latent from documents)"""
