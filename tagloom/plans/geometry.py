"""Buckets: choice, crops, keys and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import fixtures as fx
from tagloom.functions import geometry as g
from tagloom.functions import tags
from tagloom.functions.numeric import rounded
from tagloom.operators import batching, index
from tagloom.plans import query


def stage_sql(stage: int) -> str:
    rows = ",".join(f"({i},{w},{h})" for i, (w, h) in enumerate(g.STAGES[stage]))
    return f"stage as (select * from (values {rows}) s(ord,bw,bh))"


def chosen_sql(stage: int, source: str = "posts") -> str:
    """CTEs that end in ``chosen``: the source with bw and bh of its bucket."""
    return f"""{stage_sql(stage)},
ranked as (select p.*, s.bw, s.bh, row_number() over (partition by p.id order by
  greatest(p.image_width*s.bh, p.image_height*s.bw)::double/least(p.image_width*s.bh, p.image_height*s.bw),
  abs(p.image_width*p.image_height - s.bw*s.bh), s.ord) as rn from {source} p, stage s),
chosen as (select * exclude (rn) from ranked where rn = 1)"""


def chosen(df: DataFrame, stage: int) -> DataFrame:
    return df.withColumn("b", g.choose(F.col("image_width"), F.col("image_height"), g.stage_buckets(stage)))


@query(f"with {fx.POSTS} select * from posts")
def posts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.posts(spark, sf_dir)


def _bucket(stage: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chosen(fx.posts(spark, sf_dir), stage).select("id", g.key(F.col("b.width"), F.col("b.height")).alias("bucket"))

    run.__name__ = f"bucket_{stage}"
    return query(f"with {fx.POSTS}, {chosen_sql(stage)} select id, concat(bw,'x',bh) as bucket from chosen")(run)


bucket_512, bucket_768, bucket_1024 = map(_bucket, (512, 768, 1024))


@query(f"""with {fx.POSTS}, k as (select id, case id%5 when 0 then '512X768' when 1 then '640x960' when 2 then '500x500' when 3 then 'x' else concat(32*(1+id%40),'x',32*(1+id%37)) end as key from posts),
p as (select id, key, try_cast(split_part(lower(key),'x',1) as integer) as w, try_cast(split_part(lower(key),'x',2) as integer) as h from k)
select id, key, case when w>0 and h>0 and w%32=0 and h%32=0 then w end as width, case when w>0 and h>0 and w%32=0 and h%32=0 then h end as height from p""")
def bucket_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    key = F.when(i % 5 == 0, "512X768").when(i % 5 == 1, "640x960").when(i % 5 == 2, "500x500").when(i % 5 == 3, "x").otherwise(F.concat((32 * (1 + i % 40)).cast("string"), F.lit("x"), (32 * (1 + i % 37)).cast("string")))
    p = fx.posts(spark, sf_dir).select("id", key.alias("key")).withColumn("p", g.parse_key(F.col("key")))
    return p.select("id", "key", "p.width", "p.height")


@query(f"with {fx.POSTS}, {chosen_sql(768)} select id, bw//16 as latent_width, bh//16 as latent_height, (bw//32)*(bh//32) as tokens, round(bw::double/bh, 9) as aspect from chosen")
def token_latent_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("b.width"), F.col("b.height")
    return chosen(fx.posts(spark, sf_dir), 768).select("id", g.latent_side(w).alias("latent_width"), g.latent_side(h).alias("latent_height"), g.tokens(w, h).alias("tokens"), rounded(g.aspect(w, h), 9).alias("aspect"))


@query(f"""with {fx.POSTS}, {chosen_sql(768)}, s as (select *, greatest(bw::double/image_width, bh::double/image_height) as sc from chosen),
r as (select id, bw, bh, greatest(bw, ceil(image_width*sc)::bigint) as rw, greatest(bh, ceil(image_height*sc)::bigint) as rh from s)
select id, rw as resized_width, rh as resized_height, (rw-bw)//2 as "left", (rh-bh)//2 as top, (rw-bw)//2+bw as "right", (rh-bh)//2+bh as bottom from r""")
def cover_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(fx.posts(spark, sf_dir), 768).select("id", g.cover_crop(F.col("image_width"), F.col("image_height"), F.col("b")).alias("c")).select("id", "c.*")


@query(f"with {fx.POSTS}, {chosen_sql(1024)} select id, round(greatest(bw::double/image_width, bh::double/image_height), 9) as upscale from chosen where greatest(bw::double/image_width, bh::double/image_height) <= 1.5")
def upscale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chosen(fx.posts(spark, sf_dir), 1024).withColumn("u", g.upscale(F.col("image_width"), F.col("image_height"), F.col("b")))
    return p.where("u <= 1.5").select("id", rounded("u", 9).alias("upscale"))


@query(f"with {fx.POSTS}, {chosen_sql(768)} select concat(bw,'x',bh) as bucket, count(*) as images, round(avg(image_width::double/image_height), 6) as mean_aspect from chosen group by bw, bh")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = chosen(fx.posts(spark, sf_dir), 768).withColumn("bucket", g.key(F.col("b.width"), F.col("b.height")))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("images"), rounded(F.avg(g.aspect(F.col("image_width"), F.col("image_height"))), 6).alias("mean_aspect"))


@query(f"with {fx.POSTS}, {chosen_sql(768)}, n as (select concat(bw,'x',bh) as bucket, count(*) as n from chosen group by 1) select bucket, n//4 as whole, (n+3)//4 as every from n")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = chosen(fx.posts(spark, sf_dir), 768).select(g.key(F.col("b.width"), F.col("b.height")).alias("bucket"))
    whole = batching.batch_counts(b, 4).select("bucket", F.col("batches").alias("whole"))
    return whole.join(batching.batch_counts(b, 4, drop_last=False).select("bucket", F.col("batches").alias("every")), "bucket")


@query(f"with {stage_sql(768)} select concat(bw,'x',bh) as bucket, bw as width, bh as height, bw%32=0 and bh%32=0 as valid from stage")
def stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(1).select(F.explode(g.bucket_table(768)).alias("bucket", "b"))
    return t.select("bucket", "b.width", "b.height", g.valid(F.col("b.width"), F.col("b.height")).alias("valid"))


@query("""with s as (select event_id, case event_id%4 when 0 then '512×768' when 1 then '64X32' when 2 then '100x64' else 'big' end as size from events),
p as (select event_id, size, try_cast(split_part(replace(lower(size),'×','x'),'x',1) as integer) as h, try_cast(split_part(replace(lower(size),'×','x'),'x',2) as integer) as w from s)
select event_id, size, case when h>0 and w>0 and h%32=0 and w%32=0 then h end as height, case when h>0 and w>0 and h%32=0 and w%32=0 then w end as width from p""")
def pixel_size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = fx.table(spark, sf_dir, "events").select(i, F.when(i % 4 == 0, "512×768").when(i % 4 == 1, "64X32").when(i % 4 == 2, "100x64").otherwise("big").alias("size"))
    return s.withColumn("p", g.parse_size(F.col("size"))).select("event_id", "size", "p.height", "p.width")


@query("select vec_id, list_transform(embedding::double[], lambda x: round(abs(x)*255/127.5 - 1.0, 9)) as unit from embeddings")
def pixel_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x) * 255)
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(g.pixel_to_unit(pixels), lambda x: rounded(x, 9)).alias("unit"))


@query("select vec_id, list_transform(embedding::double[], lambda x: round_even((least(greatest(x*2, -1.0), 1.0) + 1.0)*127.5, 0)::integer) as pixels from embeddings")
def pixel_denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 2)
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", g.unit_to_pixel(values).alias("pixels"))


USABLE = "(is_deleted is null or is_deleted=false) and (is_banned is null or is_banned=false) and (is_flagged is null or is_flagged=false) and tag_string_general<>''"
RATING = "case lower(trim(rating)) when 'g' then 'g' when 'general' then 'g' when 'safe' then 'g' when 's' then 's' when 'sensitive' then 's' when 'suggestive' then 's' when 'q' then 'q' when 'questionable' then 'q' when 'e' then 'e' when 'explicit' then 'e' else '' end"


@query(f"""with {fx.POSTS}, kept as (select *, printf('%04d', id%1000) as part from posts where {USABLE} and {RATING} in ('g','s')),
{chosen_sql(768, 'kept')}
select concat(bw,'x',bh) as bucket, count(*) as images, count(distinct part) as parts, round(avg((bw//32)*(bh//32)), 6) as mean_tokens, count(*)//4 as batches
from chosen where greatest(bw::double/image_width, bh::double/image_height) <= 2.0 group by bw, bh""")
def index_then_bucket_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_report(fx.posts(spark, sf_dir))


def index_report(posts: DataFrame) -> DataFrame:
    """From source rows to batches of each bucket: filters, partition key, whitelist, bucket choice, upscale limit, counts."""
    kept = index.build(posts).where(tags.rating_allowed(F.col("rating"), ["general", "sensitive"])).withColumnRenamed("bucket", "part")
    b = chosen(kept, 768).where(g.upscale(F.col("image_width"), F.col("image_height"), F.col("b")) <= 2.0)
    b = b.select("part", g.key(F.col("b.width"), F.col("b.height")).alias("bucket"), g.tokens(F.col("b.width"), F.col("b.height")).alias("tokens"))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("part").alias("parts"), rounded(F.avg("tokens"), 6).alias("mean_tokens"), F.floor(F.count(F.lit(1)) / 4).alias("batches"))
