"""Listings, members, sidecars, metadata joins, gates and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import fixtures as fx
from tagloom.functions import paths, tags
from tagloom.functions.numeric import rounded
from tagloom.operators import ingest
from tagloom.plans import query
from tagloom.plans.geometry import RATING, chosen, chosen_sql

FILES = "files as (select case page_id%4 when 0 then concat('train/', printf('%04d', (page_id*7)%1000), '.tar') when 1 then concat('train/', page_id, '.TAR') when 2 then concat('val/', page_id, '.tar') else concat('train/', page_id, '.txt') end as filename from pages)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    name = F.when(i % 4 == 0, F.concat(F.lit("train/"), F.format_string("%04d", (i * 7) % 1000), F.lit(".tar"))).when(i % 4 == 1, F.concat(F.lit("train/"), i.cast("string"), F.lit(".TAR"))).when(i % 4 == 2, F.concat(F.lit("val/"), i.cast("string"), F.lit(".tar"))).otherwise(F.concat(F.lit("train/"), i.cast("string"), F.lit(".txt")))
    return fx.table(spark, sf_dir, "pages").select(name.alias("filename"))


@query(f"with {FILES} select filename from files where starts_with(filename,'train/') and ends_with(lower(filename),'.tar')")
def shard_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.shard_listing(files(spark, sf_dir), "train")


@query(f"with {FILES}, l as (select distinct filename from files where starts_with(filename,'train/') and ends_with(lower(filename),'.tar')) select concat('hf://datasets/o/r/', filename) as source from (select filename from l order by md5(concat('7|', filename)), filename limit 20 offset 5)")
def shard_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = ingest.shard_listing(files(spark, sf_dir), "train").distinct()
    order = [F.md5(F.concat(F.lit("7|"), "filename")), F.col("filename")]
    return ingest.shard_slice(listed, order, 5, 20).select(F.concat(F.lit("hf://datasets/o/r/"), "filename").alias("source"))


KINDED = r"""kinded as (select *, case regexp_extract(name, '(\.[^./]+)$', 1) when '.webp' then 'image' when '.json' then 'json' when '.txt' then 'text' end as kind,
 regexp_replace(name, '\.[^./]+$', '') as key from members)"""
SAMPLES = """samples as (select shard_index, key, min(member_ord) as first_ord, max(name) filter (kind='image') as image, max(name) filter (kind='json') as json, max(name) filter (kind='text') as text from kinded where kind is not null group by all)"""


@query(rf"""with {fx.MEMBERS}, odd as (select case when shard_index%2=0 then name else replace(upper(name),'/','\') end as name from members)
select name, case lower(regexp_extract(name, '(\.[^./\\]+)$', 1)) when '.webp' then 'image' when '.json' then 'json' when '.txt' then 'text' end as kind,
 case when lower(regexp_extract(name, '(\.[^./\\]+)$', 1)) in ('.webp','.json','.txt') then replace(regexp_replace(name, '\.[^./\\]+$', ''),'\','/') end as key from odd""")
def member_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.members(spark, sf_dir).select(F.when(F.col("shard_index") % 2 == 0, F.col("name")).otherwise(F.replace(F.upper("name"), F.lit("/"), F.lit("\\"))).alias("name"))
    return m.select("name", paths.member_kind(F.col("name")).alias("kind"), paths.member_key(F.col("name")).alias("key"))


@query(f"with {fx.MEMBERS}, {KINDED}, {SAMPLES} select * from samples")
def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.samples(fx.members(spark, sf_dir))


@query(f"with {fx.MEMBERS}, {KINDED}, {SAMPLES} select shard_index, key, case when json is not null then 'json' when text is not null then 'text' else 'none' end as sidecar from samples where image is not null")
def sidecar_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.samples(fx.members(spark, sf_dir)).where("image is not null")
    return s.select("shard_index", "key", ingest.sidecar_source(F.col("json"), F.col("text")).alias("sidecar"))


@query(f"""with {fx.MEMBERS}, l as (select shard_index, replace(name, '.webp', '.latent.npy') as name from members),
k as (select shard_index, case when ends_with(name,'.latent.npy') then name[:-12] when ends_with(name,'.json') then name[:-6] end as key, case when ends_with(name,'.latent.npy') then 'latent' when ends_with(name,'.json') then 'json' end as kind from l)
select shard_index, key, count(*) filter (kind='latent')>0 as has_latent, count(*) filter (kind='json')>0 as has_json from k where key is not null group by all""")
def latent_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latent_pairs(fx.members(spark, sf_dir).withColumn("name", F.replace("name", F.lit(".webp"), F.lit(".latent.npy"))))


HUB = "s as (select page_id, case page_id%4 when 0 then concat('hf://datasets/o/r/a b/', page_id, '.tar') when 1 then concat('hf://models/o/r/x+y/', page_id, '.tar') when 2 then 'hf://datasets/o' else url end as source from pages)"


def hub_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    s = F.when(i % 4 == 0, F.concat(F.lit("hf://datasets/o/r/a b/"), i.cast("string"), F.lit(".tar"))).when(i % 4 == 1, F.concat(F.lit("hf://models/o/r/x+y/"), i.cast("string"), F.lit(".tar"))).when(i % 4 == 2, "hf://datasets/o").otherwise(F.col("url"))
    return fx.table(spark, sf_dir, "pages").select(i, s.alias("source"))


@query(f"with {HUB} select page_id, case when page_id%4=0 then concat('https://huggingface.co/datasets/o/r/resolve/main/a%20b/', page_id, '.tar') when page_id%4=1 then concat('https://huggingface.co/o/r/resolve/main/x%2By/', page_id, '.tar') when page_id%4=2 then null else source end as address from s")
def hub_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hub_sources(spark, sf_dir).select("page_id", paths.hub_address(F.col("source")).alias("address"))


@query(f"with {HUB} select page_id, 'o/r' as repo_id, case when page_id%4=0 then concat('a b/', page_id, '.tar') else concat('x+y/', page_id, '.tar') end as filename, case when page_id%4=0 then 'dataset' else 'model' end as repo_type from s where page_id%4<2")
def hub_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hub_sources(spark, sf_dir).withColumn("p", paths.hub_parts(F.col("source"))).where("p is not null")
    return s.select("page_id", "p.repo_id", "p.filename", "p.repo_type")


@query("select page_id, regexp_matches(source, '^(hf|https?)://') as remote from (select page_id, case page_id%3 when 0 then url when 1 then concat('hf://', page_id) else concat('/data/', page_id) end as source from pages)")
def is_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    s = F.when(i % 3 == 0, F.col("url")).when(i % 3 == 1, F.concat(F.lit("hf://"), i.cast("string"))).otherwise(F.concat(F.lit("/data/"), i.cast("string")))
    return fx.table(spark, sf_dir, "pages").select(i, paths.is_remote(s).alias("remote"))


@query("""with v as (select event_id, (event_id*event_id*7919 % 9007199254)*(case event_id%4 when 0 then 1 when 1 then 100 when 2 then 100000 else 1000000 end)::bigint as n from events)
select event_id, case when n<1024 then printf('%.1f B', n::double) when n<1048576 then printf('%.1f KiB', n/1024.0::double) when n<1073741824 then printf('%.1f MiB', n/1048576.0::double) when n<1099511627776 then printf('%.1f GiB', n/1073741824.0::double) else printf('%.1f TiB', n/1099511627776.0::double) end as size from v""")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    n = (i * i * 7919 % 9007199254) * F.when(i % 4 == 0, 1).when(i % 4 == 1, 100).when(i % 4 == 2, 100000).otherwise(1000000)
    return fx.table(spark, sf_dir, "events").select(i, paths.human_bytes(n).alias("size"))


@query("""select event_id, case when event_id%3=0 then event_id*1000 when event_id%4=3 then null when event_id%2=0 then 500 + event_id else event_id end as total from events""")
def content_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    ranged = F.when(i % 3 == 0, F.concat(F.lit("bytes 500-999/"), (i * 1000).cast("string"))).when(i % 3 == 1, "bytes 0-1/*")
    length = F.when(i % 4 == 3, "unknown").otherwise(i.cast("string"))
    status = F.when(i % 2 == 0, 206).otherwise(200)
    return fx.table(spark, sf_dir, "events").select(i, paths.total_bytes(ranged, length, F.lit(500), status).alias("total"))


@query("select event_id, (event_id%64/4.0::double*1073741824)::bigint as nbytes from events")
def size_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fx.table(spark, sf_dir, "events").select(i, paths.gigabytes(i % 64 / 4).alias("nbytes"))


@query(f"with {fx.POSTS} select id, tag_string_general<>'' or tag_string_character<>'' as has_caption from posts")
def has_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.posts(spark, sf_dir).select("id", tags.has_caption(F.lit(None).cast("string"), F.col("tag_string_general"), F.col("tag_string_character")).alias("has_caption"))


@query(f"with {fx.POSTS} select id, {RATING} as rating from posts")
def rating_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.posts(spark, sf_dir).select("id", tags.rating(F.col("rating")).alias("rating"))


@query(f"with {fx.POSTS} select id, {RATING} in ('g','e') as some, false as unknown, true as every from posts")
def rating_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rating")
    return fx.posts(spark, sf_dir).select("id", tags.rating_allowed(r, ["General", "explicit", "?"]).alias("some"), tags.rating_allowed(r, ["?"]).alias("unknown"), tags.rating_allowed(r, []).alias("every"))


@query(f"with {fx.POSTS} select id, rating from posts where lower(trim(rating)) in ('safe','explicit')")
def rating_filter_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.posts(spark, sf_dir).where(tags.raw_rating_allowed(F.col("rating"), ["Safe", "explicit"])).select("id", "rating")


IMAGES = f"{fx.MEMBERS}, {KINDED}, {SAMPLES}, images as (select shard_index, key, first_ord, split_part(key,'/',-1) as name from samples where image is not null)"


@query(f"""with {IMAGES}, {fx.POSTS}, x as (select id::varchar as id, case when id%4<>0 then rating end as rating, score from posts where id%3<>0)
select i.key, case when x.id is not null then x.rating else 'side' end as rating, x.score, x.id is not null as matched from images i left join x on x.id = i.name""")
def meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.samples(fx.members(spark, sf_dir)).where("image is not null").select("key", paths.basename(F.col("key")).alias("sample_key"), F.lit("side").alias("rating"))
    x = fx.posts(spark, sf_dir).where("id % 3 <> 0").withColumn("rating", F.when(F.col("id") % 4 != 0, F.col("rating")))
    return ingest.with_metadata(s, x, ["rating", "score"]).select("key", "rating", "score", "matched")


@query(f"""with {IMAGES}, x as (select doc_id::varchar as id from documents where doc_id%10 < 3 + doc_id//100),
n as (select distinct shard_index, name from images)
select shard_index, count(*) as images, count(x.id) as matched, round(count(x.id)/count(*), 9) as rate, count(x.id)/count(*) >= 0.7 as passes from n left join x on x.id=name group by shard_index""")
def match_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.samples(fx.members(spark, sf_dir)).where("image is not null")
    x = fx.table(spark, sf_dir, "documents").where("doc_id % 10 < 3 + doc_id div 100").select(F.col("doc_id").alias("id"))
    return ingest.match_rates(s, x).withColumn("rate", rounded("rate", 9))


@query(f"with {fx.POSTS}, f as (select id%50 as source, count(*) as n from posts group by 1) select source, n from f where source%3<>0")
def pending_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.posts(spark, sf_dir).groupBy((F.col("id") % 50).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return ingest.pending(f, f.where("source % 3 = 0"), "source")


@query(f"""with {fx.POSTS}, {chosen_sql(1024)}, t as (select id//100 as shard_index, case when {RATING} not in ('g','s','q') then 'rating' when greatest(bw::double/image_width, bh::double/image_height)>1.5 then 'upscale' else 'accepted' end as fate from chosen)
select shard_index, count(*) filter (fate='accepted') as accepted, count(*) filter (fate='rating') as rating, count(*) filter (fate='upscale') as upscale, count(*) filter (fate='invalid') as invalid from t group by shard_index""")
def skip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.posts(spark, sf_dir).select(F.floor(F.col("id") / 100).alias("shard_index"), ingest.fate(F.col("rating"), F.col("image_width"), F.col("image_height"), 1024, ["g", "s", "q"], 1.5).alias("fate"))
    return t.groupBy("shard_index").agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("accepted", "rating", "upscale", "invalid")])


@query(f"""with {fx.POSTS}, {chosen_sql(768)}, s as (select *, greatest(bw::double/image_width, bh::double/image_height) as sc from chosen),
r as (select *, greatest(bw, ceil(image_width*sc)::bigint) as rw, greatest(bh, ceil(image_height*sc)::bigint) as rh from s)
select id, concat(bw,'x',bh) as bucket, [image_width, image_height] as original_size, [(rw-bw)//2, (rh-bh)//2, (rw-bw)//2+bw, (rh-bh)//2+bh] as crop_box, printf('%04d', id//100) as source_shard, concat(id,'.webp') as source_member from r""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tagloom.functions import geometry as g

    c = chosen(fx.posts(spark, sf_dir), 768).withColumn("c", g.cover_crop(F.col("image_width"), F.col("image_height"), F.col("b")))
    return c.select("id", g.key(F.col("b.width"), F.col("b.height")).alias("bucket"), F.array("image_width", "image_height").alias("original_size"), F.array("c.left", "c.top", "c.right", "c.bottom").alias("crop_box"), F.format_string("%04d", F.floor(F.col("id") / 100)).alias("source_shard"), F.concat(F.col("id").cast("string"), F.lit(".webp")).alias("source_member"))


@query(f"with {fx.POSTS} select id, id//100 as shard_index, id%100 as sample_index from posts where id//100 > 2 or (id//100 = 2 and id%100 > 41)")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.posts(spark, sf_dir).select("id", F.floor(F.col("id") / 100).alias("shard_index"), (F.col("id") % 100).alias("sample_index"))
    return ingest.resumed(s, 2, 41)


@query("""select doc_id, printf('%06d-%08d', doc_id//100, doc_id%100) as sample_id, substr(sha1(concat(source, chr(0), doc_id)),1,24) as produced_id, substr(sha1(source),1,20) as output_id, concat(substr(sha1(concat('https://x.org/', doc_id, '.tar?a=1')),1,16), '-', doc_id, '.tar') as cached from documents""")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return fx.table(spark, sf_dir, "documents").select(i, F.format_string("%06d-%08d", F.floor(i / 100), i % 100).alias("sample_id"), paths.hash_id(24, F.col("source"), i.cast("string")).alias("produced_id"), paths.hash_id(20, F.col("source")).alias("output_id"), paths.cache_name(F.concat(F.lit("https://x.org/"), i.cast("string"), F.lit(".tar?a=1"))).alias("cached"))


@query("select event_id, json_type(props)='OBJECT' as is_object, json_extract_string(props, '$.k') as k from events")
def sidecar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return fx.table(spark, sf_dir, "events").select("event_id", F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)).alias("is_object"), F.get_json_object("props", "$.k").alias("k"))


@query(f"with {IMAGES} select shard_index, key, row_number() over (partition by shard_index order by first_ord)-1 as sample_index, row_number() over (order by shard_index, first_ord)-1 as index from images")
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.samples(fx.members(spark, sf_dir)).where("image is not null")
    return ingest.global_ordinals(ingest.ordinals(s, "first_ord"), "shard_index", ["first_ord"]).select("shard_index", "key", "sample_index", "index")


@query(f"with {IMAGES} select shard_index, count(*) as images, count(distinct images.name) as names, sum(nbytes)::bigint as nbytes from images join members using (shard_index) group by shard_index")
def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.members(spark, sf_dir)
    images = ingest.samples(m).where("image is not null").select("shard_index", paths.basename(F.col("key")).alias("name"))
    per = images.groupBy("shard_index").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("name").alias("names"))
    size = m.groupBy("shard_index").agg(F.sum("nbytes").alias("s"), F.count(F.lit(1)).alias("c"))
    return per.join(size, "shard_index").select("shard_index", (F.col("k") * F.col("c")).alias("images"), "names", (F.col("s") * F.col("k")).alias("nbytes"))
