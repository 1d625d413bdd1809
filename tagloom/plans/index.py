"""The metadata index and its partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import fixtures as fx
from tagloom.functions import paths
from tagloom.operators import index
from tagloom.plans import query
from tagloom.plans.geometry import USABLE
from tagloom.sources import shared, store

MODULUS = 40
PROJECTED = "id, rating, score, image_width, image_height, tag_string_general, tag_string_character, tag_string_copyright, tag_string_artist, tag_string_meta"


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines see."""
    return shared.new_dir(spark, "index")


@query(f"with {fx.POSTS} select id, rating, 0 as score, image_width, image_height, tag_string_general, '' as tag_string_character, '' as tag_string_copyright, tag_string_artist, tag_string_meta from posts")
def adaptive_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = fx.posts(spark, sf_dir).withColumnsRenamed({"image_width": "width", "image_height": "height", "tag_string_general": "tag_string"}).drop("score", "tag_string_character", "tag_string_copyright")
    return index.project(other)


@query(f"with {fx.POSTS} select id, printf('%04d', id%1000) as bucket from posts")
def partition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.posts(spark, sf_dir).select("id", index.bucket_of(F.col("id")).alias("bucket"))


@query(f"with {fx.POSTS} select id, rating from posts where {USABLE}")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.usable(fx.posts(spark, sf_dir)).select("id", "rating")


def _written(spark: SparkSession, sf_dir: str, whole: bool = True) -> str:
    at = scratch(spark)
    index.write(index.build(fx.posts(spark, sf_dir), MODULUS), at, whole)
    return at


INDEX = f"idx as (select {PROJECTED}, printf('%04d', id%{MODULUS}) as bucket from posts where {USABLE})"


@query(f"with {fx.POSTS}, {INDEX} select * from idx")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.read(spark, _written(spark, sf_dir))


@query(f"with {fx.POSTS}, {INDEX} select count(distinct bucket) as buckets, count(distinct bucket) as files, false as compact, true as current from idx")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index.stats(index.read(spark, _written(spark, sf_dir)))
    b, f = F.col("buckets"), F.col("files")
    return s.select(b, f, index.needs_compaction(b, f).alias("compact"), index.is_current(F.lit(2), F.lit(2), F.lit(True), b, f, 30, 50).alias("current"))


@query("""with m as (select event_id, event_id%3 as version, 880+event_id%260 as buckets, 880+event_id%300 as files, event_id%7<>0 as same from events)
select event_id, version=2 and same and buckets between 900 and 1100 and files>=buckets as current, files>2*buckets as compact from m""")
def index_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    b, f = 880 + i % 260, 880 + i % 300
    return fx.table(spark, sf_dir, "events").select(i, index.is_current(i % 3, F.lit(2), i % 7 != 0, b, f).alias("current"), index.needs_compaction(b, f).alias("compact"))


@query(f"with {fx.POSTS}, {INDEX} select bucket, count(*) as n, sum(id)::bigint as ids, 1::bigint as files from idx group by bucket")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose, whole = _written(spark, sf_dir, False), scratch(spark)
    index.compact(spark, loose, whole)
    got = index.read(spark, whole).withColumn("file", F.input_file_name())
    return got.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count_distinct("file").alias("files"))


@query(f"with {fx.POSTS}, {INDEX} select bucket, count(*) as n, sum(id)::bigint as ids, 1::bigint as files, (select count(distinct bucket) from idx) as buckets, true as fewer from idx group by bucket")
def published_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that are current, compacted behind the pointer; what readers then find."""
    root, posts = scratch(spark), fx.posts(spark, sf_dir)
    parts = max(4, posts.rdd.getNumPartitions())  # several fragments a bucket, however small the table is
    store.publish_version(spark, root, lambda at: index.write(index.build(posts.repartition(parts), MODULUS), at, False))
    done = store.compact(spark, root)
    got = index.read(spark, store.current(spark, root)).withColumn("file", F.input_file_name())
    per = got.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count_distinct("file").alias("files"))
    return per.withColumns({"buckets": F.lit(done["buckets"]).cast("bigint"), "fewer": F.lit(done["after"] < done["before"])})


@query(f"with {fx.POSTS}, {INDEX} select id, bucket, rating from idx where bucket in ('0003','0017')")
def partition_pruned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.read(spark, _written(spark, sf_dir), ["0003", "0017"]).select("id", "bucket", "rating")


@query(f"with {fx.POSTS} select id, rating, case when id%2=0 then score end as score, case when id%2=1 then tag_string_meta end as tag_string_meta from posts")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.posts(spark, sf_dir)
    return p.where("id % 2 = 0").select("id", "rating", "score").unionByName(p.where("id % 2 = 1").select("id", "rating", "tag_string_meta"), allowMissingColumns=True)


@query("""with r as (select doc_id//2 as id, doc_id%3 as file, doc_id as row, lang as value from documents)
select id, arg_max(value, (file, row)) as value from r group by id""")
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    r = fx.table(spark, sf_dir, "documents").select(F.floor(i / 2).alias("id"), (i % 3).alias("file"), i.alias("row"), F.col("lang").alias("value"))
    return index.newest(r, ["file", "row"]).select("id", "value")


@query("""with s as (select page_id, case page_id%4 when 0 then concat('https://x.org/d/', printf('%04d', page_id), '.tar?download=1') when 1 then concat('/data/', printf('%04d', page_id), '.tar') when 2 then concat('hf://datasets/a/b/', page_id, '.tar') else url end as source from pages)
select page_id, source, nullif(regexp_extract(regexp_replace(source, '[?#].*$', ''), '(?:^|/)(\\d{4})(?:\\.[^./]*)?$', 1), '') as bucket from s""")
def shard_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("page_id"), F.format_string("%04d", "page_id")
    source = F.when(i % 4 == 0, F.concat(F.lit("https://x.org/d/"), n, F.lit(".tar?download=1"))).when(i % 4 == 1, F.concat(F.lit("/data/"), n, F.lit(".tar"))).when(i % 4 == 2, F.concat(F.lit("hf://datasets/a/b/"), i.cast("string"), F.lit(".tar"))).otherwise(F.col("url"))
    return fx.table(spark, sf_dir, "pages").select(i, source.alias("source")).withColumn("bucket", paths.shard_bucket(F.col("source")))


@query(f"""with {fx.POSTS}, {INDEX}, shards as (select distinct bucket as name from idx)
select i.bucket, count(*) as n, min(id) as least from idx i join shards on bucket = name group by i.bucket""")
def shard_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = index.build(fx.posts(spark, sf_dir), MODULUS)
    shards = idx.select(F.concat(F.lit("/data/"), "bucket", F.lit(".tar")).alias("source")).distinct()
    joined = shards.select(paths.shard_bucket(F.col("source")).alias("bucket")).join(idx, "bucket")
    return joined.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


@query(f"with {fx.POSTS}, {INDEX} select bucket from idx union select printf('%04d', id%50) from posts")
def bucket_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of buckets that have a directory or a file of their own."""
    posts = fx.posts(spark, sf_dir)
    files = posts.select(paths.shard_bucket(F.concat(F.lit("/index/"), F.format_string("%04d", F.col("id") % 50), F.lit(".parquet"))).alias("bucket"))
    return index.build(posts, MODULUS).select("bucket").union(files).distinct()


@query(f"with {fx.POSTS}, {INDEX} select bucket, count(*) as n, min(id) as least, 2::bigint as version, 'posts' as source, 'posts.parquet' as file, (select count(*) from idx) as rows_stated, true as usable, false as other from idx group by bucket")
def published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index put in the place of an older one; what its manifest states and what readers find."""
    at, rows = scratch(spark), index.build(fx.posts(spark, sf_dir), MODULUS)
    store.publish(spark, rows.where("id % 2 = 0"), at, "posts", "older.parquet")
    store.publish(spark, rows, at, "posts", "posts.parquet")
    m = store.manifest_of(spark, at)
    usable, other = store.published(spark, at, "posts", 30, 50, "posts.parquet"), store.published(spark, at, "posts", 30, 50, "older.parquet")
    per = index.read(spark, at).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    return per.withColumns({"version": F.lit(m["version"]).cast("bigint"), "source": F.lit(m["source"]), "file": F.lit(m["file"]), "rows_stated": F.lit(m["rows"]).cast("bigint"), "usable": F.lit(usable), "other": F.lit(other)})
