"""Batches, blocks, groups, cursors and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import fixtures as fx
from tagloom.functions import geometry as g
from tagloom.functions.numeric import rounded
from tagloom.operators import batching
from tagloom.plans import query
from tagloom.plans.captions import u
from tagloom.plans.geometry import chosen, chosen_sql

BLOCK, BATCH, ACCUMULATE = 64, 4, 8
SAMPLES = f"{fx.POSTS}, {chosen_sql(768)}, samples as (select id, id//100 as shard_index, id%100 as sample_index, concat(bw,'x',bh) as bucket from chosen)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chosen(fx.posts(spark, sf_dir), 768)
    return c.select("id", F.floor(F.col("id") / 100).alias("shard_index"), (F.col("id") % 100).alias("sample_index"), g.key(F.col("b.width"), F.col("b.height")).alias("bucket"))


@query(f"""with {SAMPLES}, n as (select *, row_number() over (partition by bucket order by {u("'batch'", "'9'", "id::varchar")}, id) as place from samples),
b as (select bucket, (place-1)//{BATCH} as batch_no, list(id order by place) as sample_ids from n group by all)
select bucket, batch_no, sample_ids, round({u("'order'", "'9'", "bucket", "batch_no::varchar")}, 9) as batch_order from b where len(sample_ids)={BATCH}""")
def bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.bucket_batches(samples(spark, sf_dir), BATCH, 7, 2).withColumn("batch_order", rounded("batch_order", 9))


BLOCKS = f"blocks as (select *, row_number() over (order by shard_index, sample_index)-1 as position, (row_number() over (order by shard_index, sample_index)-1)//{BLOCK} as block from samples)"


@query(f"with {SAMPLES}, {BLOCKS} select * from blocks")
def rolling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.rolling_blocks(samples(spark, sf_dir), BLOCK)


# the groups by a walk over (block, bucket) in order, one row a step; held, given: what each bucket has seen and given
GROUPS = f"""{BLOCKS}, names as (select list(bucket order by bucket) as names from (select distinct bucket from samples)),
counts as (select k.block, list(coalesce(c.n, 0) order by n.bucket) as fresh from (select distinct block from blocks) k cross join (select distinct bucket from samples) n left join (select block, bucket, count(*) as n from blocks group by all) c on c.block=k.block and c.bucket=n.bucket group by k.block),
walk as (select -1::bigint as block, list_transform(names, lambda x: 0::bigint) as held, list_transform(names, lambda x: 0::bigint) as given, list_transform(names, lambda x: 0::bigint) as prior from names
 union all select block, held, list_transform(range(1, len(held)+1), lambda i: (given[i] + greatest(0, least(whole[i], usable - coalesce(list_sum(whole[1:i-1]), 0))))::bigint), given from (
  select *, (list_sum(whole)::bigint//{ACCUMULATE})*{ACCUMULATE} as usable from (
   select block, held, given, list_transform(range(1, len(held)+1), lambda i: held[i]//{BATCH}-given[i]) as whole from (
    select c.block, list_transform(range(1, len(w.held)+1), lambda i: (w.held[i]+c.fresh[i])::bigint) as held, w.given from walk w join counts c on c.block=w.block+1)))),
taken as (select w.block as taken_at, names[i] as b, prior[i] as lo, given[i] as hi, sum(given[i]-prior[i]) over (order by w.block, names[i]) - (given[i]-prior[i]) as first from walk w, names, (select unnest(range(1, 8)) as i) where w.block>=0 and i<=len(names) and given[i]>prior[i]),
numbered as (select *, (row_number() over (partition by bucket order by position)-1)//{BATCH} as g from blocks),
grouped as (select n.* exclude (g), t.taken_at as emitted_block, (t.first+n.g-t.lo)::bigint as group_no from numbered n left join taken t on n.bucket=t.b and n.g>=t.lo and n.g<t.hi)"""


@query(f"with recursive {SAMPLES}, {GROUPS} select * from grouped")
def microbatch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.groups(samples(spark, sf_dir), BLOCK, BATCH, ACCUMULATE)


@query(f"""with recursive {SAMPLES}, {GROUPS}, per as (select group_no, emitted_block as k, max(shard_index*100000+sample_index) as high from grouped where group_no is not null group by all),
c as (select p.group_no, max(high) over (order by p.group_no) as trained, (select min(shard_index*100000+sample_index) from grouped s where s.block<=p.k and (s.emitted_block is null or s.emitted_block>p.k or (s.emitted_block=p.k and s.group_no>p.group_no))) as first from per p)
select group_no, coalesce(first, trained)//100000 as shard_index, case when first is not null then first%100000-1 else trained%100000 end as sample_index from c""")
def safe_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.safe_cursors(batching.groups(samples(spark, sf_dir), BLOCK, BATCH, ACCUMULATE))


@query(f"with recursive {SAMPLES}, {GROUPS} select bucket, count(*) as dropped from grouped where group_no is null group by bucket")
def epoch_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.groups(samples(spark, sf_dir), BLOCK, BATCH, ACCUMULATE).where("group_no is null").groupBy("bucket").agg(F.count(F.lit(1)).alias("dropped"))


@query(f"with recursive {SAMPLES}, {GROUPS} select group_no, count(*) as size, count(distinct bucket)=1 as homogeneous from grouped where group_no is not null group by group_no")
def mixed_bucket_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.groups(samples(spark, sf_dir), BLOCK, BATCH, ACCUMULATE).where("group_no is not null").groupBy("group_no").agg(F.count(F.lit(1)).alias("size"), (F.count_distinct("bucket") == 1).alias("homogeneous"))


@query(f"""select doc_id, doc_id//32 as run, (doc_id//32)*32 + row_number() over (partition by doc_id//32 order by {u("'buffer'", "'4'", "doc_id::varchar")}, doc_id)-1 as place from documents""")
def buffered_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.buffered_order(fx.table(spark, sf_dir, "documents").select("doc_id"), 32, 4, "doc_id")


SHARDS = "shards as (select distinct concat('/data/', printf('%04d', doc_id//10), '.tar') as source from documents)"


@query(f"with {SHARDS} select source, row_number() over (order by md5(concat('7|2|', source)), source)-1 as place from shards")
def shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.shard_order(shards(spark, sf_dir), 7, 2)


@query(f"with {SHARDS}, o as (select source, row_number() over (order by md5(concat('7|2|', source)), source)-1 as place from shards) select * from o where place%4=1")
def worker_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.worker_share(batching.shard_order(shards(spark, sf_dir), 7, 2), 1, 4)


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("/data/"), F.format_string("%04d", F.floor(F.col("doc_id") / 10)), F.lit(".tar"))
    return fx.table(spark, sf_dir, "documents").select(name.alias("source")).distinct()


@query("select event_id as batch_no, 4 as size, event_id//7 as text_window, ((event_id%7)*4)//8 as encoder_batch from events")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_no"), F.lit(4).alias("size"))
    return batching.text_windows(b, 26, 8)


@query("""with recursive s as (select event_id as batch_no, event_id*event_id%7 as size, sum(event_id*event_id%7) over (order by event_id)::bigint - event_id*event_id%7 as past from events),
w as (select min(batch_no) as start, 0::bigint as text_window, 0::bigint as past from s
 union all select n.batch_no, n.text_window, n.past from (select min(s.batch_no) as batch_no, w.text_window + 1 as text_window, min(s.past) as past from w join s on s.past >= w.past + 40 group by w.text_window) n where n.batch_no is not null)
select s.batch_no, s.size, w.text_window, (s.past - w.past)//8 as encoder_batch from s asof join w on s.batch_no >= w.start""")
def ragged_text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return batching.text_windows(fx.table(spark, sf_dir, "events").select(i.alias("batch_no"), (i * i % 7).alias("size")), 40, 8)


@query(f"with {SAMPLES} select bucket, (row_number() over (partition by bucket order by id)-1)//16 as encode_batch, id from samples")
def encode_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.encode_batches(samples(spark, sf_dir), 16).select("bucket", "encode_batch", "id")


@query(f"with {fx.MEMBERS}, s as (select shard_index, name, member_ord, nbytes, sum(nbytes) over (partition by shard_index order by member_ord)::bigint as upto from members) select *, upto<=100000 as fits from s")
def cache_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.cache_budget(fx.members(spark, sf_dir), 100000, "member_ord")


@query(f"with {fx.POSTS} select id//4 as batch_no, count(*) as samples, true as rating, bool_and(id%50<>7) as score, bool_and(id%11=0) as meta, false as is_banned from posts group by 1")
def batch_optional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.posts(spark, sf_dir).select(F.floor(F.col("id") / 4).alias("batch_no"), "rating", F.when(F.col("id") % 50 != 7, F.col("score")).alias("score"), F.nullif("tag_string_meta", F.lit("")).alias("meta"), "is_banned")
    return batching.present_in_all(p, ["batch_no"], ["rating", "score", "meta", "is_banned"])


@query("select row_number() over (order by doc_id)-1 as ord, doc_id, lang as mate from documents")
def ordered_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beside what was made of them elsewhere, in their order and none without the other."""
    from tagloom.operators.ingest import global_ordinals, zipped

    d = fx.table(spark, sf_dir, "documents").withColumn("part", F.floor(F.col("doc_id") / 100))
    numbered = global_ordinals(d.select("part", "doc_id"), "part", ["doc_id"], "ord").drop("part")
    made = global_ordinals(d.select("part", F.col("doc_id").alias("key"), F.col("lang").alias("mate")).repartition(3), "part", ["key"], "ord").select("ord", "mate")
    return zipped(numbered, made, "ord")


#: Turns of encoding and training in which ``rolling_stream`` goes over a table, however large; a small one takes five shards a turn.
TURNS = 4


def shards_a_turn(shards: int) -> int:
    return max(5, -(-shards // TURNS))


TILES = "samples as (select doc_id as id, doc_id//100 as shard_index, doc_id%100 as sample_index, ['16x16','16x32','32x16'][doc_id*doc_id%3+1] as bucket from documents)"


@query(f"""with recursive {TILES}, {GROUPS}, per as (select group_no, emitted_block as k, max(shard_index*100000+sample_index) as high from grouped where group_no is not null group by all),
c as (select p.group_no, max(high) over (order by p.group_no) as trained, (select min(shard_index*100000+sample_index) from grouped s where s.block<=p.k and (s.emitted_block is null or s.emitted_block>p.k or (s.emitted_block=p.k and s.group_no>p.group_no))) as first from per p)
select g.group_no, g.shard_index, g.sample_index, g.bucket, coalesce(first, trained)//100000 as resume_shard_index, case when first is not null then first%100000-1 else trained%100000 end as resume_sample_index, g.id%32/8.0::double as value from grouped g join c using (group_no)""")
def rolling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as shards of tiles, streamed in turns of encoding and training; the first run is broken off and a second one goes on."""
    from tagloom.sources import archives, shared
    from tagloom.streaming import latents
    from tagloom.streaming.rolling import Rolling

    root, i = shared.new_dir(spark, "rolling"), F.col("doc_id")
    odd = (i * i % 3).cast("int") + 1
    side = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), odd)
    tiles = fx.table(spark, sf_dir, "documents").select(F.format_string("%06d.tar", F.floor(i / 100)).alias("archive"), i.alias("ord"), F.format_string("%09d", i).alias("sample_id"), side("16x16", "16x32", "32x16").alias("bucket"), F.array(F.lit(1), side(16, 32, 16), side(16, 16, 32)).alias("latent_shape"), (i % 32 / 8).alias("v"))
    pixels = F.array_repeat(F.col("v").cast("float"), F.element_at("latent_shape", 2) * F.element_at("latent_shape", 3))
    rows = tiles.withColumn("latent", pixels).withColumn("metadata", F.to_json(F.struct("bucket")))
    archives.write(archives.latent_members(rows, "ord"), f"{root}/shards", archives.LATENT_ORDER)
    shards = sorted(r["path"] for r in archives.archive_paths(spark, f"{root}/shards").collect())  # a row a shard
    broken = []

    def break_off(out: DataFrame, batch_id: int) -> None:
        if not broken:
            broken.append(batch_id)
            raise RuntimeError("broken off on purpose")

    def run(consume) -> Rolling:
        rolling = Rolling(f"{root}/state", BLOCK, BATCH, ACCUMULATE, consume=consume)
        stream = latents.latent_stream(spark, shards, checkpoint=f"{root}/checkpoint", shards_per_batch=shards_a_turn(len(shards)), shuffle=False)
        samples_ = stream.select("shard_index", "sample_index", F.get_json_object("metadata", "$.bucket").alias("bucket"), F.col("latent").alias("pixels"), "shape")
        q = samples_.writeStream.foreachBatch(rolling).option("checkpointLocation", f"{root}/checkpoint").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return rolling

    try:
        run(break_off)
    except Exception as error:
        if "broken off on purpose" not in str(error):
            raise
    rolling = run(None)
    rolling.finish(spark)
    return rolling.output(spark).select("group_no", "shard_index", "sample_index", "bucket", "resume_shard_index", "resume_sample_index", F.element_at("latent", 1).cast("double").alias("value"))
