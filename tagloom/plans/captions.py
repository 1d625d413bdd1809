"""Tags, captions, seeds and dropout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import fixtures as fx
from tagloom.functions import tags
from tagloom.operators import textcache
from tagloom.plans import query


def u(*parts: str) -> str:
    """DuckDB SQL of ``functions.rand.uniform``."""
    return f"(('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,8))::bigint/4294967296.0::double)"


ODD = "s as (select id, case id%4 when 0 then replace(tag_string_general,' ',', ') when 1 then concat('  ',tag_string_general,' ') when 2 then concat('a b,',tag_string_character,',,') end as value from posts)"


@query(rf"""with {fx.POSTS}, {ODD} select id, case when value is null then []::varchar[]
 else list_filter(list_transform(case when contains(value,',') then string_split(value,',') else regexp_split_to_array(value,'\s+') end, lambda x: trim(x)), lambda x: x<>'') end as tags from s""")
def as_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("id"), F.col("tag_string_general")
    v = F.when(i % 4 == 0, F.replace(t, F.lit(" "), F.lit(", "))).when(i % 4 == 1, F.concat(F.lit("  "), t, F.lit(" "))).when(i % 4 == 2, F.concat(F.lit("a b,"), F.col("tag_string_character"), F.lit(",,")))
    return fx.posts(spark, sf_dir).select("id", tags.as_tags(v).alias("tags"))


SPLIT = r"""t as (select *, list_filter(regexp_split_to_array(tag_string_general,'\s+'), lambda x: x<>'') as g, list_filter(regexp_split_to_array(tag_string_character,'\s+'), lambda x: x<>'') as c,
 list_filter(regexp_split_to_array(tag_string_copyright,'\s+'), lambda x: x<>'') as y, list_filter(regexp_split_to_array(tag_string_artist,'\s+'), lambda x: x<>'') as a, list_filter(regexp_split_to_array(tag_string_meta,'\s+'), lambda x: x<>'') as m,
 case when id%5=0 then 'best' when id%5=1 then 'low quality' else '' end as quality from posts)"""


def caption_sql(general: str, character: str, most: int) -> str:
    """DuckDB SQL of a caption from arrays; repeated tags stay at their first place."""
    every = f"""list_concat(list_concat(list_concat(list_concat(list_concat(list_concat(
 case when quality<>'' then [case when contains(quality,'quality') then quality else concat(quality,' quality') end] else []::varchar[] end,
 [case when starts_with(rating,'rating:') then rating else concat('rating:',rating) end]), list_transform(a, lambda x: concat('artist:',x))), {character}), y), {general}), m)"""
    return f"""select id, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x)=i)[1:{most}], lambda x: replace(x,'_',' ')),', ') as caption from (select id, {every} as l from t)"""


def split(p: DataFrame) -> DataFrame:
    i = F.col("id")
    quality = F.when(i % 5 == 0, "best").when(i % 5 == 1, "low quality").otherwise("")
    kinds = {"g": "general", "c": "character", "y": "copyright", "a": "artist", "m": "meta"}
    return p.withColumns({k: tags.as_tags(F.col(f"tag_string_{v}")) for k, v in kinds.items()} | {"quality": quality})


def captioned(p: DataFrame, options: tags.CaptionOptions, *seed) -> DataFrame:
    cols = [F.col(c) for c in ("g", "c", "y", "a", "m", "rating", "quality")]
    return split(p).select("id", tags.caption(*cols, seed=seed, options=options).alias("caption"))


@query(f"with {fx.POSTS}, {SPLIT} {caption_sql('g', 'c', 9)}")
def caption_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captioned(fx.posts(spark, sf_dir), tags.CaptionOptions(0.0, 0.0, False, 9))


DROPPED = f"""d as (select * replace (
 list_filter(g, lambda x, i: {u("'g'", "'5'", "id::varchar", "(i-1)::varchar")} >= 0.25) as g,
 list_filter(c, lambda x, i: {u("'c'", "'5'", "id::varchar", "(i-1)::varchar")} >= 0.5) as c) from t),
sh as (select * replace (list_transform(list_sort(list_transform(g, lambda x, i: {{'u': {u("'s'", "'5'", "id::varchar", "(i-1)::varchar")}, 'i': i, 'x': x}})), lambda e: e.x) as g) from d)"""


@query(f"with {fx.POSTS}, {SPLIT}, {DROPPED} {caption_sql('g', 'c', 128).replace('from t)', 'from sh)')}")
def caption_dropout_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captioned(fx.posts(spark, sf_dir), tags.CaptionOptions(0.25, 0.5), 5, F.col("id"))


@query("select doc_id, 17+3*2000003+(doc_id//100)*7919+(doc_id%100)*104729 as caption, 17+3*1000003+(doc_id//100)*9176+2 as stream, 17+3*2000003+(doc_id//100)*7919+2 as stream_caption, 17+3*1000003+(doc_id//100)*9176+(doc_id%100)*104729 as guidance from documents")
def caption_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    seed, epoch, shard, sample = F.lit(17), F.lit(3), F.floor(i / 100), i % 100
    return fx.table(spark, sf_dir, "documents").select(i, tags.caption_seed(seed, epoch, shard, sample).alias("caption"), tags.stream_seed(seed, epoch, shard, F.lit(2)).alias("stream"), tags.stream_caption_seed(seed, epoch, shard, F.lit(2)).alias("stream_caption"), tags.guidance_seed(seed, epoch, shard, sample).alias("guidance"))


@query(f"select doc_id, case when {u(chr(39)+'cfg'+chr(39), '(17+3*1000003+(doc_id//100)*9176+(doc_id%100)*104729)::varchar')} < 0.3 then '' else lang end as caption from documents")
def cfg_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    seed = tags.guidance_seed(F.lit(17), F.lit(3), F.floor(i / 100), i % 100)
    return fx.table(spark, sf_dir, "documents").select(i, tags.guidance_dropout(F.col("lang"), 0.3, seed).alias("caption"))


@query(f"""with {fx.POSTS}, r as (select id, case when id%3=0 then 'a plain caption' end as caption, case when id%2=0 then tag_string_general end as general, id%2=0 as has_key from posts)
select id, case when coalesce(caption,'')<>'' or coalesce(general,'')<>'' then 'tags' else 'caption' end as rolling, case when has_key then 'tags' when caption is not null then 'caption' else 'none' end as stream from r""")
def caption_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text, general = F.when(i % 3 == 0, "a plain caption"), F.when(i % 2 == 0, F.col("tag_string_general"))
    rolling = F.when(tags.has_caption(text, general), "tags").otherwise("caption")
    stream = F.when(i % 2 == 0, "tags").when(text.isNotNull(), "caption").otherwise("none")
    return fx.posts(spark, sf_dir).select("id", rolling.alias("rolling"), stream.alias("stream"))


@query(f"""with {fx.POSTS}, c as (select id//4 as batch_no, id, regexp_split_to_array(trim(tag_string_general), '\\s+')[1:32] as w from posts),
n as (select batch_no, max(len(w)) as longest, list(w order by id) as ws from c group by 1)
select batch_no, ((batch_no*4)//64)::bigint as text_window, list_transform(ws, lambda w: list_transform(range(0, longest), lambda j: case when j < len(w) then [len(w[j+1])::double, j::double] else [0.0::double, 0.0::double] end)) as states,
 list_transform(ws, lambda w: list_transform(range(0, longest), lambda j: j < len(w))) as mask from n""")
def text_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of four posts a batch, sixteen batches encoded together."""
    p = fx.posts(spark, sf_dir).groupBy(F.floor(F.col("id") / 4).alias("batch_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "tag_string_general"))), lambda x: x["tag_string_general"]).alias("captions"))
    made = textcache.text_states(p, window=64, encode=24)
    return made.withColumn("states", F.col("states").cast("array<array<array<double>>>"))
