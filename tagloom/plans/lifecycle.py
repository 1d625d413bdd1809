"""Checkpoints, schedules, configuration and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import fixtures as fx
from tagloom.functions import paths
from tagloom.functions.numeric import rounded
from tagloom.operators import lifecycle, preflight
from tagloom.plans import query
from tagloom.sources import shared, store
from tagloom.streaming import metrics


@query(f"with {fx.CHECKPOINTS} select root, name, step from checkpoints where has_model and has_state")
def ckpt_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.checkpoints(spark, sf_dir)
    files = c.select("root", "name", "step", F.explode(F.array(F.when(F.col("has_model"), lifecycle.REQUIRED[0]), F.when(F.col("has_state"), lifecycle.REQUIRED[1]), F.lit("extra.json"))).alias("file")).where("file is not null")
    return lifecycle.complete_from_files(files).join(c, ["root", "name"]).select("root", "name", "step")


@query(f"with {fx.CHECKPOINTS} select root, name, step from checkpoints where has_model and has_state order by step desc, root='local' desc limit 1")
def resume_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.newest(fx.checkpoints(spark, sf_dir))


@query(f"with {fx.CHECKPOINTS}, r as (select *, row_number() over (partition by root order by step desc) as newer from checkpoints where has_model and has_state) select root, name from r where newer>3 and name not in ('step-00000500')")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.removable(fx.checkpoints(spark, sf_dir), 3, ["step-00000500"]).select("root", "name")


@query("select event_id, case event_id%3 when 0 then event_id else -1 end as step from events")
def checkpoint_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    name = F.when(i % 3 == 0, F.concat(F.lit("/out/"), F.format_string("step-%08d", i))).when(i % 3 == 1, "latest").otherwise(F.concat(F.lit("step-x"), i.cast("string")))
    return fx.table(spark, sf_dir, "events").select(i, paths.checkpoint_step(name).alias("step"))


@query("select event_id, event_id>0 and event_id%10=0 as log, event_id>0 and event_id%250=0 as save, false as preview from events")
def schedule_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fx.table(spark, sf_dir, "events").select(i, lifecycle.due(i, 10).alias("log"), lifecycle.due(i, 250).alias("save"), lifecycle.due(i, 0).alias("preview"))


@query("select event_id, event_id//16 as step, event_id%16=0 as boundary from events")
def step_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", lifecycle.counters(F.col("event_id"), 16).alias("c")).select("event_id", "c.*")


@query("""with l as (select event_id+1 as step, value as loss, value/2 as grad_norm, 16 as samples, 1.0+event_id%3 as seconds, 0.25*(event_id%9) as wait from events)
select (step-1)//50 as window, max(step) as step, round(avg(loss),6) as mean_loss, round(arg_max(grad_norm, step),6) as grad_norm, round(sum(samples)/sum(seconds),6)::double as samples_per_second, round(least(sum(wait)/sum(seconds),1.0),6)::double as wait_ratio from l group by 1""")
def log_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    log = fx.table(spark, sf_dir, "events").select((i + 1).alias("step"), F.col("value").alias("loss"), (F.col("value") / 2).alias("grad_norm"), F.lit(16).alias("samples"), (1.0 + i % 3).alias("seconds"), (0.25 * (i % 9)).alias("wait"))
    m = lifecycle.window_metrics(log, 50)
    return m.select("window", "step", *[rounded(c, 6).alias(c) for c in ("mean_loss", "grad_norm", "samples_per_second", "wait_ratio")])


@query("select doc_id as batch_no, 2 as epoch, doc_id//100 as shard_index, case when doc_id%2=0 then doc_id%100-1 else doc_id%100 end as sample_index from documents")
def cursor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    shard, sample = F.floor(i / 100), i % 100
    b = fx.table(spark, sf_dir, "documents").select(i.alias("batch_no"), F.array(F.lit(2), F.lit(2)).alias("stream_epoch"), F.array(shard, shard).alias("source_shard_index"), F.array(sample, sample + 1).alias("source_sample_index"), F.when(i % 2 == 0, F.array(shard, shard)).alias("resume_shard_index"), F.when(i % 2 == 0, F.array(sample - 1, sample)).alias("resume_sample_index"))
    return lifecycle.cursor_of(b)


@query("select event_id, 'base' as a, case when event_id%2=0 then 'over' else 'base' end as b, case when event_id%2=0 then event_id::varchar end as c from events")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit("base"))
    over = F.when(i % 2 == 0, F.create_map(F.lit("b"), F.lit("over"), F.lit("c"), i.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    m = fx.table(spark, sf_dir, "events").select(i, lifecycle.merge_maps(base, over).alias("m"))
    return m.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("select event_id, list_filter(['depth','width','rate'], lambda k: not (k='depth' or (k='width' and event_id%2=0) or (k='rate' and event_id%3=0))) as unknown from events")
def config_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    known = F.filter(F.array(F.lit("depth"), F.when(i % 2 == 0, "width"), F.when(i % 3 == 0, "rate")), lambda x: x.isNotNull())
    return fx.table(spark, sf_dir, "events").select(i, F.array_except(F.array(F.lit("depth"), F.lit("width"), F.lit("rate")), known).alias("unknown"))


@query("""with c as (select event_id, event_id%70 as block, event_id%9 as accumulate, event_id%5 as batch, 1+event_id%2 as prefetch, event_id%3-0.5 as upscale from events)
select event_id, list_filter([case when block<1 or batch<1 or accumulate<1 then 'positive' end, case when prefetch<>1 then 'prefetch' end, case when block%greatest(accumulate,1)<>0 then 'block' end, case when accumulate%greatest(batch,1)<>0 then 'boundary' end, case when upscale<=0 then 'upscale' end], lambda x: x is not null) as errors from c""")
def rolling_settings_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fx.table(spark, sf_dir, "events").select(i, lifecycle.rolling_errors(i % 70, i % 9, i % 5, 1 + i % 2, i % 3 - 0.5).alias("errors"))


@query("""with c as (select event_id, event_id%7<>0 as enabled, event_id%4 as every, case when event_id%5=0 then []::varchar[] when event_id%5=1 then ['a',' '] else ['a'] end as prompts, 32*(event_id%3) as width, 16*(event_id%5) as height, event_id%6 as steps, event_id%8-1.0 as scale, ['euler','heun','rk4'][event_id%3+1] as solver from events)
select event_id, case when enabled then list_filter([case when every<1 then 'every_steps' end, case when len(prompts)=0 or len(list_filter(prompts, lambda p: trim(p)=''))>0 then 'prompts' end, case when width<32 or height<32 or width%32<>0 or height%32<>0 then 'size' end, case when steps<1 then 'steps' end, case when scale<0 then 'guidance' end, case when solver not in ('euler','heun') then 'solver' end], lambda x: x is not null) else []::varchar[] end as errors from c""")
def preview_settings_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    prompts = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 == 1, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a")))
    solver = F.element_at(F.array(F.lit("euler"), F.lit("heun"), F.lit("rk4")), (i % 3).cast("int") + 1)
    return fx.table(spark, sf_dir, "events").select(i, lifecycle.preview_errors(i % 7 != 0, i % 4, prompts, 32 * (i % 3), 16 * (i % 5), i % 6, i % 8 - 1.0, solver).alias("errors"))


@query("""with c as (select event_id as i, event_id%7 as b7, event_id%5 as b5, event_id%11 as b11 from events),
s as (select i::varchar as run, case when b7<4 then 'rolling_raw' when b7<6 then 'streaming_tar' else 'manifest' end as backend, case when b5=0 then 'flash_attention_2' else 'sdpa' end as attention, i%2=0 as there,
 i%3=0 as checkpointing, i%13=0 as tracking, i%4=0 as login, b5-1 as acc, b7 as batch, (i%9)*12 as block, 1+(i%6=0)::int as prefetch, i%17 as cache, case b11 when 0 then 'none' when 1 then 'hub' when 2 then 'lost' when 3 then 'http' else 'here' end as shards,
 i%19=0 as token, 1+i%3 as version, 880+i%260 as buckets, 880+i%300 as files, ['adamw','AdamW8bit','sgd'][i%3+1] as opt, i%8=0 as eight, i%10<5 as fallback, case when i%23=0 then 'int8' when i%23<12 then 'fp16' end as precision, i*1000 as free, case when i%29<9 then i%2=0 end as mirror from c),
k as (select run, unnest([
 {'ord': 0, 'name': 'attention', 'level': case when attention='flash_attention_2' then case when there then 'ok' else 'error' end end},
 {'ord': 1, 'name': 'gradient checkpointing', 'level': case when checkpointing then 'warning' else 'ok' end},
 {'ord': 2, 'name': 'backend', 'level': case when backend='manifest' then 'error' else 'ok' end},
 {'ord': 3, 'name': 'tracking', 'level': case when tracking then case when login then 'ok' else 'warning' end end},
 {'ord': 4, 'name': 'gradient accumulation', 'level': case when acc<1 then 'error' end},
 {'ord': 5, 'name': 'rolling block', 'level': case when backend='rolling_raw' and acc>=1 then case when batch>=1 and block>=1 and block%greatest(batch*acc,1)=0 then 'ok' else 'error' end end},
 {'ord': 6, 'name': 'prefetch', 'level': case when backend='rolling_raw' and acc>=1 and prefetch<>1 then 'error' end},
 {'ord': 7, 'name': 'text cache', 'level': case when backend='rolling_raw' and acc>=1 and (cache<1 or cache%greatest(batch,1)<>0) then 'error' end},
 {'ord': 8, 'name': 'shards', 'level': case when shards in ('none','lost') then 'error' else 'ok' end},
 {'ord': 9, 'name': 'token', 'level': case when shards='hub' and not token then 'warning' end},
 {'ord': 10, 'name': 'index', 'level': case when backend='rolling_raw' then case when version=2 and there and buckets between 900 and 1100 and files>=buckets then 'ok' else 'error' end end},
 {'ord': 11, 'name': 'optimizer', 'level': case opt when 'adamw' then 'ok' when 'sgd' then 'error' else case when eight then 'ok' when fallback then 'warning' else 'error' end end},
 {'ord': 12, 'name': 'precision', 'level': case precision when 'fp16' then 'ok' when 'int8' then 'error' end},
 {'ord': 13, 'name': 'disk', 'level': case when free >= 500000 + batch*1000 then 'ok' else 'error' end},
 {'ord': 14, 'name': 'mirror', 'level': case when mirror then 'ok' when not mirror then 'warning' end}]) as c from s)
select run, c.ord, c.level, c.name from k where c.level is not null""")
def preflight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a run's settings, all checks over all of them."""
    i = F.col("event_id")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (i % len(names)).cast("int") + 1)
    array = lambda *xs: F.array(*map(F.lit, xs))
    shards = F.when(i % 11 == 0, F.array().cast("array<string>")).when(i % 11 == 1, array("hf://datasets/a/b/c.tar")).when(i % 11 == 2, array("a.tar", "lost.tar")).when(i % 11 == 3, array("https://x.org/a.tar")).otherwise(array("a.tar"))
    runs = fx.table(spark, sf_dir, "events").select(
        i.cast("string").alias("run"), F.when(i % 7 < 4, "rolling_raw").when(i % 7 < 6, "streaming_tar").otherwise("manifest").alias("backend"),
        F.when(i % 5 == 0, "flash_attention_2").otherwise("sdpa").alias("attention"), (i % 2 == 0).alias("attention_there"), (i % 3 == 0).alias("checkpointing"),
        (i % 13 == 0).alias("tracking"), (i % 4 == 0).alias("tracking_login"), (i % 5 - 1).alias("accumulation"), (i % 7).alias("batch_size"), (i % 9 * 12).alias("rolling_block"),
        F.when(i % 6 == 0, 2).otherwise(1).alias("prefetch"), (i % 17).alias("text_cache"), shards.alias("shards"), array("a.tar").alias("shards_there"), (i % 19 == 0).alias("token"),
        (1 + i % 3).alias("index_version"), (i % 2 == 0).alias("index_source"), (880 + i % 260).alias("index_buckets"), (880 + i % 300).alias("index_files"),
        pick("adamw", "AdamW8bit", "sgd").alias("optimizer"), (i % 8 == 0).alias("eight_bit"), (i % 10 < 5).alias("fallback"), F.when(i % 23 == 0, "int8").when(i % 23 < 12, "fp16").alias("precision"),
        (i * 1000).alias("free_bytes"), F.lit(500000).alias("least_free"), (i % 7 * 1000).alias("cache_bytes"), F.when(i % 29 < 9, "/mirror").alias("mirror"), (i % 2 == 0).alias("mirror_there"),
    )
    return preflight.preflight(runs)


@query("""select name, value from (select count(*)::double as n_rows, sum(n_chars)::double as chars, max(n_chars)::double as longest, count(distinct lang)::double as langs, 1.0::double as same_run from documents)
unpivot (value for name in (n_rows, chars, longest, langs, same_run))""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures observed while the documents are written, under a run id that a second log finds again."""
    root = shared.new_dir(spark, "run")
    log = metrics.RunLog(spark, root)
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    out = log.written(docs, f"{root}/documents", 1, n_rows=F.count(F.lit(1)), chars=F.sum("n_chars"), longest=F.max("n_chars"))
    again = metrics.RunLog(spark, root)
    again.written(out.select("lang").distinct(), f"{root}/langs", 2, langs=F.count("lang"))
    again.record(3, {"same_run": again.run_id == log.run_id})
    return again.table().select("name", "value")


@query("with c as (select event_id%5 as part, case event_id%9 when 0 then 'error' when 1 then 'warning' else 'ok' end as level from events) select count(*) filter (level='error') as errors, count(*) filter (level='warning') as warnings, count(*) filter (level='error')=0 as ok from c")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    c = fx.table(spark, sf_dir, "events").select(F.when(i % 9 == 0, "error").when(i % 9 == 1, "warning").otherwise("ok").alias("level"))
    return lifecycle.report(c)


@query("select vec_id, round(list_sum(embedding::double[]), 6) as total, 20::bigint as step, 'mirror' as root from embeddings")
def checkpoint_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights saved twice, copied to a second root and pruned; the run resumes from the mirror, where the newest is."""
    at = shared.new_dir(spark, "checkpoints")
    weights = fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    with store.Mirror(spark, f"{at}/mirror", keep=1) as mirror:
        for step in (10, 20):
            saved = store.save_state(spark, f"{at}/local", step, weights, {"epoch": step // 10}, keep=2)
            mirror.submit(saved)
    store.delete(spark, f"{at}/local/step-00000020")
    found = store.resume_path(spark, "auto", [f"{at}/local", f"{at}/mirror"])
    model, state = store.load_model(spark, found)
    total = rounded(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6)
    return model.select("vec_id", total.alias("total"), F.lit(state["step"]).cast("bigint").alias("step"), F.lit(found.split("/")[-2]).alias("root"))
