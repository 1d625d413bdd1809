"""Numeric kernels of flow matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import fixtures as fx
from tagloom.functions import numeric as n
from tagloom.plans import query
from tagloom.plans.captions import u


def rounded(c, digits: int = 6):
    return F.transform(c, lambda x: n.rounded(x, digits) + 0.0)


def r(expr: str, digits: int = 6) -> str:
    return f"list_transform({expr}, lambda q: round(q, {digits}) + 0.0)"


@query(f"with {fx.LATENTS} select vec_id, {r('list_transform(list_zip(clean, noise), lambda z: (1.0-t)*z[1]+t*z[2])')} as x from latents")
def flow_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.lerp(F.col("clean"), F.col("noise"), F.col("t"))).alias("x"))


@query(f"with {fx.LATENTS} select vec_id, {r('list_transform(list_zip(clean, noise), lambda z: z[2]-z[1])')} as v from latents")
def flow_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.velocity(F.col("clean"), F.col("noise"))).alias("v"))


@query(f"with {fx.LATENTS} select vec_id%7 as part, round(avg(list_sum(list_transform(list_zip(clean, noise), lambda z: (z[1]-z[2])*(z[1]-z[2])))/len(clean)), 6) as loss from latents group by 1")
def flow_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).groupBy((F.col("vec_id") % 7).alias("part")).agg(n.rounded(F.avg(n.mse(F.col("clean"), F.col("noise"))), 6).alias("loss"))


@query(f"select vec_id, round({u(chr(39)+'3'+chr(39), 'vec_id::varchar')}, 9) as t from embeddings")
def timesteps_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", n.rounded(n.timesteps_uniform(3, F.col("vec_id")), 9).alias("t"))


@query("select vec_id, round(1.0/(1.0+exp(-z)), 9) as t from (select vec_id, sqrt(-2.0*ln(1.0-" + u("'a'", "'3'", "vec_id::varchar") + "))*cos(2.0*pi()*" + u("'b'", "'3'", "vec_id::varchar") + ") as z from embeddings)")
def timesteps_logit_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", n.rounded(n.timesteps_logit_normal(3, F.col("vec_id")), 9).alias("t"))


@query("select event_id, round(case when event_id<500 then event_id/500.0::double else 0.1::double+0.9::double*(0.5::double*(1.0+cos(pi()*least((event_id-500)/7500.0::double,1.0)))) end, 9) as multiplier from events")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", n.rounded(n.learning_rate(F.col("event_id"), 500, 8000, 0.1), 9).alias("multiplier"))


@query(f"with {fx.LATENTS} select vec_id, {r('list_transform(list_zip(clean, noise), lambda z: z[1]+5.0*(z[2]-z[1]))')} as v from latents")
def cfg_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.guided(F.col("clean"), F.col("noise"), 5.0)).alias("v"))


def _field(x, t):
    return F.transform(x, lambda a: a * 0.5 + t)


def _steps(heun: bool, steps: int = 5) -> str:
    """Recursive CTE of the integrator over the field x/2 + t."""
    v = "x/2+(1.0-i/{s}.0::double)".replace("{s}", str(steps))
    dt = f"((1.0-(i+1)/{steps}.0::double)-(1.0-i/{steps}.0::double))"
    euler = f"x+{dt}*({v})"
    second = f"(({euler})/2+(1.0-(i+1)/{steps}.0::double))"
    move = f"case when i<{steps-1} then x+{dt}*(0.5*(({v})+{second})) else {euler} end" if heun else euler
    return f"""with recursive e as (select vec_id, unnest(embedding::double[]) as x0, generate_subscripts(embedding,1) as k from embeddings),
s as (select vec_id, k, 0 as i, x0 as x from e union all select vec_id, k, i+1, {move} from s where i<{steps})
select vec_id, list(round(x,6)+0.0 order by k) as x from s where i={steps} group by vec_id"""


@query(_steps(False))
def euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.integrate(F.col("clean"), 5, _field)).alias("x"))


@query(_steps(True))
def heun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.integrate(F.col("clean"), 5, _field, heun=True)).alias("x"))


@query(f"with {fx.LATENTS} select vec_id, {r('list_concat(list_concat(list_transform(range(0,4), lambda i: cos(t*exp(-ln(10000.0::double)*i/3))), list_transform(range(0,4), lambda i: sin(t*exp(-ln(10000.0::double)*i/3)))), [0.0::double])')} as e from latents")
def timestep_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.timestep_embedding(F.col("t"), 9)).alias("e"))


@query(f"with {fx.LATENTS}, s as (select *, sqrt(list_sum(list_transform(clean, lambda x: x*x))/len(clean)+1e-6::double) as d from latents) select vec_id, {r('list_transform(clean, lambda x: x/d)')} as x from s")
def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.rms_norm(F.col("clean"))).alias("x"))


@query(f"with {fx.LATENTS} select vec_id, {r('list_transform(clean, lambda x, i: case when i%2=1 then -clean[i+1] else clean[i-1] end)')} as x from latents")
def rotate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.rotate_pairs(F.col("clean"))).alias("x"))


@query("""with g as (select y.range as y, x.range as x, k.range as k from range(0,6) y, range(0,10) x, range(0,16) k),
p as (select y, x, k, (case when k<8 then y else x end)*pow(10000.0::double, -((k%8)//2)/4.0::double)/4.0::double as phase from g)
select y, x, k, round(cos(phase),9) as c, round(sin(phase),9) as s from p""")
def rope_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = spark.range(6).withColumnRenamed("id", "y").withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint")))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    p = y.withColumn("phase", n.rope_phase(F.col("y"), F.col("x"), F.col("k"), 16))
    return p.select("y", "x", "k", n.rounded(F.cos("phase"), 9).alias("c"), n.rounded(F.sin("phase"), 9).alias("s"))


@query(f"with {fx.LATENTS} select vec_id, {r('list_transform(list_zip(clean, noise), lambda z: z[1]*(1.0+z[2])+z[1])')} as x, {r('list_transform(list_zip(clean, noise), lambda z: z[1]+z[2]*z[1])')} as gated from latents")
def modulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, z = F.col("clean"), F.col("noise")
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.modulate(c, z, c)).alias("x"), rounded(n.gated(c, z, c)).alias("gated"))


@query(f"with {fx.LATENTS} select vec_id, {r('list_transform(clean, lambda v: 0.5*v*(1.0+tanh(sqrt(2.0/pi())*(v+0.044715*v*v*v))))')} as x from latents")
def gelu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.gelu_tanh(F.col("clean"))).alias("x"))


@query(f"with {fx.LATENTS} select vec_id, {r('list_transform(range(0,64), lambda i: clean[((((((i%16)//4)//2)*2+((i%4)//2))*2+((i%16)//4)%2)*2+(i%4)%2)*4+i//16+1])')} as x from latents")
def unpatchify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.latents(spark, sf_dir).select("vec_id", rounded(n.unpatchify(F.col("clean"), 2, 2, 2, 4)).alias("x"))


@query(f"with {fx.LATENTS} select vec_id, {r('list_concat(clean[1:1+vec_id%60], list_transform(range(0,64-1-vec_id%60), lambda i: 0.0::double))')} as x, list_transform(range(1,65), lambda i: i<=1+vec_id%60) as m, 1+vec_id%60 as n from latents")
def pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (1 + F.col("vec_id") % 60).cast("int")
    x = fx.latents(spark, sf_dir).select("vec_id", F.slice("clean", F.lit(1), size).alias("x"), n.mask(size, F.lit(64)).alias("m"))
    return x.select("vec_id", rounded(n.padded(F.col("x"), F.lit(64))).alias("x"), "m", F.size(F.filter("m", lambda b: b)).cast("bigint").alias("n"))


@query("""with c as (select event_id, ['bf16','FP16','float32','int8'][event_id%4+1] as p, [null,'fp16','bfloat16'][event_id%3+1] as q, ['adamw','AdamW8bit','sgd'][event_id%3+1] as o from events),
d as (select *, case lower(p) when 'bf16' then 'bfloat16' when 'fp16' then 'float16' when 'float32' then 'float32' end as compute, case lower(q) when 'fp16' then 'float16' when 'bfloat16' then 'bfloat16' end as qq from c),
e as (select *, case when q is not null then qq when compute='float16' then 'float32' else compute end as parameters from d)
select event_id, compute, parameters, compute='float16' and parameters<>'float16' as scaler, case lower(o) when 'adamw' then 'adamw' when 'adamw8bit' then case when event_id%2=0 then 'adamw8bit' when event_id%5=0 then 'adamw' else 'error' end else 'error' end as optimizer from e""")
def dtype_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda names: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (i % len(names)).cast("int") + 1)
    e = fx.table(spark, sf_dir, "events").select(i, n.dtype_policy(pick(["bf16", "FP16", "float32", "int8"]), pick([None, "fp16", "bfloat16"])).alias("d"), n.optimizer_policy(pick(["adamw", "AdamW8bit", "sgd"]), i % 2 == 0, i % 5 == 0).alias("optimizer"))
    return e.select("event_id", "d.compute", "d.parameters", "d.scaler", "optimizer")


@query("""with c as (select event_id, 64*(1+event_id%40) as hidden, 1+event_id%20 as heads, event_id%3 as patch, event_id%4 as depth, case when event_id%5=0 then 'other' else 'sdpa' end as backend from events)
select event_id, list_filter([case when hidden%heads<>0 then 'hidden_size' end, case when (hidden//heads)%4<>0 then 'head_dim' end, case when patch<1 then 'patch_size' end, case when depth<1 then 'depth' end, case when backend<>'sdpa' then 'attention_backend' end], lambda x: x is not null) as errors from c""")
def model_config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return fx.table(spark, sf_dir, "events").select(i, n.model_errors(64 * (1 + i % 40), 1 + i % 20, i % 3, i % 4, F.when(i % 5 == 0, "other").otherwise("sdpa")).alias("errors"))


@query(f"with {fx.POSTS} select tag_string_artist as section, sum(image_width * image_height * (1 + id % 3))::bigint as parameters, count(*) as tensors from posts group by 1")
def param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights whose shapes are those of the posts, summed by section."""
    shapes = fx.posts(spark, sf_dir).select(F.col("tag_string_artist").alias("section"), F.array("image_width", "image_height", 1 + F.col("id") % 3).alias("shape"))
    return n.param_counts(shapes)
