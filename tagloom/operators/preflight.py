"""Checks before a run, over a table of runs: one row of settings in, one row a check out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.numeric import dtype_policy, optimizer_policy
from tagloom.functions.paths import is_remote
from tagloom.operators.index import is_current

#: Columns of a run: its settings, and what was found in its surroundings (null: not looked at).
SETTINGS = (
    "run string, backend string, attention string, attention_there boolean, checkpointing boolean, tracking boolean, tracking_login boolean, "
    "accumulation int, batch_size int, rolling_block int, prefetch int, text_cache int, shards array<string>, shards_there array<string>, token boolean, "
    "index_version int, index_source boolean, index_buckets long, index_files long, optimizer string, eight_bit boolean, fallback boolean, "
    "precision string, parameter_precision string, free_bytes long, least_free long, cache_bytes long, mirror string, mirror_there boolean"
)
INDEX_VERSION = 2


def checks() -> list[tuple[str, Column]]:
    """(name, level) in order; a null level means that the check doesn't apply. Levels: ok, warning, error."""
    c = F.col
    rolling, batch = c("backend") == "rolling_raw", F.coalesce("batch_size", F.lit(1))
    grade = lambda fine, bad="error": F.when(F.coalesce(fine, F.lit(False)), "ok").otherwise(bad)
    local = F.filter("shards", lambda s: ~is_remote(s))
    absent = F.array_except(local, F.coalesce("shards_there", F.array().cast("array<string>")))
    hub = F.exists("shards", lambda s: F.startswith(s, F.lit("hf://")))
    steps = F.coalesce("accumulation", F.lit(1))
    return [
        ("attention", F.when(c("attention") == "flash_attention_2", grade(c("attention_there")))),
        ("gradient checkpointing", F.when(F.coalesce("checkpointing", F.lit(True)), "warning").otherwise("ok")),
        ("backend", grade(c("backend").isin("rolling_raw", "streaming_tar"))),
        ("tracking", F.when(c("tracking"), grade(c("tracking_login"), "warning"))),
        ("gradient accumulation", F.when(steps < 1, "error")),
        ("rolling block", F.when(rolling & (steps >= 1), grade((batch >= 1) & (c("rolling_block") >= 1) & (c("rolling_block") % F.greatest(batch * steps, F.lit(1)) == 0)))),
        ("prefetch", F.when(rolling & (steps >= 1) & (F.coalesce("prefetch", F.lit(1)) != 1), "error")),
        ("text cache", F.when(rolling & (steps >= 1) & ((F.coalesce("text_cache", F.lit(0)) < 1) | (c("text_cache") % F.greatest(batch, F.lit(1)) != 0)), "error")),
        ("shards", grade((F.size("shards") > 0) & (F.size(absent) == 0))),
        ("token", F.when(hub & ~F.coalesce("token", F.lit(False)), "warning")),
        ("index", F.when(rolling & c("index_files").isNotNull(), grade(is_current(c("index_version"), F.lit(INDEX_VERSION), c("index_source"), c("index_buckets"), c("index_files"))))),
        ("optimizer", F.when(c("optimizer").isNotNull(), _optimizer(c("optimizer"), F.coalesce("eight_bit", F.lit(False)), F.coalesce("fallback", F.lit(False))))),
        ("precision", F.when(c("precision").isNotNull(), grade(dtype_policy(c("precision"), c("parameter_precision"))["compute"].isNotNull()))),
        ("disk", F.when(c("free_bytes").isNotNull(), grade(c("free_bytes") >= F.coalesce("least_free", F.lit(0)) + F.coalesce("cache_bytes", F.lit(0))))),
        ("mirror", F.when(c("mirror").isNotNull(), grade(c("mirror_there"), "warning"))),
    ]


def _optimizer(name: Column, eight_bit: Column, fallback: Column) -> Column:
    """A fall-back from the 8-bit optimizer is a warning."""
    runs = optimizer_policy(name, eight_bit, fallback)
    return F.when(runs == "error", "error").when((F.lower(name) == "adamw8bit") & (runs == "adamw"), "warning").otherwise("ok")


def preflight(runs: DataFrame) -> DataFrame:
    """run, ord, level and name of every check that applies to each row of ``runs`` (SETTINGS; absent columns count as null).

    ``operators.lifecycle.report`` adds a run's checks up. A table of runs is one projection, so checking
    a sweep of settings costs no more jobs than checking one.
    """
    types = {x.rsplit(" ", 1)[0]: x.rsplit(" ", 1)[1] for x in SETTINGS.split(", ")}
    whole = runs.select(*[F.col(n).cast(t) if n in runs.columns else F.lit(None).cast(t).alias(n) for n, t in types.items()])
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), level.alias("level"), F.lit(name).alias("name")) for i, (name, level) in enumerate(checks())])
    return whole.select("run", F.explode(F.filter(listed, lambda x: x["level"].isNotNull())).alias("c")).select("run", "c.*")


def reports(checked: DataFrame) -> DataFrame:
    """run, errors, warnings and ok."""
    return checked.groupBy("run").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), (F.count_if(F.col("level") == "error") == 0).alias("ok"))


def surroundings(spark: SparkSession, config: dict, index: str | None = None, cache: str | None = None, mirror: str | None = None) -> DataFrame:
    """The one row of SETTINGS of a configuration (sections data, train, model) and of what is found around it."""
    from tagloom.operators import index as idx
    from tagloom.sources import store

    data, train, model = (dict(config.get(k) or {}) for k in ("data", "train", "model"))
    shards = list(data.get("shards") or [])
    found = {n: None for n in (x.rsplit(" ", 1)[0] for x in SETTINGS.split(", "))}
    found |= {"run": str(config.get("name", "run")), "backend": data.get("backend"), "attention": model.get("attention"), "checkpointing": model.get("gradient_checkpointing"), "accumulation": train.get("gradient_accumulation_steps"), "batch_size": data.get("batch_size"), "rolling_block": data.get("rolling_block_size"), "prefetch": data.get("prefetch_shards"), "text_cache": train.get("text_cache_size"), "optimizer": train.get("optimizer"), "fallback": train.get("optimizer_fallback"), "precision": train.get("precision"), "parameter_precision": train.get("parameter_precision")}
    found |= {"shards": shards, "shards_there": [s for s in shards if "://" not in s and store.exists(spark, s)]}
    if index:
        manifest = store.manifest_of(spark, index) or {}
        stats = idx.stats(idx.read(spark, index)).head() if store.exists(spark, index) else {"buckets": 0, "files": 0}
        found |= {"index_version": manifest.get("version"), "index_source": manifest.get("source") == data.get("index_source"), "index_buckets": stats["buckets"], "index_files": stats["files"]}
    if cache:
        system, p = store._at(spark, cache)
        found |= {"free_bytes": system.getStatus(p if system.exists(p) else None).getRemaining(), "least_free": data.get("least_free_bytes"), "cache_bytes": data.get("cache_bytes")}
    if mirror:
        found |= {"mirror": mirror, "mirror_there": store.exists(spark, mirror)}
    return spark.createDataFrame([tuple(found.values())], SETTINGS)
