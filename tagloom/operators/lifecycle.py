"""Checkpoints, schedules, configuration and checks before a run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The files of a complete checkpoint.
REQUIRED = ("model.safetensors", "training_state.pt")


def complete(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.where(F.col("has_model") & F.col("has_state"))


def complete_from_files(files: DataFrame) -> DataFrame:
    """Checkpoint directories (root, name) that hold every required file, from a listing with file."""
    return files.where(F.col("file").isin(*REQUIRED)).groupBy("root", "name").agg(F.count_distinct("file").alias("n")).where(F.col("n") == len(REQUIRED)).drop("n")


def newest(checkpoints: DataFrame) -> DataFrame:
    """The complete checkpoint of the largest step over all roots; of equal steps the first root's."""
    best = F.max_by(F.struct("root", "name", "step"), F.struct("step", (F.col("root") == "local").alias("near")))
    return complete(checkpoints).agg(best.alias("best")).where("best is not null").select("best.*")


def removable(checkpoints: DataFrame, keep: int, protected: list[str] = []) -> DataFrame:  # noqa: B006
    """Complete checkpoints beyond the last ``keep`` of their root, but for protected names; 0 or less keeps all."""
    if keep <= 0:
        return checkpoints.limit(0)
    ranked = complete(checkpoints).withColumn("newer", F.row_number().over(W.partitionBy("root").orderBy(F.desc("step"))))
    out = ranked.where(F.col("newer") > keep).drop("newer")
    return out.where(~F.col("name").isin(protected)) if protected else out


def due(step: Column, every: int) -> Column:
    return (step > 0) & (step % every == 0) if every > 0 else F.lit(False)


def counters(micro: Column, accumulate: int) -> Column:
    """struct<step, boundary> of a micro step counted from 1."""
    return F.struct(F.floor(micro / accumulate).alias("step"), (micro % accumulate == 0).alias("boundary"))


def window_metrics(log: DataFrame, every: int) -> DataFrame:
    """Figures of each run of ``every`` steps: mean loss, last gradient norm, samples a second, share of time spent waiting."""
    w = F.floor((F.col("step") - 1) / every)
    per = log.groupBy(w.alias("window")).agg(F.max("step").alias("step"), F.avg("loss").alias("mean_loss"), F.max_by("grad_norm", "step").alias("grad_norm"), F.sum("samples").alias("samples"), F.sum("seconds").alias("seconds"), F.sum("wait").alias("wait"))
    return per.select("window", "step", "mean_loss", "grad_norm", (F.col("samples") / F.col("seconds")).alias("samples_per_second"), F.least(F.col("wait") / F.col("seconds"), F.lit(1.0)).alias("wait_ratio"))


def cursor_of(batch: DataFrame) -> DataFrame:
    """epoch, shard_index and sample_index to store after a batch: those of its first sample, the safe cursor where there is one."""
    first = lambda c: F.element_at(F.col(c), 1)
    return batch.select("batch_no", first("stream_epoch").alias("epoch"), F.coalesce(first("resume_shard_index"), first("source_shard_index")).alias("shard_index"), F.coalesce(first("resume_sample_index"), first("source_sample_index")).alias("sample_index"))


def merge_maps(base: Column, over: Column) -> Column:
    """Map with the entries of both, the second's where both have one."""
    return F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a))


def merge_config(base: Mapping, over: Mapping) -> dict:
    """Nested configuration: mappings are merged, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge_config(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load_config(read, path: str, seen: tuple[str, ...] = ()) -> dict:
    """A configuration with what it extends; ``read(path)`` gives (mapping, path of the extended one or None)."""
    if path in seen:
        raise ValueError(f"{path} extends itself")
    own, parent = read(path)
    own = {k: v for k, v in own.items() if k != "extends"}
    return merge_config(load_config(read, parent, (*seen, path)), own) if parent else own


def section(config: Mapping, name: str) -> dict:
    if not isinstance(config.get(name), Mapping):
        raise ValueError(f"the configuration has no section {name}")
    return dict(config[name])


#: Settings that a command line may override: name -> (section, key, whether it must be positive).
OVERRIDES = {"max_steps": ("train", "max_steps", True), "rolling_block_size": ("data", "rolling_block_size", True), "output_dir": ("train", "output_dir", False), "checkpoint_mirror_dir": ("train", "checkpoint_mirror_dir", False)}


def overridden(config: Mapping, **given) -> dict:
    """``config`` with the settings that were given (None: not given); a number that must be positive and isn't is an error."""
    out = {k: dict(v) if isinstance(v, Mapping) else v for k, v in config.items()}
    for name, value in given.items():
        where, key, positive = OVERRIDES[name]
        if value is None:
            continue
        if positive and value < 1:
            raise ValueError(f"{name} must be positive")
        out.setdefault(where, {})[key] = value
    return out


def runtime_config(base: str, root: str, smoke_steps: int | None = None) -> dict:
    """A configuration that extends ``base`` with the folders of a run below ``root``.

    A smoke run has a bound on its steps and its own output, mirror and name, so that it can neither
    resume nor replace what a real run saved.
    """
    train = {"checkpoint_mirror_dir": root}
    if smoke_steps is not None:
        if smoke_steps < 1:
            raise ValueError("a smoke run has a step at least")
        train = {"output_dir": f"{root}/smoke/local", "checkpoint_mirror_dir": f"{root}/smoke/mirror", "max_steps": smoke_steps, "tracking": {"name": "smoke", "tags": ["smoke"]}}
    return {"extends": base, "data": {"metadata_index_dir": f"{root}/index"}, "train": train}


def flattened(spark: SparkSession, config: Mapping) -> DataFrame:
    """key and value of a configuration's leaves, keys joined by dots."""

    def leaves(m: Mapping, at: str = ""):
        for k, v in m.items():
            if isinstance(v, Mapping):
                yield from leaves(v, f"{at}{k}.")
            else:
                yield f"{at}{k}", None if v is None else str(v)

    return spark.createDataFrame(sorted(leaves(config)), "key string, value string")


def rolling_errors(block: Column, accumulate: Column, batch: Column, prefetch: Column, upscale: Column) -> Column:
    """Names of the rules that a rolling stream's settings break."""
    checks = [("positive", (block < 1) | (batch < 1) | (accumulate < 1)), ("prefetch", prefetch != 1), ("block", block % F.greatest(accumulate, F.lit(1)) != 0), ("boundary", accumulate % F.greatest(batch, F.lit(1)) != 0), ("upscale", upscale <= 0)]
    return F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks]), lambda x: x.isNotNull())


def preview_errors(enabled: Column, every: Column, prompts: Column, width: Column, height: Column, steps: Column, scale: Column, solver: Column) -> Column:
    """Names of the settings of a preview that can't be used; a preview that is off has none."""
    checks = [("every_steps", every < 1), ("prompts", (F.size(prompts) == 0) | F.exists(prompts, lambda p: F.trim(p) == "")), ("size", (width < 32) | (height < 32) | (width % 32 != 0) | (height % 32 != 0)), ("steps", steps < 1), ("guidance", scale < 0), ("solver", ~solver.isin("euler", "heun"))]
    return F.when(enabled, F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def report(checks: DataFrame) -> DataFrame:
    """errors, warnings and ok of a table of checks (level)."""
    return checks.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), (F.count_if(F.col("level") == "error") == 0).alias("ok"))


def preflight(spark: SparkSession, settings: Mapping, index: DataFrame | None = None) -> DataFrame:
    """ord, level, name and message of each check of a run's data settings; ``index`` as read, with bucket."""
    data, train = section(settings, "data"), section(settings, "train")
    batch, accumulate, block = int(data.get("batch_size", 1)), int(train.get("gradient_accumulation_steps", 1)), int(data.get("rolling_block_size", 0))
    rolling = data.get("backend") == "rolling_raw"
    out = [("ok" if data.get("backend") in ("rolling_raw", "streaming_tar") else "error", "backend", str(data.get("backend")))]
    if accumulate < 1:
        out.append(("error", "gradient accumulation", "must be positive"))
    elif rolling:
        fine = batch >= 1 and block >= 1 and block % (batch * accumulate) == 0
        out.append(("ok" if fine else "error", "rolling block", f"{block} samples, a step every {batch * accumulate}"))
        if int(data.get("prefetch_shards", 1)) != 1:
            out.append(("error", "prefetch", "one shard at a time"))
        cache = int(train.get("text_cache_size", 0))
        if cache < 1 or cache % batch:
            out.append(("error", "text cache", "a positive multiple of the batch size"))
    if not data.get("shards"):
        out.append(("error", "shards", "none are listed"))
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(out)], "ord int, level string, name string, message string")
    if index is None:
        return rows
    buckets = index.agg(F.count_distinct("bucket").alias("n"))
    held = buckets.select(F.lit(len(out)).alias("ord"), F.when(F.col("n") > 0, "ok").otherwise("error").alias("level"), F.lit("index").alias("name"), F.format_string("%d buckets", "n").alias("message"))
    return rows.unionByName(held)
