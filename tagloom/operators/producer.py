"""Permanent latents: a producer that encodes archives once, and a cache of the latents of an image manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.paths import hash_id
from tagloom.operators.encode import Encoder, block_means, encoded
from tagloom.sources import archives, shared, store

#: Samples of an archive; a source with more has several.
PER_ARCHIVE = 20_000
CACHED = "sample_id string, image_path string, bucket string, latent_path string, offset long, nbytes long, preprocess_geometry array<int>"


def output_name(source: Column, stage: str, part: Column | None = None) -> Column:
    """Archive of a source at a stage, from its hash; parts but the first are numbered."""
    stem = F.concat(F.lit(f"latent/{stage}/latent-"), hash_id(20, source))
    number = F.lit("") if part is None else F.when(part == 0, "").otherwise(F.format_string("-%05d", part))
    return F.concat(stem, number, F.lit(".tar"))


def produced(spark: SparkSession, *roots: str) -> DataFrame:
    """output: names of the archives below the roots (the local one, and where they are mirrored)."""
    out = None
    for root in roots:
        found = archives.archive_paths(spark, root).select(F.regexp_extract("path", r"(latent/[^/]+/latent-[^/]+\.tar)$", 1).alias("output")).where("output <> ''")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def pending(sources: DataFrame, spark: SparkSession, stage: str, *roots: str) -> DataFrame:
    """Sources (source, ...) whose first archive isn't below any of the roots."""
    named = sources.withColumn("__output", output_name(F.col("source"), stage))
    return named.join(produced(spark, *roots).withColumnRenamed("output", "__output"), "__output", "left_anti").drop("__output")


def produce(samples: DataFrame, root: str, stage: str, encoder: Encoder = block_means, most: int = 16, mirror: str | None = None, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """Encode ``samples`` (source, key, ord, pixels, shape, metadata as JSON) into archives below ``root``; source, output, encoded and skipped of the sources that were pending.

    Sources that have an archive below ``root`` or ``mirror`` are left alone, so a second run reads,
    encodes and writes nothing of them. A sample's id is the hash of its source and key; one that can't
    be encoded is skipped, and a source none of which can be has no archive (output null). Null keys and
    sources are skipped too. A source of more than ``per_archive`` samples is dealt over several archives
    by hashes of the keys, so no task holds a hot source. Archives appear all together when the
    job commits: a killed one leaves none. New archives are copied to ``mirror``, each whole.
    """
    spark = samples.sparkSession
    todo = pending(samples.where("source is not null"), spark, stage, root, *([mirror] if mirror else []))
    counts = todo.groupBy("source").agg(F.count(F.lit(1)).alias("__n")).withColumn("__parts", F.ceil(F.col("__n") / per_archive))
    counts = shared.kept(counts, shared.new_dir(spark, "producer-pending"))  # what was pending before anything is written
    dealt = samples.where("key is not null").join(counts.drop("__n"), "source")  # a row a source, so pixels needn't be shuffled
    made = encoded(dealt, encoder, most, skip=True).where("latent is not null")
    part = F.pmod(F.xxhash64("key"), F.col("__parts")).cast("int")
    named = made.withColumn("archive", output_name(F.col("source"), stage, part)).withColumn("sample_id", hash_id(24, F.col("source"), F.col("key")))
    ordered = archives.latent_members(named, "ord")
    if not counts.isEmpty():
        archives.write(ordered, root, archives.LATENT_ORDER)
    stems = counts.withColumn("stem", F.regexp_replace(output_name(F.col("source"), stage), r"\.tar$", ""))
    stem = lambda c: F.regexp_extract(c, r"(latent/[^/]+/latent-[0-9a-f]+)(?:-\d+)?\.tar$", 1)
    new = archives.archive_paths(spark, root).withColumn("stem", stem("path")).join(stems.select("stem"), "stem", "left_semi")
    written = archives.latent_places(new).groupBy(stem("latent_path").alias("stem")).agg(F.count(F.lit(1)).alias("encoded"))
    report = stems.join(written, "stem", "left")
    done = F.coalesce("encoded", F.lit(0)).cast("bigint")
    out = report.select("source", F.when(done > 0, F.concat("stem", F.lit(".tar"))).alias("output"), done.alias("encoded"), (F.col("__n") - done).alias("skipped"))
    return out


def upload(spark: SparkSession, root: str, mirror: str) -> list[str]:
    """Copy archives that ``mirror`` lacks, in tasks; their names."""
    todo = produced(spark, root).join(produced(spark, mirror), "output", "left_anti")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name in batch.column("output").to_pylist():
                shared.write_whole(f"{mirror}/{name}", shared.chunks(f"{root}/{name}"))
            yield pa.RecordBatch.from_arrays([batch.column("output")], names=["output"])

    return sorted(r["output"] for r in todo.mapInArrow(run, "output string").collect())


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The current manifest of a latent cache; empty before the first run."""
    at = store.current(spark, f"{root}/manifest")
    return spark.read.schema(CACHED).json(at) if at else spark.createDataFrame([], CACHED)


def cache_latents(images: DataFrame, root: str, encoder: Encoder = block_means, most: int = 16, overwrite: bool = False, files: int = 64) -> DataFrame:
    """Have a latent of every row of ``images`` (image_path, bucket, pixels, shape, preprocess_geometry) below ``root``; the new manifest.

    The id of an image is the hash of its path. Latents that the manifest holds are kept, and their
    pixels aren't looked at, unless ``overwrite``. New ones go to archives of this run, ``files`` at most,
    dealt by id. The manifest holds a record for each image of this call and is published whole:
    readers see the old or the new one. Rows that repeat a path count once; null paths are left out.
    """
    import uuid

    spark, run = images.sparkSession, uuid.uuid4().hex
    rows = images.where("image_path is not null").withColumn("sample_id", hash_id(20, F.col("image_path")))
    seen = rows.groupBy("sample_id", "image_path").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("bucket", "preprocess_geometry")).alias("__row"))
    wanted = shared.kept(seen.select("sample_id", "image_path", "__row.*", "__n"), shared.new_dir(spark, "latent-wanted"))
    at = None if overwrite else store.current(spark, f"{root}/manifest")
    held = manifest(spark, root).select("sample_id", "latent_path", "offset", "nbytes")
    lacking = wanted.select("sample_id", "__n")
    if at:  # by ids alone: pixels of images that are held aren't made or moved
        lacking = shared.kept(lacking.join(held.select("sample_id"), "sample_id", "left_anti"), shared.new_dir(spark, "latent-lacking"))
    places = None if overwrite else held
    if not lacking.isEmpty():
        fresh = _cached(rows, lacking, at is not None, root, f"latents/{run}", encoder, most, files)
        places = fresh if places is None else places.unionByName(fresh)
    elif places is None:
        places = held.limit(0)
    out = wanted.join(places, "sample_id").select(*[c.split(" ")[0] for c in CACHED.split(", ")])
    store.publish_version(spark, f"{root}/manifest", lambda to: out.write.json(to))
    return manifest(spark, root)


def _cached(rows: DataFrame, lacking: DataFrame, some: bool, root: str, folder: str, encoder: Encoder, most: int, files: int) -> DataFrame:
    """Encode the images of ``lacking`` (sample_id, __n rows; ``some``: not all of ``rows``) into archives below ``root``/``folder``; their places."""
    spark = rows.sparkSession
    narrow = rows.select("sample_id", "bucket", "preprocess_geometry", "shape", "pixels")
    several = lacking.where("__n > 1").select("sample_id")
    todo = narrow.join(lacking.select("sample_id"), "sample_id", "left_semi") if some else narrow
    if not several.isEmpty():  # of equal paths the row that the manifest takes
        one = narrow.join(several, "sample_id", "left_semi").groupBy("sample_id").agg(F.min(F.struct(*narrow.columns[1:])).alias("__row"))
        todo = todo.join(several, "sample_id", "left_anti").unionByName(one.select("sample_id", "__row.*"))
    archive = F.concat(F.lit(f"{folder}/"), F.format_string("%05d", F.pmod(F.xxhash64("sample_id"), F.lit(files))), F.lit(".tar"))
    made = encoded(todo.drop("preprocess_geometry"), encoder, most)
    named = made.select("sample_id", "latent", "latent_shape", F.to_json(F.struct("bucket")).alias("metadata"), archive.alias("archive"))
    archives.write(archives.latent_members(named), root, archives.LATENT_ORDER)
    return archives.latent_places(archives.archive_paths(spark, f"{root}/{folder}"))
