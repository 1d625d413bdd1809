"""Fetched shards, produced archives, cached latents: round trips through the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import fixtures as fx
from tagloom.operators import producer
from tagloom.plans import query
from tagloom.sources import archives, fetch, shared


def _write_files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = []
            for name, parts in zip(batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                sources.append(f"{root}/{name}")
                shared.write_whole(sources[-1], (p.encode() for p in parts))
            yield pa.RecordBatch.from_arrays([pa.array(sources)], names=["source"])

    return run


def _sha1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            h = hashlib.sha1()
            for x in shared.chunks(path):
                h.update(x)
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "sha1"])


SEGMENT = 50_000
PAGE_FILES = "f as (select page_id//20 as n, string_agg(coalesce(html, ''), '' order by page_id) as body from pages group by 1)"


@query(f"""with {PAGE_FILES} select concat('p', n, '.bin') as name, octet_length(encode(body))::bigint as nbytes, sha1(body) as sha1,
greatest(1, ceil(octet_length(encode(body)) / {SEGMENT}.0::double))::bigint as segments, true as whole, 0::bigint as again from f""")
def resumed_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, fetched by a job that is stopped, then by one that goes on; a third has nothing to do."""
    root, cache = shared.new_dir(spark, "origin"), shared.new_dir(spark, "cache")
    pages = fx.table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    grouped = pages.groupBy(F.floor(F.col("page_id") / 20).alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "html"))), lambda x: x["html"]).alias("parts"))
    named = grouped.select(F.concat(F.lit("p"), F.col("n").cast("string"), F.lit(".bin")).alias("name"), "parts")
    sources = shared.kept(named.mapInArrow(_write_files(root), "source string"), shared.new_dir(spark, "sources"))
    try:
        fetch.fetch(spark, sources, cache, segment=SEGMENT, fail_after=1)
    except Exception as error:
        if "stopped on purpose" not in str(error):
            raise
    done = fetch.fetch(spark, sources, cache, segment=SEGMENT)
    again = fetch.fetch(spark, sources, cache, segment=SEGMENT).select("source", F.col("fetched").alias("again"))
    hashed = done.mapInArrow(_sha1, f"{fetch.FETCHED}, sha1 string")
    whole = F.col("fetched") <= F.col("segments")
    segments = F.greatest(F.lit(1), F.ceil(F.col("nbytes") / SEGMENT)).cast("bigint")
    return hashed.join(again, "source").select(F.regexp_extract("source", "([^/]+)$", 1).alias("name"), "nbytes", "sha1", segments.alias("segments"), whole.alias("whole"), "again")


OUTPUT = "concat('latent/512/latent-', substr(sha1(source), 1, 20), '.tar')"
#: So that sources are dealt over several archives.
PER_ARCHIVE = 30


@query(f"""with {fx.RAW}, s as (select source, count(*) as n, count(*) filter (not broken) as ok from raw group by source)
select 1 as run, source, case when ok > 0 then {OUTPUT} end as output, ok as encoded, n - ok as skipped from s union all select 2, source, null, 0, n from s where ok = 0""")
def latent_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the second has only the sources that gave nothing to look at."""
    root, samples = shared.new_dir(spark, "produced"), fx.raw_samples(spark, sf_dir)
    reports = [shared.kept(producer.produce(samples, root, "512", per_archive=PER_ARCHIVE), shared.new_dir(spark, "report")).withColumn("run", F.lit(n)) for n in (1, 2)]
    return reports[0].unionByName(reports[1])


@query(f"with {fx.RAW} select substr(sha1(concat(source, chr(0), key)), 1, 24) as sample_id, {OUTPUT} as output, shape, latent from raw where not broken")
def latents_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every produced latent, read at its place in its archive."""
    root = shared.new_dir(spark, "produced")
    producer.produce(fx.raw_samples(spark, sf_dir), root, "512", per_archive=PER_ARCHIVE)
    places = archives.latent_places(archives.archive_paths(spark, root))
    output = F.regexp_replace(F.regexp_extract("latent_path", r"(latent/512/.*)$", 1), r"(-\d{5})?\.tar$", ".tar")
    return archives.latents_at(places).select("sample_id", output.alias("output"), "shape", F.col("latent").cast("array<double>").alias("latent"))


def _refused(pixels):
    raise AssertionError("nothing is to be encoded again")


@query(f"""with {fx.RAW} select substr(sha1(concat('/img/', doc_id, '.webp')), 1, 20) as sample_id, concat('/img/', doc_id, '.webp') as image_path,
case when doc_id%2=0 then '48x32' else '32x48' end as bucket, [doc_id::integer, 0] as preprocess_geometry, shape, latent from raw where not broken""")
def latent_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache made once and asked for again with an encoder that would fail; latents read through its manifest."""
    root = shared.new_dir(spark, "cached")
    fine = F.size("pixels") == 1536
    images = fx.raw_samples(spark, sf_dir).where(fine).select(F.concat(F.lit("/img/"), F.col("ord").cast("string"), F.lit(".webp")).alias("image_path"), F.get_json_object("metadata", "$.bucket").alias("bucket"), "pixels", "shape", F.array(F.col("ord").cast("int"), F.lit(0)).alias("preprocess_geometry"))
    producer.cache_latents(images, root)
    known = producer.cache_latents(images, root, encoder=_refused)
    return archives.latents_at(known).select("sample_id", "image_path", "bucket", "preprocess_geometry", "shape", F.col("latent").cast("array<double>").alias("latent"))
