"""Sizes of images from a few bytes of their files, and manifests of image folders."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import geometry
from tagloom.functions.paths import IMAGE_ENDINGS, ending
from tagloom.sources import shared

#: Bytes of the first read, and segments of a JPEG that are passed over before it counts as broken.
FIRST, SEGMENTS = 32, 4096


def size_at(read: Callable[[int, int], bytes]) -> tuple[int, int] | None:
    """(width, height) of a PNG, JPEG, WebP or BMP; None if the bytes aren't one. ``read(start, n)`` gives n bytes, or fewer at the end.

    PNG, WebP and BMP have their size in the first bytes. A JPEG is walked from segment to segment, ten
    bytes of each, so what lies inside them (thumbnails, profiles) isn't read.
    """
    head = read(0, FIRST)
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", head[16:24])
        if head[:2] == b"BM":
            w, h = struct.unpack("<ii", head[18:26])
            return w, abs(h)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            kind = head[12:16]
            if kind == b"VP8X":
                return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
            if kind == b"VP8L":
                bits = int.from_bytes(head[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            if kind == b"VP8 ":
                w, h = struct.unpack("<HH", head[26:30])
                return w & 0x3FFF, h & 0x3FFF
        if head[:2] == b"\xff\xd8":
            at = 2
            for _ in range(SEGMENTS):
                part = read(at, 10)
                if len(part) < 4 or part[0] != 0xFF:
                    return None
                if part[1] == 0xFF:  # padding
                    at += 1
                elif part[1] == 0x01 or 0xD0 <= part[1] <= 0xD8:  # markers without a segment
                    at += 2
                elif 0xC0 <= part[1] <= 0xCF and part[1] not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", part[5:9])
                    return w, h
                elif part[1] in (0xD9, 0xDA):  # the end, or pixels before a size
                    return None
                else:
                    at += 2 + struct.unpack(">H", part[2:4])[0]
    except (struct.error, IndexError):
        return None
    return None


def image_size(head: bytes) -> tuple[int, int] | None:
    """(width, height) from the bytes of a file."""
    return size_at(lambda start, n: head[start : start + n])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, counts = [], []
        for path in batch.column("path").to_pylist():
            system, at = shared.files(path)
            taken = 0
            with system.open_input_file(at) as f:

                def read(start: int, n: int) -> bytes:
                    nonlocal taken
                    f.seek(start)
                    got = f.read(n)
                    taken += len(got)
                    return got

                sizes.append(size_at(read) or (None, None))
            counts.append(taken)
        new = [pa.array([s[0] for s in sizes], pa.int64()), pa.array([s[1] for s in sizes], pa.int64()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "width", "height", "bytes_read"])


def listing(spark: SparkSession, root: str, endings: tuple[str, ...]) -> DataFrame:
    """path and stem of the files below a folder that have one of the endings, in any case; nothing is read of them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return found.where(ending(F.col("path")).isin(*endings)).withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", ""))


def heads(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with width, height (null if it isn't an image) and bytes_read, by reads of a few bytes in tasks."""
    fields = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path").mapInArrow(_probe, f"{fields}, width long, height long, bytes_read long")


def manifest(spark: SparkSession, root: str, stage: int, max_upscale: float | None = None) -> DataFrame:
    """image_path, original size, bucket and sidecar (JSON text) of each image below a folder that isn't scaled up too much.

    A file's sidecar is the .json beside it, else the .txt as general tags. Files that aren't images are left out.
    """
    images = heads(listing(spark, root, IMAGE_ENDINGS)).where("width is not null")
    loose = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,txt,JSON,TXT}").load(root)
    named = loose.withColumn("end", F.lower(ending(F.col("path")))).withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", ""))
    side = lambda end, name: named.where(F.col("end") == end).select("stem", F.col("content").cast("string").alias(name))
    joined = images.select("path", "stem", "width", "height").join(side(".json", "json"), "stem", "left").join(side(".txt", "text"), "stem", "left")
    b = geometry.choose(F.col("width"), F.col("height"), geometry.stage_buckets(stage))
    out = joined.withColumn("b", b)
    if max_upscale is not None:
        out = out.where(geometry.upscale(F.col("width"), F.col("height"), F.col("b")) <= max_upscale)
    fine = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("json")), F.lit("OBJECT")), F.lit(False))
    sidecar = F.coalesce(F.when(fine, F.col("json")), F.when(F.col("text").isNotNull(), F.to_json(F.struct(F.trim("text").alias("general_tags")))), F.lit("{}"))
    return out.select(F.col("path").alias("image_path"), F.col("width").alias("original_width"), F.col("height").alias("original_height"), geometry.key(F.col("b.width"), F.col("b.height")).alias("bucket"), sidecar.alias("sidecar"))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps({k: v for k, v in r.items() if k != "sidecar"} | json.loads(r["sidecar"]), ensure_ascii=False) for r in rows], pa.string())], names=["value"])


def write_manifest(spark: SparkSession, root: str, to: str, stage: int, max_upscale: float | None = None) -> dict[str, int]:
    """Write the manifest of an image folder as JSON lines below ``to``, in parts; how many images were kept and skipped.

    A sidecar's keys stand beside the record's own and replace them where they are the same. Files that
    can't be read as images, and images that would be scaled up too much, are skipped.
    """
    manifest(spark, root, stage, max_upscale).mapInArrow(_lines, "value string").write.mode("overwrite").text(to)
    kept = spark.read.text(to).count()
    return {"kept": kept, "skipped": listing(spark, root, IMAGE_ENDINGS).count() - kept}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a cached manifest (JSON lines); each names its latent and its bucket, and there is one at least."""
    rows = spark.read.schema("sample_id string, latent_path string, bucket string, general_tags string").json(path)
    bad = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("latent_path").isNull() | F.col("bucket").isNull()).alias("bad")).head()
    if not bad["n"] or bad["bad"]:
        raise ValueError(f"{path}: {bad['n']} records, {bad['bad']} without latent_path or bucket")
    return rows
