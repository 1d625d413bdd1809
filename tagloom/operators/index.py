"""The metadata index: adaptive projection, filters, partitioned Parquet, compaction, reading and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# For each column of the index the source columns that may hold it, its type, and what stands for it otherwise.
COLUMNS: dict[str, tuple[tuple[str, ...], str, object]] = {
    "rating": (("rating",), "string", "u"),
    "score": (("score",), "int", 0),
    "image_width": (("image_width", "width"), "bigint", None),
    "image_height": (("image_height", "height"), "bigint", None),
    "tag_string_general": (("tag_string_general", "tag_string"), "string", ""),
    "tag_string_character": (("tag_string_character",), "string", ""),
    "tag_string_copyright": (("tag_string_copyright",), "string", ""),
    "tag_string_artist": (("tag_string_artist",), "string", ""),
    "tag_string_meta": (("tag_string_meta",), "string", ""),
}
FLAGS = ("is_deleted", "is_banned", "is_flagged")
MODULUS = 1000


def bucket_of(id_: Column, modulus: int = MODULUS) -> Column:
    return F.format_string("%04d", id_ % modulus)


def project(source: DataFrame) -> DataFrame:
    """id and the index's columns, each from the first source column that is there, else its stand-in."""
    if "id" not in source.columns:
        raise ValueError("the source has no column id")
    out = [F.col("id").cast("bigint").alias("id")]
    for name, (options, kind, other) in COLUMNS.items():
        found = next((c for c in options if c in source.columns), None)
        out.append((F.col(found) if found else F.lit(other)).cast(kind).alias(name))
    return source.select(*out)


def usable(source: DataFrame) -> DataFrame:
    """Rows whose flags aren't set and that have general tags. Each test is one that Parquet can be asked."""
    for flag in (f for f in FLAGS if f in source.columns):
        source = source.where(F.col(flag).isNull() | (F.col(flag) == F.lit(False)))
    tags = next((c for c in COLUMNS["tag_string_general"][0] if c in source.columns), None)
    return source.where(F.col(tags) != "") if tags else source.where(F.lit(False))


def build(source: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """The index's rows with their partition key."""
    return project(usable(source)).withColumn("bucket", bucket_of(F.col("id"), modulus))


def by_bucket(index: DataFrame, above: int) -> DataFrame:
    """Each bucket's rows in a partition of their own; ``above`` is a number above all buckets."""
    return index.repartitionById(above, F.coalesce(F.pmod(F.col("bucket").try_cast("int"), F.lit(above)), F.lit(0)))


def write(index: DataFrame, path: str, whole: bool = True) -> None:
    """One directory a bucket, ZSTD Parquet. ``whole``: a bucket's rows meet in one task and file; else each task writes its own fragments, without a shuffle."""
    spread = index.repartition("bucket") if whole else index
    spread.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, buckets: list[str] | None = None) -> DataFrame:
    """The index, columns united by name; ``buckets`` prunes directories. Bucket names keep their zeros."""
    out = spark.read.option("mergeSchema", True).option("basePath", path).parquet(path)
    if dict(out.dtypes)["bucket"] != "string":
        out = out.withColumn("bucket", F.format_string("%04d", F.col("bucket").cast("int")))
    return out.where(F.col("bucket").isin(buckets)) if buckets is not None else out


def newest(index: DataFrame, order: list[str]) -> DataFrame:
    """Of rows that repeat an id the last one in the given order."""
    rest = [c for c in index.columns if c != "id"]
    best = index.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select("id", "row.*")


def stats(index: DataFrame) -> DataFrame:
    """buckets and files of an index as read."""
    return index.select("bucket", F.input_file_name().alias("file")).agg(F.count_distinct("bucket").alias("buckets"), F.count_distinct("file").alias("files"))


def needs_compaction(buckets: Column, files: Column) -> Column:
    return files > 2 * buckets


def is_current(version: Column, wanted: Column, same_source: Column, buckets: Column, files: Column, least: int = 900, most: int = 1100) -> Column:
    """Whether an index can be used as it is: same version and source, as many buckets as expected, no bucket without files."""
    return (version == wanted) & same_source & buckets.between(least, most) & (files >= buckets)


def compact(spark: SparkSession, path: str, to: str) -> tuple[int, int]:
    """Rewrite a fragmented index with about one file a bucket; buckets before and after, which must agree."""
    before = read(spark, path)
    n = before.select("bucket").distinct().count()
    write(before, to)
    after = read(spark, to).select("bucket").distinct().count()
    if n != after:
        raise ValueError(f"{n} buckets became {after}")
    return n, after
