"""Where intermediate tables go, and how lineage is cut.

Executors may be lost at any time, so intermediates are written as Parquet into the folder that
all machines share: ``spark.checkpoint.dir`` of the session. Only where that is unset and the master is
this machine (tests) a temporary folder stands in; on a cluster that is an error.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from tagloom.sources.shared import shared_dir

def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tagloom-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it again: a cut in the lineage that survives lost executors."""
    at = new_dir(df.sparkSession, what)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(at)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._tagloom_path = at
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan needs any more; it notices when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete what ``stored`` wrote, once nothing lazy reads it any more."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._tagloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(uri: str):
    """(pyarrow file system, path) of a place in the shared folder, on any machine."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_file(uri: str, parts) -> int:
    """Write byte strings under a temporary name of this attempt, then rename: a reader sees the whole file or none."""
    system, path = files(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    try:
        with system.open_output_stream(part, compression=None) as out:
            for x in parts:
                out.write(x)
                n += len(x)
        system.move(part, path)
    except BaseException:
        if system.get_file_info(part).is_file:
            system.delete_file(part)
        raise
    return n
