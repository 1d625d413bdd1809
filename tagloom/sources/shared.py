"""The folder that the driver and all executors see, and files in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        if "at" not in _own:
            holder = tempfile.TemporaryDirectory(prefix="tagloom-shared-")
            atexit.register(holder.cleanup)
            _own["at"] = f"file://{holder.name}"
        at = _own["at"]
    return at.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, at: str) -> DataFrame:
    """``df`` written once as Parquet and read again."""
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def files(uri: str):
    """(pyarrow file system, path) of a place, on any machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def size_of(uri: str) -> int | None:
    """Bytes of a file; None where there is none."""
    system, path = files(uri)
    info = system.get_file_info(path)
    return info.size if info.is_file else None


def write_whole(uri: str, parts) -> int:
    """Write byte strings under a name of this attempt, then rename; the number of bytes."""
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


def chunks(uri: str, start: int = 0, stop: int | None = None, size: int = 1 << 20):
    """Byte strings of a file from ``start`` up to ``stop``."""
    system, path = files(uri)
    with system.open_input_file(path) as f:
        stop = f.size() if stop is None else min(stop, f.size())
        f.seek(start)
        while start < stop and (x := f.read(min(size, stop - start))):
            start += len(x)
            yield x
