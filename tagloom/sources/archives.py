"""Tar archives as a sink, one for each name in column ``archive``, and latents read from them by place.

``df.write.format("tar_archives").option("path", root)`` takes rows (archive, name, payload) that lie
together and in order in their task: ``laid_out`` sees to that. Tasks write below a folder of the
job; the commit moves each archive to its name, so a failed job or a lost executor leaves nothing.
An archive that is there already stays (``existing`` = ``skip``), is replaced or is an error.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tagloom.sources import shared

#: Bytes of archive that one task of ``latents_at`` reads through.
REGION = 256 << 20
#: Archives that a commit moves at once.
MOVERS = 16
LATENT, METADATA = ".latent.npy", ".json"
#: Columns by which a sample's two members come after each other, the samples in their order.
LATENT_ORDER = ["order", "sample_id", "place"]


@dataclass
class Archives(WriterCommitMessage):
    written: list[tuple[str, str, int]]


class TarArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_archives"

    def schema(self) -> str:
        return "archive string, name string, payload binary"

    def writer(self, schema, overwrite: bool) -> "ArchiveWriter":
        return ArchiveWriter(self.options["path"], "replace" if overwrite else self.options.get("existing", "skip"))


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, existing: str):
        if existing not in ("skip", "replace", "error"):
            raise ValueError(f"existing is skip, replace or error, not {existing}")
        self.path, self.existing, self.staging = path.rstrip("/"), existing, f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Archives:
        written: list[tuple[str, str, int]] = []
        rows = ((a, n, p) for b in batches for a, n, p in zip(*(b.column(c).to_pylist() for c in ("archive", "name", "payload")), strict=True))
        ahead = next(rows, None)
        while ahead is not None:
            archive, part, count = ahead[0], f"{self.staging}/{uuid.uuid4().hex}", 0
            if any(archive == w[1] for w in written):
                raise ValueError(f"rows of {archive} don't lie together")
            system, at = shared.files(part)
            system.create_dir(at.rpartition("/")[0], recursive=True)
            with system.open_output_stream(at, compression=None) as out, tarfile.open(fileobj=out, mode="w|") as tar:
                while ahead is not None and ahead[0] == archive:
                    info = tarfile.TarInfo(ahead[1])
                    info.size, info.mtime, info.mode = len(ahead[2]), 0, 0o644
                    tar.addfile(info, io.BytesIO(ahead[2]))
                    count, ahead = count + 1, next(rows, None)
            written.append((part, archive, count))
        return Archives(written)

    def commit(self, messages: list[Archives | None]) -> None:
        all_ = [w for m in messages if m for w in m.written]
        names = [a for _, a, _ in all_]
        twice = {a for a in names if names.count(a) > 1} if len(set(names)) < len(names) else set()
        with ThreadPoolExecutor(MOVERS) as pool:
            sizes = list(pool.map(lambda a: shared.size_of(f"{self.path}/{a}"), names)) if self.existing != "replace" else []
        there = {a for a, n in zip(names, sizes) if n is not None}
        if twice or there and self.existing == "error":
            self.abort(messages)
            raise ValueError(f"archives written by several tasks or there already: {sorted(twice | there)[:3]}")
        system, base = shared.files(self.path)
        for folder in {f"{base}/{a}".rpartition("/")[0] for a in names}:
            system.create_dir(folder, recursive=True)
        new = [(shared.files(part)[1], f"{base}/{archive}") for part, archive, _ in all_ if archive not in there]
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda m: system.move(*m), new))
        self.abort(messages)

    def abort(self, messages: list[Archives | None]) -> None:
        system, at = shared.files(self.staging)
        if system.get_file_info(at).type.name == "Directory":
            system.delete_dir(at)


def tasks(spark: SparkSession) -> int:
    """Tasks that work on archives. A number, as Spark would join partitions of few bytes, and these take time by rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def laid_out(members: DataFrame, order: list[str]) -> DataFrame:
    """archive, name and payload, the rows of an archive in one task and in the given order."""
    return members.repartition(tasks(members.sparkSession), "archive").sortWithinPartitions("archive", *order, "name").select("archive", "name", "payload")


def write(members: DataFrame, root: str, order: list[str], existing: str = "skip") -> None:
    members.sparkSession.dataSource.register(TarArchives)
    laid_out(members, order).write.format("tar_archives").mode("append").option("path", root).option("existing", existing).save()


@F.pandas_udf(T.BinaryType())
def npy(values: pd.Series, shapes: pd.Series) -> pd.Series:
    """Bytes of a half-precision .npy file."""
    out = []
    for v, s in zip(values, shapes, strict=True):
        b = io.BytesIO()
        np.save(b, np.asarray(v, np.float16).reshape(s), allow_pickle=False)
        out.append(b.getvalue())
    return pd.Series(out)


def latent_members(samples: DataFrame, order: str = "sample_id") -> DataFrame:
    """archive, name, payload and LATENT_ORDER of the two members of each sample (archive, sample_id, latent, latent_shape, metadata)."""
    pair = F.array(
        F.struct(F.concat("sample_id", F.lit(LATENT)).alias("name"), npy("latent", "latent_shape").alias("payload")),
        F.struct(F.concat("sample_id", F.lit(METADATA)).alias("name"), F.coalesce("metadata", F.lit("{}")).cast("binary").alias("payload")),
    )
    return samples.select("archive", F.col(order).alias("order"), "sample_id", F.posexplode(pair).alias("place", "m")).select("archive", *LATENT_ORDER, "m.*")


def archive_paths(spark: SparkSession, root: str) -> DataFrame:
    """path and length of the archives below a folder; an empty table where there is none."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tar").load(root)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, length long")
    return found.select("path", "length")


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, at = shared.files(path)
            rows = []
            with system.open_input_file(at) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                for member in tar:  # headers only: payloads are passed over
                    if member.isfile() and member.name.endswith(LATENT):
                        rows.append((member.name[: -len(LATENT)], path, member.offset_data, member.size))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["sample_id", "latent_path", "offset", "nbytes"])


PLACES = "sample_id string, latent_path string, offset long, nbytes long"


def latent_places(archives: DataFrame) -> DataFrame:
    """sample_id, latent_path, offset and nbytes of every latent in the archives (path)."""
    return archives.select("path").repartition(archives.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(_offsets, PLACES)


def _resolve(path: str, base: str | None) -> str:
    return path if "://" in path or path.startswith(("/", "file:")) or base is None else f"{base.rstrip('/')}/{path}"


def _point_reads(base: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        try:
            for batch in batches:
                shapes, values = [], []
                for path, offset, n in zip(*(batch.column(c).to_pylist() for c in ("latent_path", "offset", "nbytes")), strict=True):
                    if path != opened:
                        if f is not None:
                            f.close()
                        system, at = shared.files(_resolve(path, base))
                        opened, f = path, system.open_input_file(at)
                    if offset is not None:
                        f.seek(offset)
                    x = np.load(io.BytesIO(f.read(n) if offset is not None else f.read()), allow_pickle=False)
                    if x.ndim == 4 and x.shape[1] == 1:
                        x = x[:, 0]
                    if x.ndim != 3:
                        raise ValueError(f"{path}: a latent has three axes, this one {x.ndim}")
                    if offset is None:
                        opened = None
                    shapes.append(list(x.shape))
                    values.append(x.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=[*batch.schema.names, "shape", "latent"])
        finally:
            if f is not None:
                f.close()

    return run


def latents_at(places: DataFrame, base: str | None = None) -> DataFrame:
    """``places`` (latent_path, offset, nbytes, ...) with shape and latent, read by point access.

    Rows of one region of an archive meet in one task and are read in the order of their offsets, so a
    file is opened once a task and read forward; a large archive is shared by several tasks. A null
    offset means that the file is the latent. Relative paths are below ``base``. [C, 1, H, W] becomes
    [C, H, W]; a latent with another number of axes is an error. Rows may repeat; a null path is an error.
    """
    names = ", ".join(f"`{n}` {t}" for n, t in places.dtypes)
    region = F.floor(F.coalesce("offset", F.lit(0)) / REGION)
    near = places.withColumn("__region", region).repartition(tasks(places.sparkSession), "latent_path", "__region").sortWithinPartitions("latent_path", "offset").drop("__region")
    return near.mapInArrow(_point_reads(base), f"{names}, shape array<int>, latent array<float>")
