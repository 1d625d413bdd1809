"""Tar archives as Spark data sources: members in, latent samples in and out.

``spark.read.format("tar_members").option("shards", "a.tar\\nb.tar")`` gives one partition an
archive, (shard_index, shard, member_ord, name, kind, key, payload). Filters on kind are taken over
by the scan, so image bytes that a plan doesn't ask for are never read; ``payload`` = ``false``
leaves all bytes out. Archives are read from the start to the end, a member at a time.

With ``cache``, shards are fetched into that folder first, also from addresses: a task reads
``shards_per_task`` of them one after the other, with ``ahead`` in the cache at most, and deletes those
that it fetched once they are read. ``decode`` members are read before they are asked for.
"""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tagloom.functions import paths
from tagloom.functions.paths import IMAGE_ENDINGS
from tagloom.sources import ahead, fetch, shared
from tagloom.sources.archives import ArchiveWriter

MEMBERS = "shard_index bigint, shard string, member_ord bigint, name string, kind string, key string, payload binary"
LATENTS = "shard_index bigint, shard string, sample_ord bigint, sample_id string, shape array<int>, latent array<float>, metadata string"


def classify(name: str) -> tuple[str, str] | None:
    """(key, kind) of a member, None if it doesn't count."""
    path = name.replace("\\", "/")
    stem, end = os.path.splitext(path)
    if not os.path.basename(stem):
        return None
    kind = {".json": "json", ".txt": "text"}.get(end.lower(), "image" if end.lower() in IMAGE_ENDINGS else None)
    return (stem, kind) if kind else None


def shard_list(spark: SparkSession, path: str) -> list[str]:
    """Shards named in a text file, one a line; blank lines and lines with # don't count, none is an error."""
    lines = [r.value.strip() for r in spark.read.text(path, wholetext=False).collect()]
    out = [x for x in lines if x and not x.startswith("#")]
    if not out:
        raise ValueError(f"{path} names no shards")
    return out


def _open(path: str):
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return open(path, "rb")
    system, at = shared.files(path)
    return system.open_input_stream(at, compression=None)


@dataclass
class Run(InputPartition):
    """Shards that one task reads: (index, source, address, name in the cache)."""

    shards: list[tuple[int, str, str, str]]

    def __init__(self, shards: list[tuple[int, str, str, str]]):
        self.shards = shards


def _runs(options: dict) -> list[Run]:
    """``shards``: one a line, its address and its name in the cache behind tabs where they are fetched."""
    lines = [s.strip().split("\t") for s in options.get("shards", options.get("path", "")).split("\n") if s.strip()]
    if not lines:
        raise ValueError("option shards is empty")
    shards = [(i, x[0], *(x[1:] or (x[0], ""))) for i, x in enumerate(lines)]
    each = int(options.get("shards_per_task", 1))
    return [Run(shards[a : a + each]) for a in range(0, len(shards), each)]


def _opened(run: Run, options: dict) -> Iterator[tuple[int, str, str]]:
    """(index, source, path) of a task's shards in order, each in the cache from when it is given until the next is asked for."""
    cache = options.get("cache")
    if not cache:
        yield from ((i, s, s) for i, s, _, _ in run.shards)
        return
    how = fetch.Transfer(int(options.get("tries", 4)), float(options.get("wait", 1.0)), float(options.get("timeout", 120)), options.get("token"))

    def get(shard: tuple[int, str, str, str]) -> tuple[int, str, str, bool]:
        i, source, address, name = shard
        had = shared.size_of(f"{cache}/{name}") is not None
        return i, source, how.one(address, cache, name), not had

    def used(got: tuple[int, str, str, bool]) -> None:
        if got[3] and str(options.get("delete", "true")).lower() == "true":
            system, at = shared.files(got[2])
            system.delete_file(at)

    yield from (g[:3] for g in ahead.in_flight(run.shards, get, int(options.get("ahead", 2)), used))


class TarMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> "TarMemberReader":
        return TarMemberReader(dict(self.options))


class TarMemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kinds = options, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = {f.value} if self.kinds is None else self.kinds & {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds = set(f.value) if self.kinds is None else self.kinds & set(f.value)
            else:
                yield f

    def partitions(self) -> list[Run]:
        return _runs(self.options)

    def read(self, part: Run) -> Iterator[tuple]:
        yield from ahead.decoded(self._members(part), int(self.options.get("decode", 0)))

    def _members(self, part: Run) -> Iterator[tuple]:
        wanted = str(self.options.get("payload", "true")).lower() == "true"
        for index, source, path in _opened(part, self.options):
            with _open(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                for ord_, member in enumerate(tar):
                    found = classify(member.name) if member.isfile() else None
                    if found and (self.kinds is None or found[1] in self.kinds):
                        yield index, source, ord_, member.name, found[1], found[0], tar.extractfile(member).read() if wanted else None


class LatentTar(DataSource):
    """Archives of ``<id>.latent.npy`` (half precision) and ``<id>.json``; a half that is alone is an error."""

    @classmethod
    def name(cls) -> str:
        return "latent_tar"

    def schema(self) -> str:
        return LATENTS

    def reader(self, schema) -> "LatentReader":
        return LatentReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> "LatentWriter":
        return LatentWriter(self.options["path"])


class LatentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Run]:
        return _runs(self.options)

    def read(self, part: Run) -> Iterator[tuple]:
        for index, source, path in _opened(part, self.options):
            yield from ahead.decoded(((index, source, i, *s) for i, s in enumerate(latent_samples(path))), int(self.options.get("decode", 0)))


def latent_samples(path: str) -> Iterator[tuple[str, list[int], list[float], str]]:
    """(id, shape, values, metadata) in the order in which pairs become whole."""
    halves: dict[str, dict[str, bytes]] = {}
    with _open(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
        for member in tar:
            for end in (".latent.npy", ".json"):
                if member.isfile() and member.name.endswith(end):
                    key = member.name[: -len(end)]
                    pair = halves.setdefault(key, {})
                    pair[end] = tar.extractfile(member).read()
                    if len(pair) == 2:
                        x = np.load(io.BytesIO(pair[".latent.npy"]), allow_pickle=False)
                        del halves[key]
                        yield key, list(x.shape), x.astype(np.float32).ravel().tolist(), pair[".json"].decode()
    if halves:
        raise ValueError(f"{path}: {len(halves)} samples lack a half, {next(iter(halves))} among them")


class LatentWriter(ArchiveWriter):
    """Rows (sample_id, shape, latent, metadata, ...) to an archive a task, which is put in its place once all tasks are done."""

    def __init__(self, path: str):
        super().__init__(path, "replace")

    def write(self, batches):
        from pyspark import TaskContext

        archive = f"latent-{TaskContext.get().partitionId():05d}.tar"

        def members():
            for batch in batches:
                for r in batch.to_pylist():
                    buffer = io.BytesIO()
                    np.save(buffer, np.array(r["latent"], np.float16).reshape(r["shape"]), allow_pickle=False)
                    pair = [(archive, r["sample_id"] + ".latent.npy", buffer.getvalue()), (archive, r["sample_id"] + ".json", (r["metadata"] or "{}").encode())]
                    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pair]) for i in range(3)], names=["archive", "name", "payload"])

        return super().write(members())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TarMembers, LatentTar):
        spark.dataSource.register(source)


def listed(spark: SparkSession, shards: list[str]) -> str:
    """Option ``shards`` for a reader that fetches: source, address and name in the cache."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(shards)), "i int, source string").withColumn("address", paths.hub_address(F.col("source")))
    return "\n".join(f"{r['source']}\t{r['address']}\t{r['name']}" for r in rows.withColumn("name", paths.cache_name(F.col("address"))).orderBy("i").collect())


def members(spark: SparkSession, shards: list[str], payload: bool = True, cache: str | None = None, **options) -> DataFrame:
    """Members of the shards; with ``cache`` they are fetched into that folder, see above for the options."""
    register(spark)
    reader = spark.read.format("tar_members").option("shards", listed(spark, shards) if cache else "\n".join(shards)).option("payload", str(payload).lower())
    return reader.options(**({"cache": cache} if cache else {}), **options).load()


def sidecars(members_: DataFrame) -> DataFrame:
    """shard_index, key, first_ord, image and metadata (JSON text) of each key: json before text, text as general tags."""
    from pyspark.sql import functions as F

    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("payload")), F.when(F.col("kind") == kind, F.col("member_ord")))
    per = members_.groupBy("shard_index", "key").agg(F.min("member_ord").alias("first_ord"), last("image").alias("image"), last("json").cast("string").alias("json"), last("text").cast("string").alias("text"))
    fine = F.startswith(F.schema_of_variant(F.try_parse_json("json")), F.lit("OBJECT"))
    return per.select("shard_index", "key", "first_ord", "image", F.when(F.coalesce(fine, F.lit(False)), F.col("json")).when(F.col("text").isNotNull(), F.to_json(F.struct(F.trim("text").alias("general_tags")))).otherwise("{}").alias("metadata"))


def encoded_json(values: dict) -> str:
    return json.dumps(values, ensure_ascii=False)
