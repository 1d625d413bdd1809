"""A stream over latent archives with the offset {epoch, shard, sample}."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tagloom.sources import shared
from tagloom.sources.tars import latent_samples

SCHEMA = "epoch bigint, shard_index bigint, sample_index bigint, shard string, sample_id string, shape array<int>, latent array<float>, metadata string"


def shard_order(shards: list[str], seed: int, epoch: int) -> list[str]:
    """One order for all readers of an epoch, the same as ``operators.batching.shard_order`` gives."""
    return sorted(shards, key=lambda s: (hashlib.md5(f"{seed}|{epoch}|{s}".encode()).hexdigest(), s))


class Slice(InputPartition):
    def __init__(self, epoch: int, index: int, path: str, after: int):
        self.epoch, self.index, self.path, self.after = epoch, index, path, after


class LatentStream(DataSource):
    """Options: shards (one a line), shuffle, seed, epochs, shards_per_batch; epoch, shard and sample to go on after (a stored cursor); checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "latent_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> "LatentStreamReader":
        return LatentStreamReader(dict(self.options))


def stored_offset(checkpoint: str) -> dict | None:
    """End of the last micro-batch in the offset log of a streaming query with one source; None before the first."""
    from pyarrow import fs

    system, at = shared.files(checkpoint)
    found = system.get_file_info(fs.FileSelector(f"{at}/offsets", allow_not_found=True))
    batches = {int(f.base_name): f.path for f in found if f.base_name.isdigit()}
    if not batches:
        return None
    with system.open_input_stream(batches[max(batches)]) as f:
        return json.loads(f.read().decode().splitlines()[2])  # version, settings, offset


class LatentStreamReader(DataSourceStreamReader):
    """A micro-batch is ``shards_per_batch`` shards of an epoch, a task each; its offset is the position among all shards of all epochs.

    A restarted query asks where to go on before it says where it stands, so the reader takes that from
    the query's own offset log (option ``checkpoint``).
    """

    def __init__(self, options: dict):
        self.shards = [s for s in options["shards"].split("\n") if s]
        self.seed, self.epochs = int(options.get("seed", 0)), int(options.get("epochs", 1))
        self.shuffle = str(options.get("shuffle", "true")).lower() == "true"
        self.each = int(options.get("shards_per_batch", 1))
        self.start = (int(options.get("epoch", 0)), int(options.get("shard", 0)), int(options.get("sample", -1)))
        self.checkpoint, self.next = options.get("checkpoint"), None

    def initialOffset(self) -> dict:
        epoch, shard, sample = self.start
        return {"epoch": epoch, "shard": shard, "sample": sample}

    def latestOffset(self) -> dict:
        now = self.next or (stored_offset(self.checkpoint) if self.checkpoint else None) or self.initialOffset()
        self.next = now
        if now["epoch"] < self.epochs:
            shard = now["shard"] + self.each
            end = shard >= len(self.shards)
            self.next = {"epoch": now["epoch"] + end, "shard": 0 if end else shard, "sample": -1}
        return self.next

    def order(self, epoch: int) -> list[str]:
        return shard_order(self.shards, self.seed, epoch) if self.shuffle else self.shards

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.next = end
        out, at = [], (start["epoch"], start["shard"])
        epoch, order = None, []
        while at < (end["epoch"], end["shard"]):
            if epoch != at[0]:  # sorted once an epoch, not once a shard
                epoch, order = at[0], self.order(at[0])
            path = order[at[1]]
            out.append(Slice(*at, path, start["sample"] if at == (start["epoch"], start["shard"]) else -1))
            n = at[1] + 1
            at = (at[0] + n // len(self.shards), n % len(self.shards))
        return out

    def read(self, part: Slice) -> Iterator[tuple]:
        for i, sample in enumerate(latent_samples(part.path)):
            if i > part.after:
                yield part.epoch, part.index, i, part.path, *sample


def latent_stream(spark: SparkSession, shards: list[str], seed: int = 0, epochs: int = 1, cursor: tuple[int, int, int] = (0, 0, -1), checkpoint: str | None = None, shards_per_batch: int = 1, shuffle: bool = True) -> DataFrame:
    """The streaming DataFrame. ``cursor`` is the last sample that was trained on; ``checkpoint`` is the query's checkpointLocation, which goes before it once it holds an offset."""
    spark.dataSource.register(LatentStream)
    reader = spark.readStream.format("latent_stream").option("shards", "\n".join(shards)).option("seed", seed).option("epochs", epochs).option("shards_per_batch", shards_per_batch).option("shuffle", str(shuffle).lower())
    if checkpoint:
        reader = reader.option("checkpoint", checkpoint)
    return reader.option("epoch", cursor[0]).option("shard", cursor[1]).option("sample", cursor[2]).load()


def mersenne_shuffle(items: Column, seed: Column) -> Column:
    """The array shuffled by the standard library's generator, for runs that must repeat older ones."""

    @F.pandas_udf("array<string>")
    def shuffle(values: pd.Series, seeds: pd.Series) -> pd.Series:
        import random

        out = []
        for v, s in zip(values, seeds, strict=True):
            v = list(v)
            random.Random(int(s)).shuffle(v)
            out.append(v)
        return pd.Series(out)

    return shuffle(items, seed)
