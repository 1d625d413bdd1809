"""The rolling stream: encode what a micro-batch brings, then train on the blocks that are full, in turns.

``Rolling`` is the function of a ``foreachBatch``. Its state lies in a folder, a version for each micro-batch:
what waits (samples that no group has taken, and those behind the last full block), and how far
numbers have got. A micro-batch that is run again after a failure begins with the version before it and
writes its own anew, so together with the offsets in Spark's checkpoint nothing is skipped and
the output holds every group once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import batching
from tagloom.operators.encode import Encoder, block_means, encoded
from tagloom.operators.ingest import global_ordinals
from tagloom.operators.scans import CHUNK
from tagloom.sources import store

Hook = Callable[[], None]
#: Keys of a sample; its other columns travel once, from the encoder to the output.
KEYS = ("position", "shard_index", "sample_index", "bucket")


class Rolling:
    """Blocks of ``block`` samples by (shard_index, sample_index), groups of ``batch`` from one bucket, ``accumulate`` groups a step.

    Samples: shard_index, sample_index, bucket, pixels, shape and others; later micro-batches bring
    later ones. For each micro-batch: ``before_encode``, then all its samples are encoded and written;
    if blocks are full, ``before_train``, then the groups they give are written below ``root``/out with
    group_no and the cursor that is safe once a group is trained, and ``consume(groups, batch_id)`` is called.
    That may happen again for a batch_id whose micro-batch failed later. ``finish`` ends the epoch.
    """

    def __init__(self, root: str, block: int, batch: int, accumulate: int, encoder: Encoder = block_means, most: int = 16, before_encode: Hook | None = None, before_train: Hook | None = None, consume: Callable[[DataFrame, int], None] | None = None):
        if min(block, batch, accumulate, most) < 1 or block % (batch * accumulate):
            raise ValueError("sizes are positive, and a block holds a whole number of steps")
        self.root, self.block, self.batch, self.accumulate = root.rstrip("/"), block, batch, accumulate
        self.encoder, self.most, self.consume = encoder, most, consume
        self.before_encode, self.before_train = before_encode or (lambda: None), before_train or (lambda: None)

    def _versions(self, spark: SparkSession) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in store.names(spark, f"{self.root}/state") if n.endswith(".json"))

    def _before(self, spark: SparkSession, batch_id: int) -> dict:
        last = max((v for v in self._versions(spark) if v < batch_id), default=None)
        return {"version": None, "position": 0, "groups": 0, "trained": None} if last is None else json.loads(store.read_text(spark, f"{self.root}/state/{last}.json"))

    def _kept(self, df: DataFrame, what: str, batch_id: int) -> DataFrame:
        at = f"{self.root}/{what}/batch={batch_id}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    def __call__(self, samples: DataFrame, batch_id: int) -> None:
        before = self._before(samples.sparkSession, batch_id)
        self.before_encode()
        made = self._kept(encoded(samples, self.encoder, self.most), "encoded", batch_id)
        self._train(made.sparkSession, made, before, batch_id, False)

    def finish(self, spark: SparkSession) -> None:
        """What is left behind the last full block is a block of its own; its groups are the epoch's last ones. What still waits then is dropped."""
        versions = self._versions(spark)
        if versions and not self._before(spark, versions[-1] + 1).get("finished"):
            self._train(spark, None, self._before(spark, versions[-1] + 1), versions[-1] + 1, True)

    def _train(self, spark: SparkSession, made: DataFrame | None, before: dict, batch_id: int, last: bool) -> None:
        position, samples = before["position"], None
        if made is not None:
            samples = global_ordinals(made, "shard_index", ["sample_index"], "position").withColumn("position", F.col("position") + position)
            position += made.count()
        if before["version"] is not None:
            waiting = spark.read.parquet(f"{self.root}/waiting/batch={before['version']}")
            samples = waiting if samples is None else waiting.unionByName(samples)
        full = position if last else position // self.block * self.block
        now = {"version": batch_id, "position": position, "groups": before["groups"], "trained": before["trained"], "finished": last}
        if full > before["position"] // self.block * self.block:
            keys = samples.where(F.col("position") < full).select(*KEYS).withColumn("block", F.floor(F.col("position") / self.block))
            grouped = self._kept(batching.grouped(keys, self.batch, self.accumulate), "grouped", batch_id)
            gone = F.col("group_no").isNotNull()
            figures = grouped.agg(F.count_distinct("group_no").alias("n"), F.max(F.when(gone, F.struct("shard_index", "sample_index"))).alias("last"), F.count_distinct("block").alias("blocks")).head()
            if figures["n"]:
                self.before_train()
                self._emit(samples, grouped, before, batch_id, figures["blocks"] <= CHUNK)
                now["groups"] += figures["n"]
                now["trained"] = max(filter(None, [before["trained"], list(figures["last"])]))
            taken = grouped.where("group_no is not null").select("position")
            rest = samples.join(taken, "position", "left_anti")
        else:
            rest = samples
        self._kept(rest, "waiting", batch_id)
        store.write_text(spark, f"{self.root}/state/{batch_id}.json", json.dumps(now))  # from here on the micro-batch is done

    def _emit(self, samples: DataFrame, grouped: DataFrame, before: dict, batch_id: int, few: bool) -> None:
        cursors = batching.safe_cursors(grouped, tuple(before["trained"]) if before["trained"] else None, few).select("group_no", F.col("shard_index").alias("resume_shard_index"), F.col("sample_index").alias("resume_sample_index"))
        groups = grouped.where("group_no is not null").select("position", "group_no").join(cursors, "group_no")
        out = samples.join(groups, "position").withColumn("group_no", F.col("group_no") + before["groups"])
        out = self._kept(out, "out", batch_id)
        if self.consume:
            self.consume(out, batch_id)

    def output(self, spark: SparkSession) -> DataFrame:
        """All groups of micro-batches that are done."""
        done = self._versions(spark)
        at = [f"{self.root}/out/batch={v}" for v in done if store.exists(spark, f"{self.root}/out/batch={v}")]
        if not at:
            raise FileNotFoundError(f"{self.root} holds no groups yet")
        return spark.read.parquet(*at)

    def dropped(self, spark: SparkSession) -> DataFrame:
        """What waits after the last micro-batch that is done."""
        return spark.read.parquet(f"{self.root}/waiting/batch={self._versions(spark)[-1]}")
