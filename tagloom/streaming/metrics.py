"""Figures of a run: observed while its jobs write, kept as rows under a run id that outlives restarts."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tagloom.sources import shared, store

ROWS = "run_id string, step long, name string, value double, at double"


class RunLog:
    """Metrics below a folder. The first one to open it gives the run its id; later ones go on under it.

    A step's figures are one file, written whole: a step that is done again after a restart replaces
    its own, so nothing counts twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        held = store.read_text(spark, f"{self.root}/run_id")
        if not held:
            held = uuid.uuid4().hex
            store.write_text(spark, f"{self.root}/run_id", held)
        self.run_id = held.strip()

    def record(self, step: int, figures: dict, name: str = "step") -> None:
        """Numbers and truth values of ``figures``; others are left out, nulls are null rows."""
        rows = [{"run_id": self.run_id, "step": step, "name": k, "value": None if v is None else float(v), "at": time.time()} for k, v in sorted(figures.items()) if v is None or isinstance(v, (bool, int, float))]
        store.write_text(self.spark, f"{self.root}/metrics/{name}-{step:012d}.json", "".join(json.dumps(r) + "\n" for r in rows))

    def watched(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
        """``df`` with aggregates that Spark computes beside the next job that reads all of it."""
        seen = Observation(f"run-{uuid.uuid4().hex}")
        return df.observe(seen, *[c.alias(k) for k, c in figures.items()]), seen

    def written(self, df: DataFrame, at: str, step: int, **figures: Column) -> DataFrame:
        """Write ``df`` once and record ``figures`` of it from the same pass; the table read again."""
        watched, seen = self.watched(df, **figures)
        out = shared.kept(watched, at)
        self.record(step, seen.get)
        return out

    def table(self) -> DataFrame:
        """run_id, step, name, value and at of everything recorded."""
        if not store.names(self.spark, f"{self.root}/metrics"):
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).option("pathGlobFilter", "*.json").json(f"{self.root}/metrics")  # no file that is being written

    def listener(self) -> StreamingQueryListener:
        return _Progress(self)


class _Progress(StreamingQueryListener):
    """Rows, seconds and observed figures of every micro-batch, under its number."""

    def __init__(self, log: RunLog):
        self.log = log

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        figures = {"input_rows": p.numInputRows, "duration_s": p.batchDuration / 1000}
        for name, row in p.observedMetrics.items():
            figures |= {f"{name}.{k}": v for k, v in row.asDict().items()}
        self.log.record(p.batchId, figures, "micro-batch")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
