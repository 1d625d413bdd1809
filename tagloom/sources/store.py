"""Files and directories in a shared store: whole writes, publishing, mirrors and run state.

All go through the file system that Spark knows for the path, on the driver; executors write
through Spark's own commit. A reader sees a whole file or directory, or none: where one replaces
another, that takes two renames, with none between them.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import index
from tagloom.operators.lifecycle import REQUIRED

# The manifest of a published index and its version, the pointer to the newest checkpoint.
MANIFEST, VERSION, LATEST = "_index_manifest.json", 2, "latest"
CURRENT = "_current"


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _swap_file(spark: SparkSession, path: str, to: str) -> None:
    """One rename that also replaces ``to``, where the file system can do that; else ``replace``."""
    jvm = spark.sparkContext._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    (system, p), (_, q) = _at(spark, path), _at(spark, to)
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    except Py4JJavaError:  # a store without a file context
        replace(spark, path, to)
        return
    context.rename(system.makeQualified(p), system.makeQualified(q), overwrite)


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _at(spark, path)
    return system.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a directory holds, sorted; nothing where there is none."""
    system, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(p)) if system.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    system, p = _at(spark, path)
    system.delete(p, True)


def retried(action: Callable, tries: int = 5, wait: float = 0.05):
    """``action()``; a refusal is tried again after twice the time, the last one is raised."""
    for n in range(tries):
        try:
            return action()
        except PermissionError:
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)


def _rename(spark: SparkSession, path: str, to: str) -> None:
    system, p = _at(spark, path)
    if not system.rename(p, _at(spark, to)[1]):
        raise PermissionError(f"{path} can't become {to}")


def replace(spark: SparkSession, path: str, to: str) -> None:
    """``path`` takes the place of ``to``. What stood there is set aside first and comes back if the renaming fails."""
    old = f"{to}.old-{uuid.uuid4().hex}"
    had = exists(spark, to)
    if had:
        retried(lambda: _rename(spark, to, old))
    try:
        retried(lambda: _rename(spark, path, to))
    except BaseException:
        if had:
            _rename(spark, old, to)
        raise
    if had:
        delete(spark, old)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A whole file: written under a name of this attempt, then renamed."""
    part = f"{path}.partial-{uuid.uuid4().hex}"
    system, p = _at(spark, part)
    out = system.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    retried(lambda: _swap_file(spark, part, path))


def read_text(spark: SparkSession, path: str) -> str | None:
    """Text of a file; None where there is none."""
    if not exists(spark, path):
        return None
    system, p = _at(spark, path)  # Spark's readers pass over names that begin with an underscore
    stream = system.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> str | None:
    """Where the current version of a published directory lies; None before the first."""
    name = read_text(spark, f"{root}/{CURRENT}")
    return f"{root}/{name}" if name else None


def publish_version(spark: SparkSession, root: str, write: Callable[[str], object], check: Callable[[str], object] | None = None, keep: int = 2) -> str:
    """Write a new version below ``root`` with ``write(path)``, let ``check(path)`` raise, then switch the pointer; its path.

    Versions are never changed, and the pointer is one file that one rename replaces, so a reader finds
    the old or the new version and can finish reading the old one: the last ``keep`` stay. A crash
    before the switch leaves the old version current; what it wrote goes at the next publication.
    """
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    at = f"{root}/{name}"
    write(at)
    if check:
        check(at)
    before = current(spark, root)
    write_text(spark, f"{root}/{CURRENT}", name)
    versions = [n for n in names(spark, root) if n.startswith("v-")]  # oldest first
    held = {name, *versions[-keep:], *([before.rpartition("/")[2]] if before and keep > 1 else [])}
    for n in versions:
        if n not in held:
            delete(spark, f"{root}/{n}")
    return at


def publish(spark: SparkSession, rows: DataFrame, to: str, source: str, file: str | None = None) -> dict:
    """Write an index beside ``to`` with a manifest of its figures, then put it in its place; the manifest.

    buckets, files and rows are counted in what was written, so a manifest never states more than is there;
    source and file say what it was made from.
    """
    staging = f"{to}.replacement-{uuid.uuid4().hex}"
    index.write(rows, staging)
    written = index.read(spark, staging)
    counts = index.stats(written).head()
    manifest = {"version": VERSION, "source": source, "file": file, "buckets": counts["buckets"], "files": counts["files"], "rows": written.count()}
    write_text(spark, f"{staging}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
    replace(spark, staging, to)
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a published index; None where there is none or it can't be read."""
    text = read_text(spark, f"{path}/{MANIFEST}")
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def published(spark: SparkSession, path: str, source: str, least: int = 900, most: int = 1100, file: str | None = None) -> bool:
    """Whether the index at ``path`` can be used for ``source`` and ``file`` as it is: by its manifest and by the files that are there."""
    m = manifest_of(spark, path)
    if not m or m.get("version") != VERSION or (m.get("source"), m.get("file")) != (source, file):
        return False
    counts = index.stats(index.read(spark, path)).head()
    return (counts["buckets"], counts["files"]) == (m.get("buckets"), m.get("files")) and least <= counts["buckets"] <= most


def _figures(spark: SparkSession, at: str) -> list:
    return sorted(index.read(spark, at).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a bucket


def compact(spark: SparkSession, root: str) -> dict:
    """Rewrite the current version of an index below ``root`` with about one file a bucket; buckets, files before and files after.

    The rows of every bucket are counted in the new version before the pointer moves to it, so a crash at
    any step leaves the fragments current and readable, and so does a count that differs.
    """
    at = current(spark, root)
    if at is None:
        raise FileNotFoundError(f"{root} holds no version")
    figures, before = _figures(spark, at), index.stats(index.read(spark, at)).head()

    def check(new: str) -> None:
        if _figures(spark, new) != figures:
            raise ValueError(f"{new} doesn't hold the rows of {at}")

    above = 1 + max((int(r["bucket"]) for r in figures if r["bucket"].isdigit()), default=0)
    new = publish_version(spark, root, lambda to: index.write(index.by_bucket(index.read(spark, at), above), to, False), check)
    return {"buckets": len(figures), "before": before["files"], "after": index.stats(index.read(spark, new)).head()["files"]}


def copy(spark: SparkSession, path: str, to: str) -> None:
    """Copy a directory under a name of this attempt, then put it in its place."""
    part = f"{to}.partial-{uuid.uuid4().hex}"
    (system, p), (other, q) = _at(spark, path), _at(spark, part)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(system, p, other, q, False, spark.sparkContext._jsc.hadoopConfiguration())
    replace(spark, part, to)


def checkpoints(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(step, name) of the complete checkpoints below ``root``, oldest first."""
    found = ((int(n[5:]), n) for n in names(spark, root) if re.fullmatch(r"step-[0-9]+", n))
    return sorted((step, n) for step, n in found if set(REQUIRED) <= set(names(spark, f"{root}/{n}")))


def prune(spark: SparkSession, root: str, keep: int, protected: tuple[str, ...] = ()) -> list[str]:
    """Delete complete checkpoints but for the last ``keep`` and protected names; 0 or less keeps all. The names that went."""
    gone = [n for _, n in checkpoints(spark, root)[:-keep] if n not in protected] if keep > 0 else []
    for n in gone:
        delete(spark, f"{root}/{n}")
    return gone


def resume_path(spark: SparkSession, wanted: str | None, roots: list[str]) -> str | None:
    """Where to resume: nowhere for None; ``auto``: the complete checkpoint of the largest step, of equal ones the first root's; else that path, or the directory of that file, which must be complete."""
    if wanted is None:
        return None
    if wanted == "auto":
        best = max(((step, -k, f"{root}/{n}") for k, root in enumerate(roots) for step, n in checkpoints(spark, root)), default=None)
        return best[2] if best else None
    at = wanted.rpartition("/")[0] if wanted.rpartition("/")[2] in REQUIRED else wanted.rstrip("/")
    if not set(REQUIRED) <= set(names(spark, at)):
        raise FileNotFoundError(f"{at} isn't a complete checkpoint")
    return at


class Mirror:
    """Copies complete checkpoints to a second root, one after the other, beside the run.

    A copy is put in its place whole, then ``latest`` names it and older ones go. An error of a copy
    is raised by the next call or by ``close``, which waits for all.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int):
        self._spark, self._root, self._keep = spark, root, keep
        self._worker, self._open = ThreadPoolExecutor(1), list[Future]()

    def _reap(self, wait: bool) -> None:
        done = [f for f in self._open if wait or f.done()]
        self._open = [f for f in self._open if f not in done]
        failed = [e for f in done if (e := f.exception())]
        if failed:
            raise failed[0]

    def _copy(self, path: str) -> None:
        name = path.rstrip("/").rpartition("/")[2]
        copy(self._spark, path, f"{self._root}/{name}")
        write_text(self._spark, f"{self._root}/{LATEST}", name)
        prune(self._spark, self._root, self._keep, (name,))

    def submit(self, path: str) -> None:
        self._reap(False)
        self._open.append(self._worker.submit(self._copy, path))

    def close(self) -> None:
        try:
            self._reap(True)
        finally:
            self._worker.shutdown()

    def __enter__(self) -> Mirror:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def save_state(spark: SparkSession, root: str, step: int, model: str | DataFrame, state: Mapping, keep: int = 0) -> str:
    """Write a checkpoint of ``step``: the model and the run's state as JSON. One that is complete already stays as it is.

    A model is a table of its weights, which tasks write as Parquet, or a small text.
    """
    at = f"{root}/step-{step:08d}"
    if not set(REQUIRED) <= set(names(spark, at)):
        part = f"{at}.partial-{uuid.uuid4().hex}"
        if isinstance(model, DataFrame):
            model.write.option("compression", "zstd").parquet(f"{part}/{REQUIRED[0]}")
        else:
            write_text(spark, f"{part}/{REQUIRED[0]}", model)
        write_text(spark, f"{part}/{REQUIRED[1]}", json.dumps(dict(state) | {"step": step}, sort_keys=True))
        replace(spark, part, at)
        write_text(spark, f"{root}/{LATEST}", at.rpartition("/")[2])
    prune(spark, root, keep, (at.rpartition("/")[2],))
    return at


def load_state(spark: SparkSession, path: str) -> tuple[str, dict]:
    """Model text and state of a checkpoint; one that isn't complete raises."""
    at = resume_path(spark, path, [])
    return read_text(spark, f"{at}/{REQUIRED[0]}"), json.loads(read_text(spark, f"{at}/{REQUIRED[1]}"))


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Weights and state of a checkpoint whose model is a table; one that isn't complete raises."""
    at = resume_path(spark, path, [])
    return spark.read.parquet(f"{at}/{REQUIRED[0]}"), json.loads(read_text(spark, f"{at}/{REQUIRED[1]}"))


def bucket_rows(spark: SparkSession, root: str, bucket: str) -> DataFrame:
    """Rows of one bucket of an index: its own file ``<bucket>.parquet`` if there is one, else its directory."""
    if not re.fullmatch(r"\d{4}", bucket):
        raise ValueError(f"a bucket has four digits, not {bucket}")
    direct = f"{root}/{bucket}.parquet"
    if exists(spark, direct):
        return spark.read.parquet(direct).withColumn("bucket", F.lit(bucket))
    if not exists(spark, f"{root}/bucket={bucket}"):
        raise FileNotFoundError(f"{root} has no bucket {bucket}")
    return index.read(spark, root, [bucket])
