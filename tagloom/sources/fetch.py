"""Resumable download of shards into a shared cache, as a Spark job over ranges.

A shard is fetched in segments of a fixed size, each a file of its own that is written whole, so a
large shard is shared by many tasks and a killed job, a lost executor or a second attempt begins with
the first segment that isn't there. Inside a segment a broken connection is resumed at the byte that
it broke at. When a shard's segments add up to its size they become one file.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import paths
from tagloom.sources import shared, store

# The host that gets the token, and bytes of a read.
TOKEN_HOST, READ = "huggingface.co", 256 * 1024
SEGMENT = 8 << 20
PARTS = ".parts"


def headers(url: str, start: int | None = None, stop: int | None = None, token: str | None = None) -> dict[str, str]:
    """Range from ``start`` up to ``stop``, and the token if the host is the hub; no other host sees it."""
    out = {"User-Agent": "shard-fetch"}
    if start is not None:
        out["Range"] = f"bytes={start}-{'' if stop is None else stop - 1}"
    host = urllib.parse.urlparse(url).hostname or ""
    if token and (host == TOKEN_HOST or host.endswith(f".{TOKEN_HOST}")):
        out["Authorization"] = f"Bearer {token}"
    return out


def response_total(content_range: str | None, content_length: str | None, existing: int, status: int) -> int | None:
    """Bytes of the whole file: the range's total, else the length, on top of what is there if the answer is a part."""
    found = re.search(r"/(\d+)$", content_range or "")
    if found:
        return int(found[1])
    if content_length and content_length.isdigit():
        return int(content_length) + (existing if status == 206 else 0)
    return None


class Answer:
    """A started answer: ``status`` (206: the range asked for, 200: the whole file), ``total`` bytes or None, and its bytes."""

    def __init__(self, url: str, start: int, stop: int | None, token: str | None, timeout: float):
        if url.startswith(("http://", "https://")):
            try:
                self._raw = urllib.request.urlopen(urllib.request.Request(url, headers=headers(url, start, stop, token)), timeout=timeout)
            except urllib.error.HTTPError as error:
                if error.code in (401, 403):
                    raise PermissionError(f"{url}: refused ({error.code}); accept its terms and give a token that may read it") from error
                raise
            self.status = self._raw.status
            self.total = response_total(self._raw.headers.get("Content-Range"), self._raw.headers.get("Content-Length"), start, self.status)
        else:
            size = shared.size_of(url)
            if size is None:
                raise FileNotFoundError(f"{url}: neither an address nor a file")
            self._raw, self.status, self.total = None, 206, size
            self._chunks = shared.chunks(url, start, stop, READ)

    def __iter__(self) -> Iterator[bytes]:
        if self._raw is None:
            yield from self._chunks
            return
        while x := self._raw.read(READ):
            yield x

    def close(self) -> None:
        if self._raw is not None:
            self._raw.close()


def retried(action: Callable, tries: int, wait: float):
    """``action()``, tried again after wait, 2 wait, 4 wait, at most 8 wait; a refusal isn't tried again."""
    for n in range(tries):
        try:
            return action()
        except PermissionError:
            raise
        except OSError:
            if n + 1 == tries:
                raise
            time.sleep(min(2**n, 8) * wait)


class Transfer:
    """How to fetch: tries, seconds of the first pause, seconds until a silent connection counts as broken, token."""

    def __init__(self, tries: int = 4, wait: float = 1.0, timeout: float = 120.0, token: str | None = None):
        if tries < 1:
            raise ValueError("tries must be positive")
        self.tries, self.wait, self.timeout, self.token = tries, wait, timeout, token

    def probe(self, url: str) -> tuple[int | None, bool]:
        """Bytes of a shard (None: not stated), and whether ranges of it can be asked for."""

        def ask():
            answer = Answer(url, 0, None, self.token, self.timeout)
            answer.close()
            return answer.total, answer.status == 206

        return retried(ask, self.tries, self.wait)

    def range(self, url: str, start: int, stop: int) -> Iterator[bytes]:
        """The bytes from ``start`` up to ``stop``; where the connection breaks it goes on behind the last byte."""
        got, failed = start, 0
        while got < stop:
            try:
                answer = Answer(url, got, stop, self.token, self.timeout)
                try:
                    if answer.status != 206:
                        raise ConnectionError(f"{url}: no range (status {answer.status})")
                    for x in answer:
                        x = x[: stop - got]
                        got += len(x)
                        yield x
                finally:
                    answer.close()
                if got < stop:
                    raise ConnectionError(f"{url}: ended at {got:,} of {stop:,} bytes")
            except PermissionError:
                raise
            except OSError:
                failed += 1
                if failed >= self.tries:
                    raise
                time.sleep(min(2 ** (failed - 1), 8) * self.wait)

    def whole(self, url: str) -> bytes | Iterator[bytes]:
        """All bytes of a shard that gives no ranges: nothing of it can be resumed."""
        answer = Answer(url, 0, None, self.token, self.timeout)
        n = 0
        try:
            for x in answer:
                n += len(x)
                yield x
        finally:
            answer.close()
        if answer.total is not None and n != answer.total:
            raise ConnectionError(f"{url}: {n:,} of {answer.total:,} bytes")

    def segment(self, url: str, cache: str, name: str, start: int, size: int) -> bool:
        """Have the segment at ``start`` in the cache; whether it had to be fetched."""
        at = f"{cache}/{name}{PARTS}/{start:015d}"
        if shared.size_of(at) == size:
            return False
        shared.write_whole(at, self.range(url, start, start + size))
        return True

    def assemble(self, cache: str, name: str, starts: list[int], total: int) -> str:
        """One file of all segments; their folder goes once the file stands."""
        at = f"{cache}/{name}"
        if shared.size_of(at) != total:
            n = shared.write_whole(at, (x for s in sorted(starts) for x in shared.chunks(f"{at}{PARTS}/{s:015d}")))
            if n != total:
                system, path = shared.files(at)
                system.delete_file(path)
                raise ConnectionError(f"{name}: {n:,} of {total:,} bytes")
        system, path = shared.files(at + PARTS)
        if system.get_file_info(path).type.name == "Directory":
            system.delete_dir(path)
        return at

    def one(self, url: str, cache: str, name: str, segment: int = SEGMENT) -> str:
        """Have one shard in the cache, from a single task; its place there."""
        at = f"{cache}/{name}"
        if shared.size_of(at) is not None:
            return at
        total, ranged = self.probe(url)
        if total is None or not ranged:
            retried(lambda: shared.write_whole(at, self.whole(url)), self.tries, self.wait)
            return at
        starts = list(range(0, total, segment))
        for s in starts:
            self.segment(url, cache, name, s, min(segment, total - s))
        return self.assemble(cache, name, starts, total)


def used_bytes(spark: SparkSession, cache: str) -> int:
    """Bytes of all files below the cache, segments included."""
    system, p = store._at(spark, cache)
    return system.getContentSummary(p).getLength() if system.exists(p) else 0


def check_room(spark: SparkSession, cache: str, more: int, least_free: int = 0, most: int | None = None) -> None:
    """Raise unless ``more`` bytes fit: ``least_free`` stay free on the cache's file system, and the whole cache stays within ``most``."""
    system, p = store._at(spark, cache)
    free = system.getStatus(p if system.exists(p) else None).getRemaining()
    if free < least_free + more:
        raise OSError(f"{cache}: {free:,} bytes free, {least_free + more:,} needed")
    used = used_bytes(spark, cache)
    if most is not None and used + more > most:
        raise OSError(f"{cache}: {used:,} bytes and {more:,} more go beyond {most:,}")


def _probe(how: Transfer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [how.probe(u) for u in batch.column("address").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found])], names=[*batch.schema.names, "total", "ranged"])

    return run


def _segments(how: Transfer, cache: str, fail_after: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            fresh = []
            for r in batch.to_pylist():
                if fail_after is not None and done >= fail_after:
                    raise ConnectionAbortedError("stopped on purpose")
                done += 1
                if r["ranged"]:
                    fresh.append(how.segment(r["address"], cache, r["name"], r["start"], r["size"]))
                else:
                    retried(lambda r=r: shared.write_whole(f"{cache}/{r['name']}", how.whole(r["address"])), how.tries, how.wait)
                    fresh.append(True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fresh, pa.bool_())], names=[*batch.schema.names, "fresh"])

    return run


def _assemble(how: Transfer, cache: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["ranged"]:
                    how.assemble(cache, r["name"], r["starts"], r["total"])
            at = [f"{cache}/{r['name']}" for r in rows]
            yield pa.RecordBatch.from_pydict({"source": [r["source"] for r in rows], "path": at, "nbytes": pa.array([shared.size_of(a) for a in at], pa.int64()), "segments": pa.array([len(r["starts"]) for r in rows], pa.int64()), "fetched": pa.array([r["fetched"] for r in rows], pa.int64())})

    return run


FETCHED = "source string, path string, nbytes long, segments long, fetched long"


def fetch(spark: SparkSession, sources: DataFrame, cache: str, how: Transfer | None = None, segment: int = SEGMENT, least_free: int = 0, most: int | None = None, fail_after: int | None = None) -> DataFrame:
    """Have every shard of ``sources`` (source) in ``cache``; source, path, nbytes, segments and fetched (how many of them this run brought).

    A source is a path, a URI of the file system, an http address or a hub shard; equal ones are fetched
    once, null ones left out. Shards that are in the cache already have no segments to fetch. Both limits
    on disk are checked before anything is fetched: what is to be kept free, and the size of the whole
    cache. ``fail_after`` stops every task after so many segments, to try a restart.
    """
    how = how or Transfer()
    known = F.col("source").isNotNull()  # said again: filters may be evaluated in any order
    address = F.when(known, F.coalesce(paths.hub_address(F.col("source")), F.raise_error(F.concat(F.lit("not a shard of the hub: "), "source")).cast("string")))
    named = sources.select("source").where("source is not null").distinct().withColumn("address", address).withColumn("name", paths.cache_name(F.col("address")))
    have = spark.createDataFrame([(n,) for n in store.names(spark, cache) if not n.endswith(PARTS)], "name string")
    there = named.join(have, "name").select("source", F.concat(F.lit(f"{cache}/"), "name").alias("path"))
    absent = named.join(have, "name", "left_anti").repartition(spark.sparkContext.defaultParallelism)
    probed = shared.kept(absent.mapInArrow(_probe(how), ", ".join(f"{c} string" for c in absent.columns) + ", total long, ranged boolean"), shared.new_dir(spark, "fetch-plan"))
    ranged = F.col("ranged") & F.col("total").isNotNull()
    needed = probed.agg(F.coalesce(F.sum("total"), F.lit(0))).head()[0]
    resumed = sum(used_bytes(spark, f"{cache}/{n}") for n in store.names(spark, cache) if n.endswith(PARTS))
    check_room(spark, cache, max(0, needed - resumed), least_free, most)
    starts = F.when(ranged & (F.col("total") > 0), F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(segment).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    rows = probed.withColumn("ranged", ranged).withColumn("start", F.explode(starts)).withColumn("size", F.least(F.lit(segment), F.col("total") - F.col("start")))
    spread = rows.repartition(spark.sparkContext.defaultParallelism * 4, "name", "start")
    schema = ", ".join(f"{n} {t}" for n, t in spread.dtypes) + ", fresh boolean"
    done = spread.mapInArrow(_segments(how, cache, fail_after), schema)
    per = done.groupBy("source", "name", "total", "ranged").agg(F.sort_array(F.collect_list("start")).alias("starts"), F.count_if("fresh").alias("fetched"))
    made = shared.kept(per.mapInArrow(_assemble(how, cache), FETCHED), shared.new_dir(spark, "fetched"))
    before = there.mapInArrow(_sizes, FETCHED)
    return made.unionByName(before)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        nbytes = [shared.size_of(p) for p in batch.column("path").to_pylist()]
        zero = pa.array([0] * n, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("path"), pa.array(nbytes, pa.int64()), zero, zero], names=["source", "path", "nbytes", "segments", "fetched"])
