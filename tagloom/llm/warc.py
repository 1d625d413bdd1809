"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size.

Each record is a gzip member of its own (WARC/1.1). Headers, record ids and digests are made anew
from the row, so the same pages give the same bytes. A task writes a file under a temporary name
and renames it; the manifest, written last, lists the files that count and their SHA-256.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm._work import files, new_dir, table, write_file

SPACE_ID = uuid.UUID("6d1f4a52-8f0b-5f6e-9d5c-0c7c7d7d8a11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, again: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page_id}/{digest}' + (f'/{again}' if again else ''))}>"


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    lines = ["WARC/1.1", *(f"{k}: {clean(v)}" for k, v in head), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress(CRLF.join(lines).encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: bool, refers_to: int | None, date: str, again: int) -> bytes:
    """One response or revisit record; the payload of a revisit isn't repeated."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    block = http if revisits else http + payload
    head = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", record_id(page_id, digest, again)), ("WARC-Date", date), ("WARC-Target-URI", url or f"urn:page:{page_id}"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32(block)}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisits:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _member(head, block)


def _write(root: str, roll: int, date: str):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        mark, refers, last, again = None, None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["page_id"], r["digest"])
                if r["kind"] == 0:
                    mark, refers = key, r["refers_to"]
                    continue
                again, last = (again + 1 if key == last else 0), key
                payload = (r["html"] or "").encode()
                yield record(r["page_id"], r["url"], payload, base32(payload), key == mark, refers if key == mark else None, date, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, part, number = records(batches), TaskContext.get().partitionId(), 0
        ahead = next(rest, None)
        while ahead is not None:
            name, sha, count = f"part-{part:06d}-{number:05d}.warc.gz", hashlib.sha256(), 0

            def parts() -> Iterator[bytes]:
                nonlocal ahead, count
                info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                size = len(info)
                sha.update(info)
                yield info
                while ahead is not None and (size < roll or not count):
                    sha.update(ahead)
                    size, count = size + len(ahead), count + 1
                    yield ahead
                    ahead = next(rest, None)

            size = write_file(f"{root}/{name}", parts())
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count], "bytes": [size], "sha256": [sha.hexdigest()]})
            number += 1

    return run


def write_archives(pages: DataFrame, root: str, least: int = 0, roll: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> dict:
    """Write ``pages`` (page_id, url, html) as archives below ``root``; returns the manifest.

    Of pages whose payloads (html in UTF-8, null: empty) are equal and hold ``least`` bytes or more,
    the one with the largest page_id is the response and the others revisit it; smaller ones are all
    responses. Rows that repeat this page_id with this payload are responses too. A null page_id
    sorts first and revisits an equal payload that has an id. Only (page_id, digest) meets by
    payload, summed up before the shuffle; html is moved once, by range of page_id. Other columns
    are left out. A file ends at the first record that brings it to ``roll`` compressed bytes.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"))
    sized = rows.select("page_id", "digest", F.octet_length(html).alias("size")).where(F.col("size") >= least).select("page_id", "digest").groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    response = sized.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("ids")).where("ids > 1").drop("ids")
    marks = sized.drop("rows").join(response, "digest").where("page_id is null or page_id < refers_to")
    both = marks.selectExpr("page_id", "digest", "0 as kind", "refers_to", "string(null) as url", "string(null) as html").unionByName(rows.selectExpr("page_id", "digest", "1 as kind", "bigint(null) as refers_to", "url", "html"))
    sorted_ = both.repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url")
    done = sorted_.mapInArrow(_write(root, roll, date), "file string, records long, bytes long, sha256 string").collect()  # a row for each file
    manifest = {"files": sorted((f.asDict() for f in done), key=lambda f: f["file"])}
    write_file(f"{root}/MANIFEST.json", [json.dumps(manifest, indent=1).encode()])
    return manifest


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed archive."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, block


def _read(root: str, payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name, wanted in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                system, path = files(f"{root}/{name}")
                rows, seen = [], 0
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="rb") as f:
                    for head, block in parse(f):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        if head["WARC-Block-Digest"] != f"sha1:{base32(block)}":
                            raise ValueError(f"{name}: a block differs from its digest")
                        body, digest = block.partition(b"\r\n\r\n")[2], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and base32(body) != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), int(head["X-Payload-Length"]) if revisit else len(body), digest, head["WARC-Type"], refers and int(refers), head["WARC-Target-URI"], body if payload and not revisit else None))
                        seen += 1
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                            rows = []
                if seen != wanted:
                    raise ValueError(f"{name}: {seen} records instead of {wanted}")
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return run


def read_archives(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """Every record of the archives that the manifest at ``root`` lists, with blocks and payloads verified."""
    system, path = files(f"{root}/MANIFEST.json")
    with system.open_input_stream(path, compression=None) as f:
        listed = [(x["file"], x["records"]) for x in json.loads(f.read())["files"]]
    names = spark.createDataFrame(listed, "file string, records long").repartition(max(1, len(listed)))
    return names.mapInArrow(_read(root, payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), root)
    return read_archives(spark, root, payload=False).drop("url", "payload")


QUERIES = {"op6_warc": query}
ORACLE = {
    "op6_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, h, sha1(h) as x, max(page_id) over (partition by h) as m from p)
select page_id, strlen(h)::BIGINT as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(x, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INTEGER + 1, 1)), '') as payload_digest,
  case when page_id < m then 'revisit' else 'response' end as record_type,
  case when page_id < m then m end as refers_to
from d
"""
}
