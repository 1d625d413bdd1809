"""Token ids in a content-addressed store.

Layout below the store's root, which lies in the folder that all machines share:

* ``packs/pack-NNNNNN.ids``: ``TLID``, version and id width (two unsigned 16-bit integers), then
  for each chunk its 16-byte BLAKE2b digest, its number of ids (unsigned 32-bit) and its ids, all
  little-endian (ids hold too little redundancy for compression to pay: 3 % of the bytes). Each chunk
  stands in one pack, once, in ascending order of the first document that holds it.
* ``recipes/recipe-NNNNNN.arrow``: Arrow streams in ascending (doc_id, row) order: which chunks make up which document.
* ``MANIFEST.json``: every pack with its number of chunks and Merkle root, every recipe file with its rows, ids and
  SHA-256, and the root over both. A file that is lost or altered, or an entry that is, stops every reader.

A document's ids are cut where a rolling hash over its last eight ids has nine leading zero bits
(64 ids at least, 4096 at most), so equal passages give equal chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import _text as tx
from tagloom.llm._pieces import Pieces
from tagloom.llm._work import files, new_dir, remove, stored, table, write_file

LEAST, MOST, ZERO_BITS = 64, 4096, 9
MAGIC, VERSION = b"TLID", 1
_ROLL = tx.mix(np.arange(1 << 17, dtype=np.uint64) + np.uint64(0x51ED270B))
_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in (1, 2, 4)]
UNIT = "part int, row long, doc_id long, n_doc long, at long, n long, digest binary, place long, loose string"
#: Documents in the store's order: equal doc_ids by task, then as read.
ORDER = ["doc_id", "part", "row", "at"]
#: Bytes of ids a pack and rows a recipe file has on average; bytes read at once from a loose file, and loose files held open, while packs are written.
PACK, ROWS, BLOCK, OPEN = 32 << 20, 1 << 18, 1 << 16, 256
RECIPE = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("n_doc", pa.int64()), ("digest", pa.binary())])


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash over eight ids allows a cut."""
    h = _ROLL[ids % len(_ROLL)]
    for k, p in zip((1, 2, 4), _P, strict=True):
        wider = h.copy()
        wider[k:] += h[:-k] * p
        h = wider
    return np.flatnonzero((h >> np.uint64(64 - ZERO_BITS)) == 0) + 1


def cut(start: int, end: int, points: np.ndarray) -> list[int]:
    """Ends of the chunks of ids[start:end]."""
    out, i = [], int(np.searchsorted(points, start + LEAST))
    while end - start > LEAST:
        i += int(np.searchsorted(points[i : i + MOST], start + LEAST))
        to = min(int(points[i]) if i < len(points) else end, start + MOST, end)
        if end - to < 1:
            break
        out.append(to)
        start = to
    return [*out, end]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over ``leaves``; an odd node goes up unchanged."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _crc_tables() -> np.ndarray:
    """[k][byte place][byte]: a CRC-32 register after 2**k zero bytes."""

    def apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]

    one = np.array([zlib.crc32(b"\0", (i << 8 * p) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for p in range(4) for i in range(256)], np.uint32).reshape(4, 256)
    out = [one]
    for _ in range(47):
        t = out[-1]
        out.append(np.stack([apply(t, x) for x in t]))
    return np.stack(out)


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What CRC-32 values add to the CRC of a text in which ``zeros`` more bytes follow: crc(A+B) = shift(crc(A), len B) ^ crc(B)."""
    if not hasattr(crc_shift, "tables"):
        crc_shift.tables = _crc_tables()
    c, k = crc.astype(np.uint32), 0
    while (zeros >> k).any():
        t, on = crc_shift.tables[k], ((zeros >> k) & 1).astype(bool)
        x = c[on]
        c[on] = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
        k += 1
    return c


def _head(width: int) -> bytes:
    return MAGIC + struct.pack("<HH", VERSION, width)


def _tokenise(tokenizer: str, end_id: int, width: int, root: str):
    """Chunks of each document; the ids of a chunk new to the task go to ``place`` in the loose file of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, row = Pieces.of(tokenizer), TaskContext.get().partitionId(), 0
        name = f"{part:06d}-{uuid.uuid4().hex}"  # of this attempt: rows of a failed one never count
        system, path = files(f"{root}/loose")
        system.create_dir(path, recursive=True)
        seen: set[bytes] = set()
        end = 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in tx.slices(batches, "text"):
                data, offsets = tx.column(batch.column("text"))
                ids, first = pieces.ids(data, offsets)
                ids = np.insert(ids, first[1:], end_id)
                first = first + np.arange(len(first))
                points, raw = cut_points(ids), ids.astype(f"<u{width}").tobytes()
                doc, at, n, digest, place = [], [], [], [], []
                for d in range(batch.num_rows):
                    a = s = int(first[d])
                    for b in cut(a, int(first[d + 1]), points):
                        x = raw[a * width : b * width]
                        key = hashlib.blake2b(x, digest_size=16).digest()
                        doc.append(d), at.append(a - s), n.append(b - a), digest.append(key)
                        place.append(None if key in seen else end)
                        if key not in seen:
                            seen.add(key)
                            out.write(x)
                            end += len(x)
                        a = b
                doc = np.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), pa.array(row + doc), batch.column("doc_id").take(pa.array(doc)), pa.array(np.diff(first)[doc]), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(place, pa.int64()), pa.array([name] * len(doc), pa.string())],
                    names=["part", "row", "doc_id", "n_doc", "at", "n", "digest", "place", "loose"],
                )
                row += batch.num_rows

    return run


def _chunks(f, name: str, width: int) -> Iterator[tuple[bytes, bytes]]:
    """(digest, ids) of an open pack."""
    if f.read(8) != _head(width):
        raise ValueError(f"{name}: not a pack of this version and width")
    while mark := f.read(20):
        size = struct.unpack("<I", mark[16:])[0] * width if len(mark) == 20 else -1
        x = f.read(size) if size >= 0 else b""
        if len(x) != size:
            raise ValueError(f"{name}: it ends inside a chunk")
        yield mark[:16], x


class Loose:
    """The loose files, read in blocks: each is in document order, so the rows of a pack go forward in it."""

    def __init__(self, root: str) -> None:
        self.system, self.path = files(f"{root}/loose")
        self.held: OrderedDict[str, tuple] = OrderedDict()

    def read(self, name: str, place: int, size: int) -> bytes:
        f, start, block = self.held.pop(name, None) or (self.system.open_input_file(f"{self.path}/{name}"), 0, b"")
        if place < start or place + size > start + len(block):
            f.seek(place)
            start, block = place, f.read(max(size, BLOCK))
        self.held[name] = f, start, block
        if len(self.held) > OPEN:
            self.held.popitem(last=False)[1][0].close()
        if len(x := block[place - start : place - start + size]) != size:
            raise ValueError(f"{name}: it ends inside a chunk")
        return x


def _write_packs(root: str, width: int):
    """From a partition's rows (digest, loose, place, n) in document order: one pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, leaves, ids, loose = f"pack-{TaskContext.get().partitionId():06d}.ids", [], 0, Loose(root)

        def parts() -> Iterator[bytes]:
            nonlocal ids
            yield _head(width)
            for batch in batches:
                for key, at, place, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "loose", "place", "n")), strict=True):
                    leaves.append(key)
                    ids += n
                    yield key + struct.pack("<I", n) + loose.read(at, place, n * width)

        size = write_file(f"{root}/packs/{name}", parts())
        yield pa.RecordBatch.from_pydict({"pack": [name], "chunks": [len(leaves)], "ids": [ids], "bytes": [size], "merkle": [merkle(leaves).hex()]})

    return run


def _write_recipes(root: str):
    """From a partition's rows in document order: one recipe file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha, rows, docs, ids = f"recipe-{TaskContext.get().partitionId():06d}.arrow", hashlib.sha256(), 0, 0, 0

        def parts() -> Iterator[bytes]:
            nonlocal rows, docs, ids
            held = io.BytesIO()

            def spent() -> bytes:
                x = held.getvalue()
                held.seek(0), held.truncate()
                sha.update(x)
                return x

            with pa.ipc.new_stream(held, RECIPE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in batches:
                    rows += batch.num_rows
                    docs += int(np.count_nonzero(batch.column("at").to_numpy() == 0))
                    ids += int(batch.column("n").to_numpy().sum())
                    out.write_batch(pa.RecordBatch.from_arrays([batch.column(f.name) for f in RECIPE], schema=RECIPE))
                    yield spent()
            yield spent()

        size = write_file(f"{root}/recipes/{name}", parts())
        yield pa.RecordBatch.from_pydict({"recipe": [name], "rows": [rows], "docs": [docs], "ids": [ids], "bytes": [size], "sha256": [sha.hexdigest()]})

    return run


def _root(packs: list[dict], recipes: list[dict]) -> str:
    return merkle([bytes.fromhex(p["merkle"]) for p in packs] + [bytes.fromhex(r["sha256"]) + struct.pack("<QQQ", r["rows"], r["docs"], r["ids"]) for r in recipes]).hex()


def write_store(docs: DataFrame, tokenizer: str, root: str, end_id: int = 0) -> dict:
    """Encode ``docs`` (doc_id, text) into a store at ``root``; returns its manifest.

    Each text is encoded whole (null: empty) without added special tokens and ``end_id`` put after
    it, so an empty text is one id. Rows of equal doc_id keep the order in which they were read; null
    doc_ids come first. Other columns are left out. An empty table gives a store without documents.

    A task sorts its documents and writes the chunks that are new to it into a loose file of its own;
    ids are never shuffled. Then digests alone decide which occurrence of a chunk is kept, the one of the
    first document, and each pack takes a range of the kept ones from the loose files, going forward in
    each. The loose files go at the end.
    """
    spark = docs.sparkSession
    width = 2 if len(Pieces.of(tokenizer).width) <= 65536 else 4
    run = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("read")).sortWithinPartitions("doc_id", "read").select("doc_id", "text")
    staged = stored(run.mapInArrow(_tokenise(tokenizer, end_id, width, root), UNIT), "ids-staged")
    first = staged.where("place is not null").groupBy("digest").agg(F.min(F.struct(*ORDER, "n", "loose", "place")).alias("first"))
    kept = stored(first.select("digest", "first.*"), "ids-kept")
    count = max(1, -(-(kept.agg(F.sum("n")).first()[0] or 0) * width // PACK))  # rows are small, what they stand for isn't
    recipe_count = max(1, -(-staged.count() // ROWS))
    packs = kept.repartitionByRange(count, *ORDER).sortWithinPartitions(*ORDER).select("digest", "loose", "place", "n").mapInArrow(_write_packs(root, width), "pack string, chunks long, ids long, bytes long, merkle string").collect()  # a row for each file
    recipes = staged.select(*RECIPE.names).repartitionByRange(recipe_count, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(_write_recipes(root), "recipe string, rows long, docs long, ids long, bytes long, sha256 string").collect()  # a row for each file
    remove(spark, staged, kept, f"{root}/loose")
    packs, recipes = (sorted((x.asDict() for x in rows), key=lambda x: x[name]) for rows, name in ((packs, "pack"), (recipes, "recipe")))
    manifest = {"version": VERSION, "width": width, "end_id": end_id, "packs": packs, "recipes": recipes, "merkle": _root(packs, recipes)}
    write_file(f"{root}/MANIFEST.json", [json.dumps(manifest, indent=1).encode()])
    return manifest


def read_manifest(root: str) -> dict:
    system, path = files(f"{root}/MANIFEST.json")
    with system.open_input_stream(path, compression=None) as f:
        manifest = json.loads(f.read())
    if _root(manifest["packs"], manifest["recipes"]) != manifest["merkle"]:
        raise ValueError("the manifest's packs and recipes don't give its Merkle root")
    return manifest


def _pack_reader(root: str, payload: bool, width: int):
    """Read whole packs, check every digest and the pack's Merkle root, give (digest, n, crc, payload)."""

    def batch_of(digest: list, n: list, crc: list, content: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(content, pa.binary())], names=["digest", "n", "crc", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                system, path = files(f"{root}/packs/{p['pack']}")
                leaves: list[bytes] = []
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
                    digest, n, crc, content = [], [], [], []
                    for key, x in _chunks(f, p["pack"], width):
                        if hashlib.blake2b(x, digest_size=16).digest() != key:
                            raise ValueError(f"{p['pack']}: a chunk differs from its digest")
                        digest.append(key), n.append(len(x) // width), content.append(x if payload else None)
                        crc.append(zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()))
                        leaves.append(key)
                        if len(digest) == 2000:
                            yield batch_of(digest, n, crc, content)
                            digest, n, crc, content = [], [], [], []
                    yield batch_of(digest, n, crc, content)
                if merkle(leaves).hex() != p["merkle"]:
                    raise ValueError(f"{p['pack']}: Merkle root differs")

    return run


def read_chunks(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """All chunks of the store (digest, n, crc, payload), read from its packs and verified."""
    manifest = read_manifest(root)
    packs = [(p["pack"], p["merkle"]) for p in manifest["packs"]]
    listed = spark.createDataFrame(packs, "pack string, merkle string").repartition(max(1, len(packs)))
    return listed.mapInArrow(_pack_reader(root, payload, manifest["width"]), "digest binary, n long, crc long, payload binary")


def _recipe_reader(root: str):
    """Read whole recipe files, check their hash and that chunks follow one another, give ``start``: the ids before each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in batches:
            for r in listed.to_pylist():
                system, path = files(f"{root}/recipes/{r['recipe']}")
                with system.open_input_stream(path, compression=None) as f:
                    raw = f.read()
                if hashlib.sha256(raw).hexdigest() != r["sha256"]:
                    raise ValueError(f"{r['recipe']}: it differs from its hash")
                start = r["before"]
                for batch in pa.ipc.open_stream(raw):
                    at, n, whole = (batch.column(c).to_numpy() for c in ("at", "n", "n_doc"))
                    ends = at + n
                    if not np.all((at[1:] == ends[:-1]) | ((at[1:] == 0) & (ends[:-1] == whole[:-1]))):
                        raise ValueError(f"{r['recipe']}: a document's chunks don't follow one another")
                    upto = start + np.cumsum(n)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - n)], names=[*RECIPE.names, "start"])
                    start = int(upto[-1]) if len(upto) else start

    return run


def _recipes(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """All recipes with ``start``, the number of ids before each chunk in ascending document order."""
    before, listed = 0, []
    for r in manifest["recipes"]:
        listed.append((r["recipe"], r["sha256"], before))
        before += r["ids"]
    files_ = spark.createDataFrame(listed, "recipe string, sha256 string, before long").repartition(max(1, len(listed)))
    return files_.mapInArrow(_recipe_reader(root), "doc_id long, part int, row long, at long, n long, n_doc long, digest binary, start long")


def _agreed(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("long"))


def _with_chunks(spark: SparkSession, root: str, payload: bool) -> DataFrame:
    """Every chunk of every document with what the packs hold of it; its number of ids is the pack's."""
    manifest = read_manifest(root)
    held = read_chunks(spark, root, payload).withColumnRenamed("n", "in_pack")
    # the packs' names are a small table, but what they hold isn't: no broadcast
    whole = _recipes(spark, root, manifest).hint("merge").join(held.hint("merge"), "digest", "left")
    return whole.withColumn("n", _agreed(F.col("in_pack") == F.col("n"), F.col("in_pack"), "a recipe names a chunk that no pack holds with as many ids"))


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of the store.

    Each unique chunk is read from its pack, and its CRC and ids are taken once; a document's CRC is the XOR of its
    chunks' CRCs, each shifted by the bytes behind it, so no ids are shuffled.
    """

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc, behind = b.column("crc").to_numpy().astype(np.uint32), b.column("behind").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "part", "row", "begin", "n", "n_doc")), pa.array(crc_shift(crc, behind * 4).astype(np.int64))], names=["doc_id", "part", "row", "begin", "n", "n_doc", "crc"])

    joined = _with_chunks(spark, root, payload=False).select("doc_id", "part", "row", (F.col("start") - F.col("at")).alias("begin"), "n", "n_doc", "crc", (F.col("n_doc") - F.col("at") - F.col("n")).alias("behind"))
    moved = joined.mapInArrow(shift, "doc_id long, part int, row long, begin long, n long, n_doc long, crc long")
    whole = moved.groupBy("doc_id", "part", "row").agg(F.min("begin").alias("start"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.max("n_doc").alias("n_doc"))
    return whole.select("doc_id", "start", _agreed(F.col("n_tokens") == F.col("n_doc"), F.col("n_tokens"), "a document lacks chunks").alias("n_tokens"), "ids_crc32")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start and ids (array<long>) of every document, put together from its chunks."""
    width = read_manifest(root)["width"]

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x["payload"] for x in c), f"<u{width}").astype(np.int64) for c in b.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    docs = _with_chunks(spark, root, payload=True).groupBy("doc_id", "part", "row").agg(F.min(F.col("start") - F.col("at")).alias("start"), F.array_sort(F.collect_list(F.struct("at", "n", "payload"))).alias("chunks"))
    return docs.select("doc_id", "start", "chunks").mapInArrow(join_up, "doc_id long, start long, ids array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_dir(spark, "ids")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), root)
    return read_digests(spark, root)


QUERIES = {"op5_id_store": query}
ORACLE: dict[str, str] = {}
