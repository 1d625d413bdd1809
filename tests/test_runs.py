"""Run metrics, checks over runs, compaction behind a pointer, bucket files, zips, and the bytes a header takes."""

import struct

import pytest
from pyspark.sql import functions as F

from sources_helpers import png
from tagloom.operators import batching, index, ingest, preflight
from tagloom.sources import images, store
from tagloom.streaming.metrics import RunLog


def jpeg(width, height, padding=50_000):
    app = b"\xff\xe1" + struct.pack(">H", padding + 2) + b"\xff\xc0" * (padding // 2)  # looks like a size, inside a segment
    return b"\xff\xd8" + app + b"\xff\xff\xff\xdb" + struct.pack(">H", 4) + b"xx" + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, height, width) + b"\0" * 90_000


def test_headers_take_a_few_bytes(spark, tmp_path):
    files = {"a.png": png(640, 480) + b"\0" * 200_000, "b.JPG": jpeg(48, 64), "c.bmp": b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20) + b"\0" * 99_999, "d.png": b"x", "e.jpeg": b"\xff\xd8\xff\xda" + b"\0" * 50, "f.webp": b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "note.txt").write_text("x" * 1000)
    got = {r["path"].rpartition("/")[2]: r for r in images.heads(images.listing(spark, str(tmp_path), (".png", ".jpg", ".jpeg", ".bmp", ".webp"))).collect()}
    assert {n: (r["width"], r["height"]) for n, r in got.items()} == {"a.png": (640, 480), "b.JPG": (48, 64), "c.bmp": (30, 20), "d.png": (None, None), "e.jpeg": (None, None), "f.webp": (100, 50)}
    assert max(r["bytes_read"] for r in got.values()) < 120
    assert images.image_size(jpeg(7, 9)) == (7, 9) and images.image_size(b"\xff\xd8\xff") is None
    assert images.size_at(lambda a, n: (b"\xff\xd8" + b"\xff" * 99_999)[a : a + n]) is None  # padding without end


def index_of(spark, n=60, modulus=4):
    return index.build(spark.createDataFrame([(i, "a b") for i in range(n)], "id bigint, tag_string string").repartition(3), modulus)


def test_a_crash_leaves_the_fragments_readable(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        store.compact(spark, root)
    first = store.publish_version(spark, root, lambda at: index.write(index_of(spark), at, False))
    reader = index.read(spark, store.current(spark, root))
    for step in ("write_text", "_figures"):
        calls = []

        def crash(*a, real=getattr(store, step), **k):
            calls.append(a)
            if step == "write_text" or len(calls) == 2:
                raise OSError("gone")
            return real(*a, **k)

        monkeypatch.setattr(store, step, crash)
        with pytest.raises(OSError):
            store.compact(spark, root)
        monkeypatch.undo()
        assert store.current(spark, root) == first and index.read(spark, first).count() == 60
    with monkeypatch.context() as m:
        m.setattr(index, "write", lambda df, to, whole=True, write=index.write: write(df.where("id > 3"), to, whole))
        with pytest.raises(ValueError, match="doesn't hold the rows"):
            store.compact(spark, root)
    assert store.current(spark, root) == first
    done = store.compact(spark, root)
    assert done["buckets"] == done["after"] == 4 < done["before"]
    assert reader.count() == 60  # a reader of the fragments goes on


def test_a_bucket_is_a_file_or_a_directory(spark, tmp_path):
    at = str(tmp_path / "i")
    index.write(index_of(spark), at)
    assert store.bucket_rows(spark, at, "0001").count() == 15
    index_of(spark).where("bucket = '0001' and id < 20").drop("bucket").coalesce(1).write.parquet(f"{at}/0001.parquet")
    got = store.bucket_rows(spark, at, "0001")
    assert sorted(r["id"] for r in got.collect()) == [1, 5, 9, 13, 17] and {r["bucket"] for r in got.collect()} == {"0001"}
    with pytest.raises(FileNotFoundError):
        store.bucket_rows(spark, at, "0009")
    with pytest.raises(ValueError):
        store.bucket_rows(spark, at, "1")


def test_metrics_equal_a_batch_aggregate_and_outlive_a_restart(spark, tmp_path):
    root = str(tmp_path / "run")
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    log = RunLog(spark, root)
    assert log.table().count() == 0
    for step in (1, 2, 2):  # the second step is done twice
        out = log.written(df.where(F.col("id") % step == 0), f"{root}/t{step}-{len(list(tmp_path.glob('run/t*')))}", step, n=F.count(F.lit(1)), s=F.sum("x"), none=F.max(F.when(F.col("id") < 0, 1)), text=F.max(F.lit("a")))
        assert out.count() == 100 // step
    again = RunLog(spark, root)
    assert again.run_id == log.run_id
    got = {(r["step"], r["name"]): r["value"] for r in again.table().collect()}
    assert got == {(1, "n"): 100, (1, "s"): 9900, (1, "none"): None, (2, "n"): 50, (2, "s"): 4900, (2, "none"): None}
    assert {r["run_id"] for r in again.table().collect()} == {log.run_id}
    assert RunLog(spark, str(tmp_path / "other")).run_id != log.run_id


def test_figures_that_are_being_written_are_not_read(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "run"))
    log.record(1, {"a": 1.0})
    (tmp_path / "run" / "metrics" / "step-000000000002.json.partial-0a").write_text('{"name": "half')
    assert [r["name"] for r in log.table().collect()] == ["a"]


def test_a_listener_keeps_every_micro_batch(spark, tmp_path):
    import time

    log = RunLog(spark, str(tmp_path / "run"))
    listener = log.listener()
    spark.streams.addListener(listener)
    try:
        src = tmp_path / "in"
        src.mkdir()
        for i in range(3):
            (src / f"{i}.txt").write_text("line\n" * (i + 1))
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(src)).observe("seen", F.count(F.lit(1)).alias("n"))
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        for _ in range(100):
            rows = {(r["step"], r["name"]): r["value"] for r in log.table().collect()}
            if sum(k[1] == "input_rows" for k in rows) >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(v for (_, n), v in rows.items() if n == "input_rows") == sum(v for (_, n), v in rows.items() if n == "seen.n") == 6


def test_checks_of_a_configuration_and_its_surroundings(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(b"x")
    at = str(tmp_path / "index")
    store.publish(spark, index_of(spark, 3000, 1000), at, "posts")
    fine = {"name": "fine", "data": {"backend": "rolling_raw", "batch_size": 4, "rolling_block_size": 64, "prefetch_shards": 1, "shards": [str(tmp_path / "a.tar")], "index_source": "posts", "least_free_bytes": 1}, "train": {"gradient_accumulation_steps": 8, "text_cache_size": 64, "optimizer": "adamw", "precision": "bf16"}, "model": {"gradient_checkpointing": False}}
    got = preflight.preflight(preflight.surroundings(spark, fine, at, str(tmp_path), str(tmp_path)))
    assert {r["name"]: r["level"] for r in got.collect()} == dict.fromkeys(["gradient checkpointing", "backend", "rolling block", "shards", "index", "optimizer", "precision", "disk", "mirror"], "ok")
    bad = {**fine, "data": {**fine["data"], "shards": ["lost.tar", "hf://datasets/a/b/c.tar"], "rolling_block_size": 30, "least_free_bytes": 1 << 60}, "train": {**fine["train"], "optimizer": "sgd", "text_cache_size": 0}}
    rows = {r["name"]: r["level"] for r in preflight.preflight(preflight.surroundings(spark, bad, str(tmp_path / "none"), str(tmp_path), str(tmp_path / "none"))).collect()}
    assert {n for n, lv in rows.items() if lv == "error"} == {"rolling block", "text cache", "shards", "index", "optimizer", "disk"} and rows["token"] == rows["mirror"] == "warning"
    both = preflight.surroundings(spark, fine).unionByName(preflight.surroundings(spark, {"name": "empty"}))
    assert {r["run"]: r["ok"] for r in preflight.reports(preflight.preflight(both)).collect()} == {"fine": True, "empty": False}
    assert preflight.preflight(both.select("run", "backend").limit(0)).count() == 0


def test_a_zip_is_strict(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(5)], "ord long, a string")
    b = spark.createDataFrame([(i, i * 2) for i in range(5)], "ord long, b long")
    assert [tuple(r) for r in ingest.zipped(a, b, "ord").orderBy("ord").collect()] == [(i, f"a{i}", i * 2) for i in range(5)]
    for x, y in ((a, b.limit(4)), (a.where("ord <> 2"), b)):
        with pytest.raises(Exception, match="has no partner"):
            ingest.zipped(x, y, "ord").collect()
    assert ingest.zipped(a.limit(0), b.limit(0), "ord").count() == 0


def test_keys_that_every_sample_of_a_batch_has(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "y", 1), (2, None, 2), (2, "z", 3)], "b long, p string, q long")
    assert {tuple(r) for r in batching.present_in_all(df, ["b"], ["p", "q"]).collect()} == {(1, 2, True, False), (2, 2, False, True)}


def test_manifest_counts_what_it_keeps(spark, tmp_path):
    import json

    at = tmp_path / "in"
    at.mkdir()
    for name, content in {"a.png": png(1200, 1800), "b.png": png(10, 10), "c.jpg": b"no image", "d.PNG": png(1920, 1080)}.items():
        (at / name).write_bytes(content)
    (at / "a.json").write_text('{"general_tags": ["x", "\u00e9"], "bucket": "own"}')
    (at / "d.json").write_text("[1]")
    (at / "d.txt").write_text(" one ")
    assert images.write_manifest(spark, str(at), str(tmp_path / "out"), 768, 2.0) == {"kept": 2, "skipped": 2}
    rows = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda r: r["image_path"])
    assert [(r["bucket"], r["original_width"], r["general_tags"]) for r in rows] == [("own", 1200, ["x", "é"]), ("1024x576", 1920, "one")]
