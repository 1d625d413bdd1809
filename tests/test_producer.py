"""The archive sink, the producer, the latent cache, point reads and encoder batches."""

import io
import json
import tarfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F


from tagloom.operators import producer
from tagloom.operators.encode import Halving, block_means, encoded
from tagloom.sources import archives, store


def images(spark, rows):
    """source, key, value: one-channel images of 16 x 32 that hold the value; None: broken."""
    data = [(s, k, n, [float(v or 0)] * (512 if v is not None else 3), [1, 16, 32], json.dumps({"v": v})) for n, (s, k, v) in enumerate(rows)]
    return spark.createDataFrame(data, "source string, key string, ord long, pixels array<float>, shape array<int>, metadata string").repartition(3)


def held(root):
    out = {}
    for p in sorted(Path(root).rglob("*.tar")):
        with tarfile.open(p) as tar:
            out[str(p.relative_to(root))] = [(m.name, tar.extractfile(m).read()) for m in tar]
    return out


def test_producer_writes_each_source_once(spark, tmp_path):
    rows = [("a.tar", f"k{i}", i / 8) for i in range(5)] + [("b.tar", "x", None), ("b.tar", None, 1.0), ("c.tar", "x", None), ("c.tar", "y", 2.0), (None, "z", 1.0)]
    root = str(tmp_path / "out")
    got = {r["source"]: (r["output"], r["encoded"], r["skipped"]) for r in producer.produce(images(spark, rows), root, "512").collect()}
    assert {s: x[1:] for s, x in got.items()} == {"a.tar": (5, 0), "b.tar": (0, 2), "c.tar": (1, 1)}
    assert got["b.tar"][0] is None
    first = held(root)
    assert sorted(first) == sorted(x[0] for x in got.values() if x[0])
    names = [n for n, _ in first[got["a.tar"][0]]]
    assert names[::2] == [n.replace(".json", ".latent.npy") for n in names[1::2]] and len(names) == 10
    values = [float(np.load(io.BytesIO(p)).ravel()[0]) for n, p in first[got["a.tar"][0]] if n.endswith(".npy")]
    assert values == [i / 8 for i in range(5)]  # in the order of the source

    def never(_):
        raise AssertionError("encoded again")

    more = producer.produce(images(spark, [r for r in rows if r[0] != "b.tar"] + [("d.tar", "k", None)]), root, "512", encoder=never)
    assert [tuple(r) for r in more.collect()] == [("d.tar", None, 0, 1)] and held(root) == first
    assert not [p for p in Path(root).rglob("_writing*")]


def test_a_hot_source_has_several_archives_and_mirrored_ones_count(spark, tmp_path):
    rows = [("hot", f"k{i}", 1.0) for i in range(100)] + [("cold", "k", 1.0)]
    root, mirror = str(tmp_path / "out"), str(tmp_path / "mirror")
    report = {r["source"]: r["encoded"] for r in producer.produce(images(spark, rows), root, "768", per_archive=30).collect()}
    assert report == {"hot": 100, "cold": 1}
    assert len(held(root)) == 5
    assert len(producer.upload(spark, root, mirror)) == 5 and held(mirror) == held(root) and producer.upload(spark, root, mirror) == []
    todo = spark.createDataFrame([("hot",), ("cold",), ("new",)], "source string")
    assert [r["source"] for r in producer.pending(todo, spark, "768", str(tmp_path / "none"), mirror).collect()] == ["new"]
    assert producer.pending(todo, spark, "512", root).count() == 3


def test_archives_that_are_there(spark, tmp_path):
    one = lambda payload: spark.createDataFrame([("x/a.tar", "m", bytearray(payload), 1)], "archive string, name string, payload binary, ord int")
    root = str(tmp_path)
    for existing, payload, then in (("skip", b"1", b"1"), ("skip", b"2", b"1"), ("replace", b"3", b"3")):
        archives.write(one(payload), root, ["ord"], existing)
        assert held(root) == {"x/a.tar": [("m", then)]}
    with pytest.raises(Exception, match="there already"):
        archives.write(one(b"4"), root, ["ord"], "error")
    with pytest.raises(Exception, match="existing is"):
        archives.write(one(b"4"), root, ["ord"], "else")
    spread = spark.createDataFrame([("b.tar", str(i), bytearray(b"x")) for i in range(8)], "archive string, name string, payload binary").repartition(4)
    with pytest.raises(Exception, match="several tasks"):
        spread.write.format("tar_archives").mode("append").option("path", root).save()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x"] and held(root) == {"x/a.tar": [("m", b"3")]}


def test_cache_keeps_what_it_has(spark, tmp_path):
    root, calls = str(tmp_path / "cache"), str(tmp_path / "calls")
    Path(calls).mkdir()

    def counting(pixels):
        import uuid

        (Path(calls) / uuid.uuid4().hex).write_text(str(len(pixels)))
        return block_means(pixels)

    def table(values):
        rows = [(f"/i/{k}.png", "32x16", [float(v)] * 512, [1, 16, 32], [16, 32, 0, 0]) for k, v in values]
        return spark.createDataFrame(rows, "image_path string, bucket string, pixels array<float>, shape array<int>, preprocess_geometry array<int>")

    def read(manifest):
        return {r["image_path"]: r["latent"][0] for r in archives.latents_at(manifest).collect()}

    def done():
        n = sum(int(p.read_text()) for p in Path(calls).iterdir())
        for p in Path(calls).iterdir():
            p.unlink()
        return n

    assert read(producer.cache_latents(table([("a", 1), ("b", 2), ("b", 2), ("c", 3)]), root, counting)) == {"/i/a.png": 1, "/i/b.png": 2, "/i/c.png": 3} and done() == 3
    assert read(producer.cache_latents(table([("b", 9), ("d", 4)]), root, counting)) == {"/i/b.png": 2, "/i/d.png": 4} and done() == 1
    assert read(producer.cache_latents(table([("b", 9)]), root, counting, overwrite=True)) == {"/i/b.png": 9} and done() == 1
    assert read(producer.cache_latents(table([]), root, counting)) == {} and producer.manifest(spark, str(tmp_path / "none")).count() == 0


def test_point_reads_check_axes_and_paths(spark, tmp_path):
    for name, shape in (("one", (2, 1, 3, 4)), ("flat", (6,)), ("fine", (2, 3, 4))):
        np.save(tmp_path / f"{name}.npy", np.arange(int(np.prod(shape)), dtype=np.float16).reshape(shape))
    places = lambda *names: spark.createDataFrame([(n, None, None) for n in names], "latent_path string, offset long, nbytes long")
    got = {r["latent_path"]: (r["shape"], r["latent"]) for r in archives.latents_at(places("one.npy", f"{tmp_path}/fine.npy", "one.npy"), str(tmp_path)).collect()}
    assert set(map(str, got.values())) == {str(([2, 3, 4], [float(i) for i in range(24)]))}
    with pytest.raises(Exception, match="three axes"):
        archives.latents_at(places("flat.npy"), str(tmp_path)).collect()
    with pytest.raises(Exception, match="No such file|cannot open"):
        archives.latents_at(places("absent.npy"), str(tmp_path)).collect()


def test_archives_of_many_latents_are_read_by_region(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "REGION", 4096)
    root = str(tmp_path / "out")
    producer.produce(images(spark, [("s", f"k{i}", float(i)) for i in range(40)]), root, "512")
    places = archives.latent_places(archives.archive_paths(spark, root))
    assert places.count() == 40
    plan = archives.latents_at(places.repartition(1))
    assert sorted(r["latent"][0] for r in plan.collect()) == [float(i) for i in range(40)]


def test_batches_shrink_and_stay_small():
    sizes = []

    def tight(pixels):
        sizes.append(len(pixels))
        if len(pixels) > 3:
            raise MemoryError
        return pixels * 2

    h = Halving(tight, 16)
    x = np.arange(16.0).reshape(16, 1)
    assert [float(v[0]) for v in h(x)] == [2.0 * i for i in range(16)] and h.most == 2
    assert sizes[:3] == [16, 8, 4] and max(sizes[3:]) == 2
    sizes.clear()
    h(x)
    assert set(sizes) == {2}

    def never(pixels):
        raise MemoryError

    with pytest.raises(MemoryError):
        Halving(never, 4)(x)
    with pytest.raises(ValueError, match="3 latents of 4"):
        Halving(lambda p: p[:3], 4)(x[:4])


def test_encoder_gets_batches_of_one_shape(spark):
    def sized(pixels):  # each latent says how many were encoded together
        return np.full((len(pixels), 1, 1, 1), len(pixels))

    rows = [(i, [1.0] * 256, [1, 16, 16] if i % 2 else [1, 8, 32]) for i in range(22)] + [(98, None, [1, 2, 2]), (99, [1.0], [1, 2, 2])]
    df = spark.createDataFrame(rows, "id long, pixels array<float>, shape array<int>").coalesce(1)
    got = {r["id"]: r["latent"] for r in encoded(df, sized, 4, skip=True).collect()}
    assert got.pop(98) is None and got.pop(99) is None
    assert sorted(v[0] for v in got.values()) == [3.0] * 6 + [4.0] * 16
    with pytest.raises(Exception, match="fill their shape"):
        encoded(df, sized, 4).collect()
    assert encoded(df.limit(0), sized).count() == 0


def test_versions_switch_by_a_pointer(spark, tmp_path):
    root = str(tmp_path / "v")
    assert store.current(spark, root) is None
    write = lambda n: lambda at: spark.range(n).write.parquet(at)
    first = store.publish_version(spark, root, write(3))
    reader = spark.read.parquet(store.current(spark, root))

    def refuse(at):
        raise ValueError("not the rows that were asked for")

    with pytest.raises(ValueError):
        store.publish_version(spark, root, write(4), refuse)
    assert store.current(spark, root) == first
    second = store.publish_version(spark, root, write(5))
    assert reader.count() == 3 and spark.read.parquet(store.current(spark, root)).count() == 5  # an open reader goes on
    for n in range(6, 9):
        store.publish_version(spark, root, write(n))
    assert not store.exists(spark, first) and not store.exists(spark, second)
    assert len([n for n in store.names(spark, root) if n.startswith("v-")]) == 2


def test_held_latents_need_no_pixels(spark, tmp_path):
    pixels = F.transform(F.sequence(F.lit(1), F.lit(256)), lambda x: x.cast("float"))
    images = spark.range(6).select(F.concat(F.lit("/i/"), (F.col("id") % 4).cast("string")).alias("image_path"), F.lit("16x16").alias("bucket"), F.array(F.lit(1), F.lit(16), F.lit(16)).alias("shape"), F.array(F.col("id").cast("int")).alias("preprocess_geometry"))
    root = f"file://{tmp_path}/cache"
    first = producer.cache_latents(images.withColumn("pixels", pixels), root)
    assert sorted((r["image_path"], r["preprocess_geometry"]) for r in first.collect()) == [("/i/0", [0]), ("/i/1", [1]), ("/i/2", [2]), ("/i/3", [3])]
    again = producer.cache_latents(images.withColumn("pixels", F.raise_error(F.lit("pixels were made")).cast("array<float>")), root)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    more = images.unionByName(images.limit(1).withColumn("image_path", F.lit("/i/new"))).withColumn("pixels", pixels)
    assert producer.cache_latents(more, root).count() == 5


def test_archives_are_written_by_many_tasks(spark):
    rows = spark.range(64).select(F.format_string("%03d.tar", F.col("id")).alias("archive"), F.lit("a").alias("name"), F.lit("x").cast("binary").alias("payload"))
    assert archives.laid_out(rows, []).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_pixels_of_raw_samples(spark):
    from tagloom import fixtures as fx

    for r in fx.raw_samples(spark, "/root/testdata/sf0.001").where("ord < 40").collect():
        _, h, w = r["shape"]
        n = 1536 if len(r["pixels"]) == 1536 else 100
        assert r["pixels"] == [(r["ord"] * 7 + (p // w // 16 * (w // 16) + p % w // 16) * 3) % 32 / 8 - 2 for p in range(n)] and n == (100 if r["ord"] % 19 == 0 else 1536)


def test_compaction_gives_each_bucket_a_task(spark, tmp_path):
    from tagloom.operators import index

    rows = spark.range(400).select("id", index.bucket_of(F.col("id"), 40).alias("bucket"))
    rows = rows.unionByName(spark.createDataFrame([(None, "null")], "id long, bucket string"))
    index.write(index.by_bucket(rows, 40), str(tmp_path / "i"), False)
    files = sorted((tmp_path / "i").glob("bucket=*/part-*.parquet"))
    tasks = {f.name.split("-")[1] for f in files}
    assert len(files) == 41 and len(tasks) == 40  # of whole numbers none shares a task
