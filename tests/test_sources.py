"""Archives, image heads, manifests and the latent stream."""

import io
import json
import struct
import tarfile

import numpy as np
import pytest

from tagloom.sources import images, tars
from tagloom.streaming import latents


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\x08\x02\0\0\0"


def write_tar(path, files):
    with tarfile.open(path, "w") as tar:
        for name, payload in files:
            info = tarfile.TarInfo(name)
            info.size = len(payload)
            tar.addfile(info, io.BytesIO(payload))
    return str(path)


def latent_tar(path, count, alone=False):
    files = []
    for i in range(count):
        b = io.BytesIO()
        np.save(b, np.full((2, 2, 2), i, np.float16))
        files += [(f"s{i}.latent.npy", b.getvalue()), (f"s{i}.json", json.dumps({"i": i}).encode())]
    return write_tar(path, files[:-1] if alone else files)


def test_members_are_read_and_paired(spark, tmp_path):
    a = write_tar(tmp_path / "0000.tar", [("d/1.png", png(8, 9)), ("d/1.txt", b" a b "), ("d/1.json", b'{"general_tags": ["x"]}'), ("d/2.PNG", png(1, 1)), ("d/2.txt", b"tag"), ("d/3.nfo", b"?"), ("d/4.json", b"[1]")])
    m = tars.members(spark, [a])
    assert m.count() == 6
    got = {r["key"]: r for r in tars.sidecars(m).collect()}
    assert json.loads(got["d/1"]["metadata"]) == {"general_tags": ["x"]}
    assert json.loads(got["d/2"]["metadata"]) == {"general_tags": "tag"}
    assert got["d/4"]["metadata"] == "{}" and got["d/4"]["image"] is None
    only = tars.members(spark, [a], payload=False).where("kind = 'image'")
    assert only.count() == 2 and only.where("payload is not null").count() == 0


def test_latents_round_trip_in_half_precision(spark, tmp_path):
    tars.register(spark)
    rows = [(f"id{i}", [2, 3], [float(i) + k / 4 for k in range(6)], json.dumps({"bucket": "64x96"})) for i in range(10)]
    df = spark.createDataFrame(rows, "sample_id string, shape array<int>, latent array<float>, metadata string").repartition(2)
    df.write.format("latent_tar").mode("append").option("path", str(tmp_path / "out")).save()
    made = sorted(str(p) for p in (tmp_path / "out").iterdir())
    assert all(p.endswith(".tar") for p in made)
    back = spark.read.format("latent_tar").option("shards", "\n".join(made)).load()
    assert sorted((r["sample_id"], r["shape"], r["latent"], r["metadata"]) for r in back.collect()) == sorted(rows)


def test_a_lone_half_is_an_error(spark, tmp_path):
    tars.register(spark)
    bad = latent_tar(tmp_path / "bad.tar", 2, alone=True)
    with pytest.raises(Exception, match="lack a half"):
        spark.read.format("latent_tar").option("shards", bad).load().collect()


def test_stream_goes_on_after_its_cursor(spark, tmp_path):
    shards = [latent_tar(tmp_path / f"{i}.tar", 3) for i in range(2)]

    def run(cursor):
        name = f"stream_{cursor[0]}_{cursor[1]}_{cursor[2] + 1}"
        q = latents.latent_stream(spark, shards, seed=3, epochs=1, cursor=cursor).writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return [tuple(r) for r in spark.table(name).select("epoch", "shard_index", "sample_index", "sample_id").orderBy("epoch", "shard_index", "sample_index").collect()]

    whole = run((0, 0, -1))
    assert len(whole) == 6
    assert run((0, 0, 1)) == [r for r in whole if r[1:3] > (0, 1)]


def test_shard_order_is_the_operators(spark, tmp_path):
    from tagloom.operators.batching import shard_order

    names = [f"/d/{i:04d}.tar" for i in range(20)]
    df = shard_order(spark.createDataFrame([(n,) for n in names], "source string"), 5, 2)
    assert [r["source"] for r in df.orderBy("place").collect()] == latents.shard_order(names, 5, 2)


def test_image_heads():
    assert images.image_size(png(640, 480)) == (640, 480)
    assert images.image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20)) == (30, 20)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">H", 11) + b"\x08" + struct.pack(">HH", 48, 64) + b"\0" * 8
    assert images.image_size(jpeg) == (64, 48)
    assert images.image_size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == (100, 50)
    assert images.image_size(b"nothing") is None


def test_manifest_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png(1200, 1800))
    (tmp_path / "a" / "x.txt").write_text(" one two ")
    (tmp_path / "a" / "y.png").write_bytes(png(10, 10))
    got = images.manifest(spark, str(tmp_path), 768, 2.0).collect()
    assert [(r["bucket"], r["original_width"], json.loads(r["sidecar"])) for r in got] == [("640x960", 1200, {"general_tags": "one two"})]
    (tmp_path / "m.jsonl").write_text('{"sample_id": "1", "bucket": "512x512"}\n')
    with pytest.raises(ValueError):
        images.read_manifest(spark, str(tmp_path / "m.jsonl"))


def test_shard_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# one\n\n a.tar \nb.tar\n")
    assert tars.shard_list(spark, str(tmp_path / "l.txt")) == ["a.tar", "b.tar"]
    (tmp_path / "e.txt").write_text("# none\n")
    with pytest.raises(ValueError):
        tars.shard_list(spark, str(tmp_path / "e.txt"))
