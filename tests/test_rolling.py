"""The rolling stream: turns, restarts and the rows of the batch operators."""

import io
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sources_helpers import write_tar
from test_batching import walk
from tagloom.operators import batching
from tagloom.operators.encode import block_means
from tagloom.streaming import latents
from tagloom.streaming.rolling import Rolling

BLOCK, BATCH, ACCUMULATE = 12, 2, 3


def shard(path, samples):
    files = []
    for i, (bucket, value) in enumerate(samples):
        w, h = map(int, bucket.split("x"))
        b = io.BytesIO()
        np.save(b, np.full((1, h, w), value, np.float16))
        files += [(f"s{i}.latent.npy", b.getvalue()), (f"s{i}.json", json.dumps({"bucket": bucket}).encode())]
    return write_tar(path, files)


def corpus(tmp_path, seed, shards=5):
    rng, paths, rows = random.Random(seed), [], []
    for s in range(shards):
        samples = [(rng.choice(["16x32", "32x16", "32x16", "16x16"]), rng.randint(0, 50)) for _ in range(rng.randint(5, 14))]
        paths.append(shard(tmp_path / f"{s}.tar", samples))
        rows += [(s, i, b, v) for i, (b, v) in enumerate(samples)]
    return paths, rows


def samples(stream):
    return stream.select("shard_index", "sample_index", "sample_id", F.get_json_object("metadata", "$.bucket").alias("bucket"), F.col("latent").alias("pixels"), "shape")


def run(spark, paths, rolling, checkpoint, each=2):
    stream = latents.latent_stream(spark, paths, checkpoint=checkpoint, shards_per_batch=each, shuffle=False)
    query = samples(stream).writeStream.foreachBatch(rolling).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def groups_of(rows):
    got, cursors = {}, {}
    for r in rows:
        got.setdefault(r["group_no"], []).append((r["shard_index"], r["sample_index"]))
        cursors[r["group_no"]] = (r["resume_shard_index"], r["resume_sample_index"])
    return [sorted(got[k]) for k in sorted(got)], [cursors[k] for k in sorted(cursors)]


def test_a_stopped_stream_goes_on_without_skipping(spark, tmp_path):
    paths, rows = corpus(tmp_path, 5)
    calls, broken = [], []

    def consume(out, batch_id):
        calls.append(("consume", out.select("group_no").distinct().count()))
        if batch_id == 1 and not broken:
            broken.append(True)
            raise RuntimeError("the machine is gone")

    def make():
        return Rolling(str(tmp_path / "rolling"), BLOCK, BATCH, ACCUMULATE, before_encode=lambda: calls.append("encode"), before_train=lambda: calls.append("train"), consume=consume)

    at = str(tmp_path / "checkpoint")
    with pytest.raises(Exception, match="the machine is gone"):
        run(spark, paths, make(), at)
    n = len(calls)
    assert make()._versions(spark) == [0]
    rolling = make()
    run(spark, paths, rolling, at)
    assert calls[n : n + 2] == ["encode", "train"] and calls[n + 2][0] == "consume"
    rolling.finish(spark)
    rolling.finish(spark)  # once is enough
    out = rolling.output(spark).collect()
    groups, left, cursors = walk([r[:3] for r in rows], BLOCK, BATCH, ACCUMULATE)
    assert groups_of(out) == ([sorted(g) for g in groups], cursors)
    assert sorted((r["shard_index"], r["sample_index"]) for r in rolling.dropped(spark).collect()) == left
    value = {r[:2]: float(r[3]) for r in rows}
    assert all(set(r["latent"]) == {value[r["shard_index"], r["sample_index"]]} for r in out)
    # nothing new: no micro-batch, no call
    n = len(calls)
    run(spark, paths, rolling, at)
    assert len(calls) == n


def test_encoding_and_training_take_turns(spark, tmp_path):
    paths, _ = corpus(tmp_path, 7)
    log = tmp_path / "log"
    log.write_text("")

    def note(what):
        with log.open("a") as f:
            f.write(what + "\n")

    def encoder(pixels):  # in the tasks
        with log.open("a") as f:
            f.write("pixels\n")
        return block_means(pixels)

    rolling = Rolling(str(tmp_path / "r"), BLOCK, BATCH, ACCUMULATE, encoder, 4, lambda: note("encode"), lambda: note("train"), lambda out, _: note(f"consume {out.count()}"))
    run(spark, paths, rolling, str(tmp_path / "c"))
    lines = [x.split()[0] for x in log.read_text().splitlines()]
    turns = [x for i, x in enumerate(lines) if not i or x != lines[i - 1]]
    text = " ".join(turns)
    assert text.count("encode pixels train consume") >= 2
    assert text.replace("encode pixels train consume", "").replace("encode pixels", "").strip() == ""


def test_stored_cursor_repeats_but_never_skips(spark, tmp_path):
    """A new run from the safe cursor of any group holds every sample that no group up to it has trained."""
    paths, rows = corpus(tmp_path, 9, 3)
    rolling = Rolling(str(tmp_path / "r"), BLOCK, BATCH, ACCUMULATE)
    run(spark, paths, rolling, str(tmp_path / "c"))
    out = rolling.output(spark).collect()
    k = max(r["group_no"] for r in out) - 1
    trained = {(r["shard_index"], r["sample_index"]) for r in out if r["group_no"] <= k}
    cursor = next((r["resume_shard_index"], r["resume_sample_index"]) for r in out if r["group_no"] == k)
    seen = []
    stream = latents.latent_stream(spark, paths, cursor=(0, *cursor), shuffle=False).select("shard_index", "sample_index")
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).start()
    query.processAllAvailable()
    query.stop()
    assert {r[:2] for r in rows} - trained <= set(seen) and len(seen) < len(rows)


def test_offsets_and_epochs(spark, tmp_path):
    paths, _ = corpus(tmp_path, 3, 3)
    at = str(tmp_path / "c")
    assert latents.stored_offset(at) is None

    def count(epochs, each):
        seen = []
        q = latents.latent_stream(spark, paths, epochs=epochs, checkpoint=at, shards_per_batch=each).writeStream.foreachBatch(lambda df, _: seen.append(sorted({(r[0], r[1]) for r in df.select("epoch", "shard_index").collect()}))).option("checkpointLocation", at).start()
        q.processAllAvailable()
        q.stop()
        return seen

    assert count(1, 2) == [[(0, 0), (0, 1)], [(0, 2)]]
    assert latents.stored_offset(at) == {"epoch": 1, "shard": 0, "sample": -1}
    assert count(1, 2) == []
    assert count(3, 5) == [[(1, 0), (1, 1), (1, 2)], [(2, 0), (2, 1), (2, 2)]]


def test_sizes_are_checked(tmp_path):
    for bad in ((10, 2, 3), (0, 1, 1), (12, -2, 3)):
        with pytest.raises(ValueError):
            Rolling(str(tmp_path), *bad)


def test_an_empty_stream_has_no_groups(spark, tmp_path):
    rolling = Rolling(str(tmp_path / "r"), BLOCK, BATCH, ACCUMULATE)
    rolling.finish(spark)
    with pytest.raises(FileNotFoundError):
        rolling.output(spark)
    none = spark.createDataFrame([], "shard_index long, sample_index long, sample_id string, bucket string, pixels array<float>, shape array<int>")
    rolling(none, 0)
    rolling.finish(spark)
    assert rolling.dropped(spark).count() == 0 and not Path(tmp_path / "r" / "out").exists()


def test_trained_before_counts_where_nothing_waits(spark):
    df = spark.createDataFrame([(0, i, "a") for i in range(4)], "shard_index bigint, sample_index bigint, bucket string")
    grouped = batching.groups(df, 4, 2, 2)
    assert [tuple(r)[1:] for r in batching.safe_cursors(grouped, (3, 1)).orderBy("group_no").collect()] == [(0, 1), (3, 1)]


def test_turns_do_not_grow_with_the_table():
    from tagloom.plans.batches import TURNS, shards_a_turn

    assert [shards_a_turn(n) for n in (1, 10, 20)] == [5, 5, 5]
    assert all(-(-n // shards_a_turn(n)) <= TURNS for n in (21, 513, 5_130, 30_770))


def test_shards_are_ordered_once_an_epoch(monkeypatch):
    calls = []
    monkeypatch.setattr(latents, "shard_order", lambda shards, seed, epoch: calls.append(epoch) or sorted(shards, reverse=epoch % 2 == 1))
    reader = latents.LatentStreamReader({"shards": "a\nb\nc", "epochs": "2"})
    got = reader.partitions({"epoch": 0, "shard": 1, "sample": 4}, {"epoch": 1, "shard": 2, "sample": -1})
    assert [(p.epoch, p.index, p.path, p.after) for p in got] == [(0, 1, "b", 4), (0, 2, "c", -1), (1, 0, "c", -1), (1, 1, "b", -1)]
    assert calls == [0, 1]


def test_one_window_or_several_give_the_same_cursors(spark, tmp_path):
    _, rows = corpus(tmp_path, 3)
    samples_ = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "shard_index long, sample_index long, bucket string")
    grouped = batching.groups(samples_, BLOCK, BATCH, ACCUMULATE)
    assert sorted(map(tuple, batching.safe_cursors(grouped, few=True).collect())) == sorted(map(tuple, batching.safe_cursors(grouped).collect()))
