"""Running values in chunks, numbers in parts, and text windows against plain walks."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import batching, scans
from test_batching import walk


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_running_values_equal_a_walk(spark, before, chunk):
    rng = random.Random(chunk)
    rows = [(g, i, rng.choice([None, *range(-9, 10)])) for g in ("a", None) for i in rng.sample(range(40), 25)]
    df = spark.createDataFrame(rows, "g string, i long, x long")
    of = {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))}
    got = {(r["g"], r["i"]): (r["s"] or 0, r["lo"], r["hi"]) for r in scans.scan(df, ["g"], "i", of, before, chunk).collect()}
    plain = {(r["g"], r["i"]): (r["s"] or 0, r["lo"], r["hi"]) for r in scans.scan(df, ["g"], "i", of, before, few=True).collect()}
    for g, i, _ in rows:
        seen = [x for h, j, x in rows if h == g and (j < i or j == i and not before) and x is not None]
        assert got[g, i] == plain[g, i] == (sum(seen), min(seen, default=None), max(seen, default=None))


def test_numbers_of_groups_in_parts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i) for i in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "g string, i long")
    got = {r["i"]: r["n"] for r in scans.numbered(df, ["g"], F.floor(F.col("i") / 50), ["i"], "n").collect()}
    assert got == {i: sum(1 for h, j in rows if h == g and j < i) for g, i in rows}
    everything = {r["i"]: r["n"] for r in scans.numbered(df, [], F.floor(F.col("i") / 50), ["i"], "n").collect()}
    assert everything == {i: sum(1 for _, j in rows if j < i) for _, i in rows}


def windows(sizes, window, encode):
    """(text_window, encoder_batch) of each batch, one batch after the other."""
    out, number, held = [], -1, window
    for size in sizes:
        if held >= window:
            number, held = number + 1, 0
        out.append((number, held // encode))
        held += size
    return out


@pytest.mark.parametrize("seed,window,run", [(1, 1, 4), (2, 7, 5), (3, 40, 3), (4, 13, 1000), (5, 100, 1), (6, 10**6, 8)])
def test_windows_over_batches_of_any_size_equal_a_walk(spark, seed, window, run):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 0, 1, 2, 5, 30]) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(sizes)), "batch_no long, size int").repartition(3)
    got = {r["batch_no"]: (r["text_window"], r["encoder_batch"]) for r in batching.text_windows(df, window, 4, run).collect()}
    assert [got[i] for i in range(90)] == windows(sizes, window, 4)
    assert batching.text_windows(df.limit(0), window, 4).count() == 0
    with pytest.raises(ValueError):
        batching.text_windows(df, 0, 4)


def test_pointers_double_to_the_end_of_a_run():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 4, 500)
    before = np.cumsum(sizes) - sizes
    target, count, last = batching._runs_ends(before, 9)
    for i in range(0, 500, 7):
        at, n = i, 0
        while at < 500:
            at, n, start = int(np.searchsorted(before, before[at] + 9)), n + 1, before[at]
        assert (target[i], count[i], last[i]) == (start + 9, n, start)


def test_groups_whose_blocks_lie_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(batching, "CHUNK", 0)
    monkeypatch.setattr(batching, "scan", functools.partial(scans.scan, chunk=2))
    rng = random.Random(11)
    rows = [(s, i, rng.choice(["a", "b", "c", "c", "c"])) for s in range(3) for i in range(rng.randint(20, 40))]
    got = {}
    for r in batching.groups(spark.createDataFrame(rows, "shard_index bigint, sample_index bigint, bucket string"), 6, 2, 3).collect():
        got.setdefault(r["group_no"], []).append((r["shard_index"], r["sample_index"]))
    groups, left, _ = walk(rows, 6, 2, 3)
    assert sorted(got.pop(None, [])) == left
    assert [sorted(got[k]) for k in sorted(got)] == [sorted(g) for g in groups]
    none = spark.createDataFrame([], "shard_index bigint, sample_index bigint, bucket string")
    assert batching.groups(none, 6, 2, 3).count() == 0


def test_text_states_are_padded_by_batch(spark):
    from tagloom.operators import textcache

    sizes = []

    def encoder(captions):
        sizes.append(len(captions))
        return textcache.word_states(captions, 3)

    rows = [(0, ["a bb", None]), (1, []), (2, ["ccc d e f"]), (3, ["x"])]
    df = spark.createDataFrame(rows, "batch_no long, captions array<string>")
    got = {r["batch_no"]: r for r in textcache.text_states(df, encoder, window=2, encode=2).collect()}
    assert [got[i]["text_window"] for i in range(4)] == [0, 1, 1, 1]
    assert got[0]["states"] == [[[1, 0], [2, 1]], [[0, 0], [0, 0]]] and got[0]["mask"] == [[True, True], [True, False]]
    assert got[1]["states"] == [] and got[2]["states"] == [[[3, 0], [1, 1], [1, 2]]] and got[3]["mask"] == [[True]]
    with pytest.raises(Exception, match="1 states of 2"):
        textcache.text_states(df, lambda c: textcache.word_states(c)[:1], 2, 2).collect()
