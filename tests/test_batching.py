"""Groups and cursors against a walk over the samples in plain Python."""

import random

import pytest

from tagloom.operators import batching


def walk(samples, block, batch, accumulate):
    """(group number -> ids), ids that stay, and the cursor after each group; samples: (shard, place, bucket) in order."""
    waiting, groups, cursors, trained = {}, [], [], (-1, -1)
    for a in range(0, len(samples), block):
        for s in samples[a : a + block]:
            waiting.setdefault(s[2], []).append(s)
        ready = []
        for name in sorted(waiting):
            while len(waiting[name]) >= batch:
                ready.append([waiting[name].pop(0) for _ in range(batch)])
        usable = len(ready) // accumulate * accumulate
        for g in reversed(ready[usable:]):
            waiting[g[0][2]][:0] = g
        for k, g in enumerate(ready[:usable]):
            trained = max(trained, max(s[:2] for s in g))
            rest = [s[:2] for later in ready[k + 1 : usable] for s in later] + [s[:2] for w in waiting.values() for s in w]
            cursors.append((min(rest)[0], min(rest)[1] - 1) if rest else trained)
            groups.append([s[:2] for s in g])
    return groups, sorted(s[:2] for w in waiting.values() for s in w), cursors


@pytest.mark.parametrize("seed,block,batch,accumulate", [(1, 16, 2, 4), (2, 24, 4, 2), (3, 8, 1, 8), (4, 12, 3, 3)])
def test_groups_and_cursors_equal_a_walk(spark, seed, block, batch, accumulate):
    rng = random.Random(seed)
    rows = [(s, i, rng.choice(["1024x576", "576x1024", "768x768"])) for s in range(4) for i in range(rng.randint(5, 40))]
    df = spark.createDataFrame(rows, "shard_index bigint, sample_index bigint, bucket string")
    grouped = batching.groups(df, block, batch, accumulate)
    got = {}
    for r in grouped.collect():
        got.setdefault(r["group_no"], []).append((r["shard_index"], r["sample_index"]))
    groups, left, cursors = walk(rows, block, batch, accumulate)
    assert sorted(got.pop(None, [])) == left
    assert [sorted(got[k]) for k in sorted(got)] == [sorted(g) for g in groups]
    safe = {r["group_no"]: (r["shard_index"], r["sample_index"]) for r in batching.safe_cursors(grouped).collect()}
    assert [safe[k] for k in sorted(safe)] == cursors


def test_a_block_holds_whole_steps(spark):
    df = spark.createDataFrame([(0, 0, "a")], "shard_index bigint, sample_index bigint, bucket string")
    with pytest.raises(ValueError):
        batching.groups(df, 30, 4, 8)


def test_every_worker_has_its_own_shards(spark):
    shards = batching.shard_order(spark.createDataFrame([(f"{i}.tar",) for i in range(10)], "source string"), 1, 0)
    parts = [sorted(r["source"] for r in batching.worker_share(shards, w, 3).collect()) for w in range(3)]
    assert sorted(sum(parts, [])) == sorted(f"{i}.tar" for i in range(10))
