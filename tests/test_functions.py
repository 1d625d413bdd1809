"""Exact values of column functions."""

import pytest
from pyspark.sql import functions as F

from tagloom.functions import geometry as g
from tagloom.functions import numeric as n
from tagloom.functions import paths, tags


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def strings(*items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def test_bucket_choice_and_crop(spark):
    b = g.choose(F.lit(1200), F.lit(1800), g.stage_buckets(768))
    assert one(spark, g.key(b["width"], b["height"])) == "640x960"
    assert tuple(one(spark, g.cover_crop(F.lit(1200), F.lit(1800), b)))[2:] == (0, 0, 640, 960)
    b = g.choose(F.lit(1920), F.lit(1080), g.stage_buckets(768))
    assert one(spark, g.key(b["width"], b["height"])) == "1024x576"
    assert one(spark, g.choose(F.lit(0), F.lit(10), g.stage_buckets(768))) is None


def test_stage_tokens(spark):
    for stage, (low, high) in {512: (247, 256), 768: (576, 600), 1024: (943, 1024)}.items():
        for w, h in g.stage_buckets(stage):
            assert low <= (w // 32) * (h // 32) <= high
    with pytest.raises(ValueError):
        g.stage_buckets(333)


def test_tags_are_split_at_commas_or_white_space(spark):
    assert one(spark, tags.as_tags(F.lit(" a_b  c\td "))) == ["a_b", "c", "d"]
    assert one(spark, tags.as_tags(F.lit("a b, c,, "))) == ["a b", "c"]
    assert one(spark, tags.as_tags(F.lit(None).cast("string"))) == []
    assert one(spark, tags.as_tags(F.lit("x y"))) == ["x", "y"]


def test_caption_is_exact_without_randomness(spark):
    o = tags.CaptionOptions(0.0, 0.0, False, 10)
    c = tags.caption(strings("blue_sky", "1girl", "blue sky", "1girl"), strings("alice_(x)"), strings("work"), strings("bob"), strings("highres"), F.lit("g"), F.lit("best"), options=o)
    assert one(spark, c) == "best quality, rating:g, artist:bob, alice (x), work, blue sky, 1girl, blue sky, highres"
    short = tags.CaptionOptions(0.0, 0.0, False, 2)
    assert one(spark, tags.caption(strings("a"), strings(), strings(), strings(), strings(), F.lit("rating:s"), F.lit("low quality"), options=short)) == "low quality, rating:s"
    with pytest.raises(ValueError):
        tags.CaptionOptions(max_tags=0)


def test_shuffle_repeats_with_its_seed(spark):
    from tagloom.functions.rand import shuffled

    items = strings(*"abcdefgh")
    a, b, c = (one(spark, shuffled(items, *s)) for s in ((1,), (1,), (2,)))
    assert a == b and sorted(a) == list("abcdefgh") and a != c


def test_ratings(spark):
    assert [one(spark, tags.rating(F.lit(x))) for x in (" Safe ", "EXPLICIT", "u", None)] == ["g", "e", "", ""]
    assert one(spark, tags.rating_allowed(F.lit("g"), None)) and not one(spark, tags.rating_allowed(F.lit("g"), ["??"]))


def test_hub_addresses(spark):
    s = F.lit("hf://datasets/o/r/x y/0001.tar")
    assert one(spark, paths.hub_address(s)) == "https://huggingface.co/datasets/o/r/resolve/main/x%20y/0001.tar"
    assert tuple(one(spark, paths.hub_parts(s))) == ("o/r", "x y/0001.tar", "dataset")
    assert one(spark, paths.hub_address(F.lit("hf://datasets/o"))) is None
    assert one(spark, paths.shard_bucket(F.lit("https://x/y/0042.tar?download=1"))) == "0042"
    assert one(spark, paths.shard_bucket(F.lit("/y/42.tar"))) is None


def test_sizes(spark):
    assert one(spark, paths.human_bytes(F.lit(1536))) == "1.5 KiB"
    assert one(spark, paths.total_bytes(F.lit("bytes 5-9/100"), F.lit("5"), F.lit(5), F.lit(206))) == 100
    assert one(spark, paths.total_bytes(F.lit(None).cast("string"), F.lit("5"), F.lit(5), F.lit(206))) == 10
    assert one(spark, paths.checkpoint_step(F.lit("/a/step-00000250"))) == 250
    assert one(spark, paths.checkpoint_step(F.lit("latest"))) == -1


def test_integrators(spark):
    two = lambda x, t: F.transform(x, lambda _: F.lit(2.0))
    assert one(spark, n.integrate(F.array(F.lit(1.0)), 4, two)) == [-1.0]
    ones = lambda x, t: F.transform(x, lambda _: F.lit(1.0))
    assert one(spark, n.integrate(F.array(F.lit(1.0)), 3, ones, heun=True)) == pytest.approx([0.0])


def test_schedule_and_flow(spark):
    lr = lambda s: one(spark, n.learning_rate(F.lit(s), 10, 110, 0.1))
    assert lr(0) == 0.0 and lr(10) == pytest.approx(1.0) and lr(110) == pytest.approx(0.1) and lr(999) == pytest.approx(0.1)
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(5.0), F.lit(8.0))
    assert one(spark, n.lerp(a, b, F.lit(0.0))) == [1.0, 2.0] and one(spark, n.lerp(a, b, F.lit(1.0))) == [5.0, 8.0]
    assert one(spark, n.mse(a, a)) == 0.0 and one(spark, n.velocity(a, b)) == [4.0, 6.0]


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [2.0794515, 1.0237465, -2.0479035, 0.5, -0.0000005, 1e306, -5.36474271e11, float("inf"), 0.0, None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(n.rounded("x", 6), n.rounded("x", 9)).collect()
    con = duckdb.connect()
    assert [tuple(r) for r in got] == [con.execute("select round(x, 6), round(x, 9) from (select ?::double as x)", [v]).fetchone() for v in values]


def test_interpolated_latents_are_rounded_as_in_the_sql(spark, tmp_path):
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tagloom import registry

    rng = np.random.default_rng(0)
    rows = np.hstack([rng.normal(0, 1e8, (200, 32)), rng.normal(0, 1, (200, 32))]).astype(np.float32)  # sums that use all bits of a double
    pq.write_table(pa.table({"vec_id": np.arange(200), "embedding": pa.array(list(rows), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = {r["vec_id"]: list(r["x"]) for r in registry.queries()["flow_lerp"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    assert got == dict(con.execute(registry.oracle_sql()["flow_lerp"]).fetchall())
