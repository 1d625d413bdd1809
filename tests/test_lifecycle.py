"""Configuration, checks and the index's directory."""

import pytest

from tagloom.operators import index, lifecycle


def test_configuration_is_inherited_and_merged():
    files = {"child": ({"model": {"depth": 27}, "extends": "base"}, "base"), "base": ({"model": {"depth": 20, "width": 1280}, "x": 1}, None)}
    got = lifecycle.load_config(files.get, "child")
    assert got == {"model": {"depth": 27, "width": 1280}, "x": 1}
    with pytest.raises(ValueError):
        lifecycle.load_config({"a": ({}, "a")}.get, "a")
    with pytest.raises(ValueError):
        lifecycle.section(got, "train")


def test_flattened(spark):
    got = [tuple(r) for r in lifecycle.flattened(spark, {"b": {"c": 1, "d": None}, "a": "x"}).orderBy("key").collect()]
    assert got == [("a", "x"), ("b.c", "1"), ("b.d", None)]


def test_preflight(spark):
    fine = {"data": {"backend": "rolling_raw", "batch_size": 4, "rolling_block_size": 32, "shards": ["a"]}, "train": {"gradient_accumulation_steps": 8, "text_cache_size": 64}}
    assert lifecycle.report(lifecycle.preflight(spark, fine)).head()["ok"]
    bad = {"data": fine["data"] | {"rolling_block_size": 30}, "train": fine["train"]}
    assert lifecycle.report(lifecycle.preflight(spark, bad)).head()["errors"] == 1


def test_newest_complete_and_retention(spark):
    rows = [("local", "step-00000010", 10, True, True), ("local", "step-00000030", 30, True, False), ("mirror", "step-00000020", 20, True, True)]
    c = spark.createDataFrame(rows, "root string, name string, step bigint, has_model boolean, has_state boolean")
    assert lifecycle.newest(c).head()["step"] == 20
    assert lifecycle.removable(c, 1).count() == 0 and lifecycle.removable(c, 0).count() == 0


def test_compaction(spark, tmp_path):
    rows = [(i, "a b") for i in range(60)]
    src = spark.createDataFrame(rows, "id bigint, tag_string string")
    built = index.build(src, 2)
    index.write(built.repartition(3), str(tmp_path / "loose"), whole=False)
    before = index.stats(index.read(spark, str(tmp_path / "loose"))).head()
    assert before["buckets"] == 2 and before["files"] > 2
    assert index.compact(spark, str(tmp_path / "loose"), str(tmp_path / "whole")) == (2, 2)
    after = index.read(spark, str(tmp_path / "whole"))
    assert index.stats(after).head()["files"] == 2 and after.count() == 60
    assert index.read(spark, str(tmp_path / "whole"), ["0001"]).where("id % 2 = 0").isEmpty()


def test_projection_needs_an_id(spark):
    with pytest.raises(ValueError):
        index.project(spark.createDataFrame([("x",)], "tag string"))


def test_unusable_rows_go(spark):
    rows = [(1, "a", None, False), (2, "", None, False), (3, "a", True, False), (4, "a", False, None)]
    df = spark.createDataFrame(rows, "id bigint, tag_string_general string, is_deleted boolean, is_flagged boolean")
    assert sorted(r["id"] for r in index.usable(df).collect()) == [1, 4]
    assert index.usable(spark.createDataFrame([(1,)], "id bigint")).isEmpty()


def test_overrides_and_runtime_configurations():
    base = {"data": {"rolling_block_size": 64}, "x": 1}
    assert lifecycle.overridden(base, max_steps=3, rolling_block_size=None, output_dir="/o") == {"data": {"rolling_block_size": 64}, "x": 1, "train": {"max_steps": 3, "output_dir": "/o"}}
    assert base == {"data": {"rolling_block_size": 64}, "x": 1}
    for bad in ({"max_steps": 0}, {"rolling_block_size": -1}):
        with pytest.raises(ValueError):
            lifecycle.overridden(base, **bad)
    real, smoke = lifecycle.runtime_config("base.yaml", "/r"), lifecycle.runtime_config("base.yaml", "/r", 5)
    assert real["train"] == {"checkpoint_mirror_dir": "/r"} and smoke["train"]["max_steps"] == 5
    assert smoke["train"]["checkpoint_mirror_dir"] != real["train"]["checkpoint_mirror_dir"] and smoke["data"] == real["data"]
    with pytest.raises(ValueError):
        lifecycle.runtime_config("base.yaml", "/r", 0)
