"""Publishing, whole writes, mirrors and run state."""

import json

import pytest

from tagloom.operators import index
from tagloom.sources import store


def built(spark, n=60, modulus=4):
    return index.build(spark.createDataFrame([(i, "a b") for i in range(n)], "id bigint, tag_string string"), modulus)


def test_published_index_states_what_it_holds(spark, tmp_path):
    at = str(tmp_path / "index")
    m = store.publish(spark, built(spark), at, "posts-1")
    assert (m["buckets"], m["files"], m["rows"]) == (4, 4, 60) and store.manifest_of(spark, at) == m
    assert store.published(spark, at, "posts-1", 1, 9) and not store.published(spark, at, "posts-2", 1, 9) and not store.published(spark, at, "posts-1")
    store.publish(spark, built(spark, 30, 2), at, "posts-2")
    assert index.read(spark, at).count() == 30 and store.published(spark, at, "posts-2", 1, 9)
    assert [p.name for p in tmp_path.iterdir()] == ["index"]
    next((tmp_path / "index" / "bucket=0001").glob("*.parquet")).unlink()
    assert not store.published(spark, at, "posts-2", 1, 9)
    store.write_text(spark, f"{at}/{store.MANIFEST}", "no json")
    assert store.manifest_of(spark, at) is None and store.manifest_of(spark, str(tmp_path / "none")) is None


def test_text_is_replaced_whole(spark, tmp_path):
    at = str(tmp_path / "x.txt")
    assert store.read_text(spark, at) is None
    for text in ("one \u00e9", "", "two"):
        store.write_text(spark, at, text)
        assert store.read_text(spark, at) == text
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["x.txt"]


def test_what_was_there_comes_back(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "x.txt")
    store.write_text(spark, at, "old")
    with pytest.raises(Exception):
        store.replace(spark, str(tmp_path / "missing"), at)
    assert store.read_text(spark, at) == "old"


def test_refusals_are_tried_again():
    calls = []

    def refuses():
        calls.append(1)
        if len(calls) < 3:
            raise PermissionError
        return "done"

    assert store.retried(refuses, wait=0) == "done" and len(calls) == 3
    with pytest.raises(PermissionError):
        store.retried(lambda: (_ for _ in ()).throw(PermissionError()), tries=2, wait=0)
    with pytest.raises(KeyError):
        store.retried(lambda: {}["x"])


def test_run_state_mirror_and_resume(spark, tmp_path):
    run, other = str(tmp_path / "run"), str(tmp_path / "mirror")
    with store.Mirror(spark, other, 1) as mirror:
        for step in (10, 20, 30):
            mirror.submit(store.save_state(spark, run, step, f"m{step}", {"epoch": step // 10}, keep=2))
    assert [s for s, _ in store.checkpoints(spark, run)] == [20, 30] and [s for s, _ in store.checkpoints(spark, other)] == [30]
    assert store.read_text(spark, f"{other}/latest") == "step-00000030"
    assert store.save_state(spark, run, 30, "changed", {}) == f"{run}/step-00000030"
    assert store.load_state(spark, f"{run}/step-00000030") == ("m30", {"epoch": 3, "step": 30})
    (tmp_path / "run" / "step-00000040").mkdir()
    assert store.resume_path(spark, "auto", [run, other]) == f"{run}/step-00000030"
    assert store.resume_path(spark, "auto", [other]) == f"{other}/step-00000030" and store.resume_path(spark, "auto", [str(tmp_path / "none")]) is None
    assert store.resume_path(spark, None, [run]) is None
    assert store.resume_path(spark, f"{run}/step-00000020/training_state.pt", []) == f"{run}/step-00000020"
    with pytest.raises(FileNotFoundError):
        store.resume_path(spark, f"{run}/step-00000040", [])
    assert store.prune(spark, run, 1, ("step-00000020",)) == [] and store.prune(spark, run, 0) == []


def test_a_failed_copy_is_raised(spark, tmp_path):
    mirror = store.Mirror(spark, str(tmp_path / "m"), 1)
    mirror.submit(str(tmp_path / "missing"))
    with pytest.raises(Exception):
        mirror.close()
    assert json.dumps(store.checkpoints(spark, str(tmp_path / "m"))) == "[]"
