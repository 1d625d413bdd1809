"""Cases that the operators' docstrings define: very long texts, rows that repeat, ties, empty tables."""

import math

import numpy as np
import public_tokenizers
import pytest

from tagloom.llm import cosine, lines, mixing, ngram_join, quality, sentencepieces, warc
from tagloom.llm._work import new_dir, remove, stored


def test_join_of_very_long_texts(spark):
    words = [f"w{i * 7919 % 30011}" for i in range(60_000)]
    near = list(words)
    for i in range(0, 60_000, 3000):
        near[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:20_000])), (4, None), (5, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows[:3] for w in [t.split()]}
    assert {d: n for d, (n, _) in got.items()} == {1: len(sets[1]), 2: len(sets[2]), 3: len(sets[3]), 4: 0, 5: 0}
    assert {d: c for d, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_lines_of_very_long_lines(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, long), (2, long + " more"), (3, long[: len(long) // 2])]
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == long and got[2] == "" and got[3] == rows[2][1]


def test_quality_where_every_rule_abstains(spark):
    rows = [(i, None) for i in range(5)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and all(r["base_failed"] and not r["kept"] and 0 <= r["p_good"] <= 1 for r in got)


def test_a_posterior_of_a_half_is_kept():
    none = np.zeros((1, 3), np.int64)
    assert quality.posterior(none, 0.5, np.full(3, 0.9), np.full(3, 0.8)).tolist() == [0.5]


def test_archives_of_rows_that_repeat(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "v", "same"), (3, None, None), (4, "w", ""), (None, "x", "same"), (5, "y", "other")]
    root = new_dir(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), root)
    got = warc.read_archives(spark, root).collect()
    shown = sorted(((r["page_id"] is None, r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=str)
    assert shown == sorted([(False, 1, "revisit", 2, 4), (False, 2, "response", None, 4), (False, 2, "response", None, 4), (False, 3, "revisit", 4, 0), (False, 4, "response", None, 0), (True, None, "revisit", 2, 4), (False, 5, "response", None, 5)], key=str)
    digest = {r["page_id"]: r["payload_digest"] for r in got if r["record_type"] == "response"}
    assert all(r["payload_digest"] == digest[r["refers_to"]] for r in got if r["record_type"] == "revisit")


def test_vectors_that_repeat_an_id_or_have_none(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, a), (None, a), (2, b), (3, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [1.0, 0.05, 0.0])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cosine.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, None, False), (2, 0, 2, True), (3, 0, 3, True), (3, 0, 3, True), (4, 0, 4, True), (5, 3, 1, False)], key=str)


def test_mix_of_sources_without_words(spark):
    rows = [(i, "a b c d", "x") for i in range(20)] + [(100 + i, "", "y") for i in range(5)] + [(200 + i, None, None) for i in range(5)] + [(300, " ".join(["w"] * 500), "z")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert 0 <= r["copies"] <= 2 and math.isfinite(r["target"])
        taken[r["row"]["doc_id"] // 100] = taken.get(r["row"]["doc_id"] // 100, 0) + r["copies"] * r["size"]
    assert taken[1] == taken[2] == 0


def test_pieces_of_an_empty_table_and_of_a_long_text(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepieces.encode(none, model).count() == 0
    text = "It was a long and winding road that nobody had walked before. " * 8000 + "x" * 3000
    got = sentencepieces.encode(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), model)
    ids = {r["doc_id"]: r["ids"] for r in got.select("doc_id", "ids").collect()}
    assert list(ids[1]) == sentencepiece.SentencePieceProcessor(model_file=model).encode(text) and not ids[2] and not ids[3]


def test_stored_tables_can_be_removed(spark):
    df = stored(spark.range(5), "handling")
    assert df.count() == 5
    remove(spark, df)
    with pytest.raises(Exception):
        spark.read.parquet(df._tagloom_path).count()
