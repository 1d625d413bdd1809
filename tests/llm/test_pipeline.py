"""The pipeline's stages hand documents on, and the subpackage's queries are registered."""

import corpus_pipeline
from tagloom import llm

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert out.count() > 0
    last = corpus_pipeline.run(spark, SF)
    assert last.where("not round_trip").isEmpty() and last.count() > 0


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in llm.queries()] == list(range(1, 14))
    assert set(llm.oracle_sql()) <= set(llm.queries())


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, repeated ids, and columns that operators use too."""
    plain = "The quick brown fox jumps over the lazy dog while many people watch it with great interest today."
    rows = [(i, f"{plain} Number {i} says that it is the {i * 7919 % 1000} one of a long and growing list of sentences.", "en", "web" if i % 3 else None, 1, i, "x") for i in range(40)]
    rows += [(i, f"Der schnelle Fuchs Nummer {i} springt heute \u00fcber den faulen Hund, und viele Leute sehen ihm dabei {i * 31 % 97} Mal zu.", "de", "books", 1, None, None) for i in range(100, 130)]
    rows += [rows[3], rows[3], (3, rows[5][1], "en", "web", None, 1, "y"), (None, rows[7][1] + " And a bit more of it.", None, None, None, None, None)]
    rows += [(500, None, "en", "web", 0, 1, "n"), (501, "", "en", "web", 0, 1, "n"), (502, " .,;\n\n123 ", None, "web", 0, 1, "n"), (503, "word " * 30_000 + "end", "en", "long", 150_003, 1, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, line string")


def test_stages_bear_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        at = str(tmp_path / name)
        out.write.parquet(at)
        docs = spark.read.parquet(at)
        seen.append(docs.count())
    first = spark.read.parquet(str(tmp_path / "language"))
    assert seen[0] == 75 and first.where("doc_id in (500, 501, 502)").isEmpty()  # without a letter
    assert {r["lang"] for r in first.select("lang").distinct().collect()} <= {"en", "de"}
    third = spark.read.parquet(str(tmp_path / "near_duplicates"))
    assert third.where("doc_id = 3").count() <= 1 and seen[2] <= seen[1] == seen[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == seen[3] and last.where("not round_trip").isEmpty()


def test_stages_bear_empty_tables(spark, tmp_path):
    docs = awkward(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        at = str(tmp_path / name)
        out.write.parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)
        assert docs.count() == 0
