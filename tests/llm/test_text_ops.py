"""Operators on single texts against brute force, with nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import json
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tagloom.llm import idstore, langid, quality, sentencepieces, tokencount
from tagloom.llm import _text as tx
from tagloom.llm._work import new_dir

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "  a", " a  ", "a <|endoftext|> b", "x<|endoftext|> y", "é è é", "一 二 三  a 龘", "a\n b \n c", "don't  we'll 12 345,  !!  ", "　a b\x1cc\x85d", "ñ ñ", "w" * 3000 + " b", "foo \n", "the cat " * 400, "a b c d e f g h " * 3, "one line\n\none line\n two\n"]
SCHEMA = "doc_id bigint, text string, n bigint, digest string, key int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(ODD)] + [(3, "a", 1, "x", 2), (None, "no id", 1, "x", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def tokens(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts(docs, spark):
    got = tokencount.token_counts(docs, BYTE, 5).collect()
    rows = docs.collect()
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(k), len(k) > 5) for r, k in zip(rows, tokens([r["text"] for r in rows]), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert tokencount.token_counts(spark.createDataFrame([], SCHEMA), BYTE).isEmpty()


def test_store_gives_its_ids_back(docs, spark):
    root = new_dir(spark, "test")
    manifest = idstore.write_store(docs, BYTE, root)
    rows = [r for r in docs.collect()]
    want, at = [], 0
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0))
    ids = tokens([r["text"] for r in rows])
    for i in order:
        x = [*ids[i], 0]
        want.append((str(rows[i]["doc_id"]), at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    got = sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in idstore.read_digests(spark, root).collect())
    assert [g[1:] for g in sorted(got, key=lambda g: g[1])] == [w[1:] for w in want]
    back = {(str(r["doc_id"]), r["start"]): r["ids"] for r in idstore.read_documents(spark, root).collect()}
    assert sorted(map(str, back.values())) == sorted(str([*x, 0]) for x in ids)
    assert manifest["packs"] and idstore.read_manifest(root)["merkle"] == manifest["merkle"]


def test_a_damaged_pack_is_found(docs, spark):
    root = new_dir(spark, "test")
    pack = idstore.write_store(docs, BYTE, root)["packs"][0]["pack"]
    at = f"{root.removeprefix('file://')}/packs/{pack}"
    raw = bytearray(open(at, "rb").read())
    raw[40] ^= 1
    open(at, "wb").write(raw)
    with pytest.raises(Exception, match="digest"):
        idstore.read_chunks(spark, root).collect()


def local(uri):
    return Path(uri.removeprefix("file:").replace("//", "/"))


@pytest.mark.parametrize("harm", ["recipe lost", "recipe altered", "pack lost", "entry lost", "entry altered"])
def test_a_store_that_lacks_something_is_found(docs, spark, harm):
    root = new_dir(spark, "test")
    manifest = idstore.write_store(docs, BYTE, root)
    at, what = local(root), "packs" if "pack" in harm else "recipes"
    entry = manifest[what][0]
    if harm.startswith("entry"):
        entry["ids"] += 1
        manifest[what] = manifest[what][1:] if "lost" in harm else manifest[what]
        (at / "MANIFEST.json").write_text(json.dumps(manifest))
    else:
        file = at / what / entry[what[:-1]]
        raw = bytearray(file.read_bytes())
        file.unlink()
        if "altered" in harm:
            raw[len(raw) // 2] ^= 1
            file.write_bytes(raw)
    for read in (idstore.read_digests, idstore.read_documents):
        with pytest.raises(Exception, match="Merkle root|differs from its hash|No such file|FileNotFound"):
            read(spark, root).collect()


def test_a_recipe_of_a_chunk_that_no_pack_holds_is_found(docs, spark, monkeypatch):
    root = new_dir(spark, "test")
    idstore.write_store(docs, BYTE, root)
    whole = idstore.read_chunks(spark, root)
    monkeypatch.setattr(idstore, "read_chunks", lambda spark, root, payload: whole.limit(whole.count() - 1))
    with pytest.raises(Exception, match="no pack holds"):
        idstore.read_digests(spark, root).collect()


def test_packs_hold_ids_in_the_order_of_documents(spark, monkeypatch):
    monkeypatch.setattr(idstore, "PACK", 1 << 12)
    shared = " ".join(f"shared{i}" for i in range(900))
    texts = [shared * (i % 3 == 0) + " ".join(f"w{i * k % 997}" for k in range(1, 400)) + shared for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    root = new_dir(spark, "test")
    manifest = idstore.write_store(spark.createDataFrame(rows[::-1], "doc_id bigint, text string").repartition(5), BYTE, root)
    assert len(manifest["packs"]) > 3
    held = []
    for p in manifest["packs"]:
        with open(local(root) / "packs" / p["pack"], "rb") as f:
            held += [(key, x) for key, x in idstore._chunks(f, p["pack"], manifest["width"])]
    want, seen = [], set()
    for ids in tokens(texts):
        ids = np.array([*ids, 0])
        ends = idstore.cut(0, len(ids), idstore.cut_points(ids))
        for a, b in zip([0, *ends], ends, strict=False):
            x = ids[a:b].astype(f"<u{manifest['width']}").tobytes()
            if x not in seen:
                seen.add(x)
                want.append(x)
    assert [x for _, x in held] == want
    back = sorted((r["doc_id"], r["ids"]) for r in idstore.read_documents(spark, root).collect())
    assert back == [(i, [*x, 0]) for i, x in enumerate(tokens(texts))]


def test_a_store_of_no_documents(spark):
    root = new_dir(spark, "test")
    idstore.write_store(spark.createDataFrame([], SCHEMA), BYTE, root)
    assert idstore.read_digests(spark, root).isEmpty() and idstore.read_documents(spark, root).isEmpty()


def test_equal_documents_share_chunks(spark):
    text = "some words that are long enough to make several chunks, number " + " ".join(map(str, range(3000)))
    root = new_dir(spark, "test")
    m = idstore.write_store(spark.createDataFrame([(i, text) for i in range(20)], "doc_id bigint, text string").repartition(4), BYTE, root)
    assert sum(p["ids"] for p in m["packs"]) == len(tokens([text])[0]) + 1


def test_crc_of_parts():
    a, b = b"some bytes", b"and more of them" * 70
    assert int(idstore.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_sentencepiece_equals_the_library(docs, spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted((str(r["doc_id"]), list(r["ids"]), r["round_trip"]) for r in sentencepieces.encode(docs, PIECE).collect())
    assert got == sorted((str(r["doc_id"]), lib.encode(r["text"] or ""), True) for r in docs.collect())
    encoded = sentencepieces.encode(docs, PIECE)
    back = sorted((str(r["doc_id"]), r["text"]) for r in sentencepieces.decode(encoded, PIECE).collect())
    assert back == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_path_is_the_best(spark, tmp_path):
    """A hand-made unigram model against the library's Viterbi."""
    import struct

    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(p, s, 1) for p, s in [("▁", -2.0), ("a", -3.0), ("b", -3.1), ("c", -3.3), ("ab", -4.0), ("bc", -4.4), ("abc", -7.9), ("▁a", -4.1), ("▁ab", -5.0), ("ca", -5.2), ("cab", -6.0), ("▁cab", -8.5)]]
    proto = b"".join(field(1, field(1, t.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + (field(3, k) if k != 1 else b"")) for t, s, k in pieces)
    proto += field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path = tmp_path / "toy.model"
    path.write_bytes(proto)
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["abc cab abcabc", "cabcab bca", "a  b", "aabbcc", "abz zzab", ""]
    got = {r["doc_id"]: list(r["ids"]) for r in sentencepieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), str(path)).collect()}
    assert [got[i] for i in range(len(texts))] == [lib.encode(t) for t in texts]


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_counts(docs):
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality(docs).collect())
    want = sorted((str(r["doc_id"]), *(b := base(r["text"])), b[0] < 20 or 100 * b[4] > 30 * b[0]) for r in docs.collect())
    assert got == want


def test_estimates_find_the_rules_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.85
    of_good, of_bad = np.array([0.99, 0.97, 0.98, 0.95]), np.array([0.6, 0.5, 0.7, 0.4])
    right = rng.random((20000, 4)) < np.where(good[:, None], of_good, of_bad)
    votes = np.where(right, np.where(good[:, None], 1, -1), np.where(good[:, None], -1, 1)) * (rng.random((20000, 4)) < 0.9)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, a, b = quality.estimate(patterns, counts)
    assert abs(prior - 0.85) < 0.03 and np.abs(a - of_good).max() < 0.03 and np.abs(b - of_bad).max() < 0.08
    kept = quality.posterior(votes, prior, a, b) >= 0.5
    assert (kept == good).mean() > 0.93


def test_quality_of_an_empty_table(spark):
    assert quality.quality(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_span_tables_grow():
    """Counts and ids stay those of the library while a cache's tables double several times."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tagloom.llm._pieces import Pieces

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for use in ("counts", "ids"):
        cache = Pieces(path)
        for k in range(4):
            texts = [" ".join(f"w{k}x{i}" for i in range(a, a + 3000)) for a in range(0, 30_000, 3000)]
            data, offsets = tx.column(pa.array(texts))
            want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
            if use == "counts":
                assert cache.counts(data, offsets).tolist() == [len(w) for w in want]
            else:
                ids, first = cache.ids(data, offsets)
                assert ids.tolist() == [i for w in want for i in w] and np.diff(first).tolist() == [len(w) for w in want]
        assert cache.held.bits > 17


def walked(source, text):
    """Phrases of ``text`` by its longest matches with ``source``, one after the other."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in source:
            k += 1
        n, i = n + 1, i + max(1, k - 1)
    return n


@pytest.mark.parametrize("segment", [3, 16, 1024])
def test_phrases_equal_a_walk(monkeypatch, segment):
    import pyarrow as pa

    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = np.random.default_rng(2)
    spaced = lambda letters, n: langid.normal("".join(rng.choice(list(letters), n)))
    sources = {"a": spaced("abc ", 400), "b": spaced("abcde ", 900), "zh": spaced("".join(map(chr, range(0x4E00, 0x4E40))) + " ", 3000), "one": "aaaaaaaaaaaaaaaa"}
    texts = [spaced("abcd ", n) for n in (1, 7, 60, 200, 9000)] + [spaced("".join(map(chr, range(0x4E00, 0x4E50))), 700), "", "a" * 5000, sources["b"][100:700].strip(), sources["zh"]]
    counts, letters = langid.Model(sources).counts(pa.array(texts))
    assert letters.tolist() == [bool(t) for t in texts]
    for k, name in enumerate(sorted(sources)):
        assert counts[k].tolist() == [walked(sources[name], t) for t in texts]


def test_languages_of_one_script():
    """Every letter counts, however many there are, and memory grows with the sample and the alphabet, not with their product."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    write = lambda lo, n: "".join(chr(lo + k) for k in rng.integers(0, 300, n) * rng.integers(0, 2, n))
    model = langid.Model({f"l{i:03d}": write(0x4E00 + 80 * i, 600) for i in range(200)})
    texts = [write(0x4E00 + 80 * i, 400) for i in range(0, 200, 7)]
    best, score, _ = model.predict(pa.array(texts))
    assert [model.names[b] for b in best] == [f"l{i:03d}" for i in range(0, 200, 7)]
    assert all(0.5 <= s <= 1 for s in score)
    assert sum(a.base.nbytes + a.owner.nbytes + a.to.nbytes + a.root.nbytes for a in model.automata) < 200 * (600 * 60 + 20 * model.letters.size)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert right / n > 0.97


def test_copies_take_one_place_of_the_sample(spark):
    texts = [f"text number {i}" for i in range(30)]
    first = spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.xxhash64("text", F.lit("sample"))).head()["text"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + [first] * 300)], "doc_id bigint, text string, lang string").repartition(4)
    got = langid.sample(df, "lang", langid.CHARS, langid.DOCS)["en"]
    assert sorted(got.strip().split("\n")) == sorted(texts)


def test_language_of_odd_texts(docs, spark):
    train = spark.createDataFrame([(i, "the cat and the dog sat on the mat", "en") for i in range(20)] + [(i, "le chat et le chien sont sur le tapis", "fr") for i in range(20, 40)], "doc_id bigint, text string, lang string")
    model = langid.train(train)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.identify(docs, model).collect()}
    assert (0, "und") in got and (1, "und") in got and got[(0, "und")] == 0.0
    assert (16, "en") in got and all(0 <= s <= 1 for s in got.values())
    assert langid.identified(docs, model).columns == docs.columns
    told = {(r["doc_id"], r["lang"]) for r in langid.identified(docs.withColumn("lang", F.lit(None).cast("string")), model).collect()}
    assert (16, "en") in told and not any(i in (0, 1) for i, _ in told)
    empty = langid.train(train.limit(0))
    assert {r["doc_id"] for r in langid.identified(docs, empty).collect()} == {i for i, _ in told}
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_kernels():
    import pyarrow as pa

    data, offsets = tx.column(pa.array(["Ab  cd\n", None, "", "x"]))
    starts, lens, first = tx.words(data, offsets)
    assert list(lens) == [2, 2, 1] and list(first) == [0, 2, 2, 2, 3]
    sets = tx.shingle_sets(*tx.column(pa.array(["A B c d e f", "a b C D E F", "a b", None, "a b c d e a b c d e"])), 5)
    assert len(sets[0]) == 2 and (sets[0] == sets[1]).all() and len(sets[2]) == 1 and len(sets[3]) == 0 and len(sets[4]) == 5
