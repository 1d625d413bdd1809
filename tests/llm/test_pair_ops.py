"""Joins, near-duplicates, mixing and archives against brute force."""

import base64
import hashlib
import random
import re
from fractions import Fraction
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import cosine, lines, mixing, ngram_join, warc
from tagloom.llm._graph import components
from tagloom.llm._work import new_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, h int, n int, row int, size int"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def edited(rng, words, count):
    out = list(words)
    for _ in range(count):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [None, "", "  ", "one", "one", "a b", "A b", "a b c d e", "a b c d e f", "b c d e f g"]
    passage = rng.choices(vocabulary, k=60)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 7, 9, 14, 30, 80, 400]))
        out += [" ".join(base)] * 2 + [" ".join(edited(rng, base, k)) for k in (1, 1, 2, 3)] + [" ".join(base[:-1]), " ".join([*base, "end"])]
    hub = rng.choices(vocabulary, k=250)
    out += [" ".join(edited(rng, hub, rng.randint(1, 8))) for _ in range(60)] + [" ".join(hub)]
    out += [" ".join(rng.choices(vocabulary, k=rng.randint(3, 20)) + passage) for _ in range(30)]
    rng.shuffle(out)
    return out


def test_ngram_join(spark, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    u = Union()
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                u.join(i, j)
    rows = [(i, t, "en", "s", 1, 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], (None, texts[20], *rows[0][2:])], EXTRA).repartition(5)
    got = ngram_join.ngram_join(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), u.find(r["doc_id"])), texts[r["doc_id"]]
    kept = ngram_join.one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(i for i in sets if u.find(i) == i)
    assert kept[0].asDict().keys() == dict.fromkeys(df.columns).keys()
    assert ngram_join.ngram_join(df.limit(0)).isEmpty()


@pytest.mark.parametrize("below", [2, 8, 14])
def test_every_boundary_gives_the_same_links(spark, texts, monkeypatch, below):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").where(F.size(F.split("text", " ")) < 40).repartition(3)
    want = sorted(map(tuple, ngram_join.ngram_join(df).collect()))
    monkeypatch.setattr(ngram_join, "boundary", lambda sizes, t: below)
    assert sorted(map(tuple, ngram_join.ngram_join(df).collect())) == want


def test_bounds_of_the_join():
    t = Fraction(4, 5)
    for a in range(1, 60):
        assert ngram_join.prefix(a, t) == a - ceil(0.8 * a - 1e-9) + 1
        for b in range(a, 60):
            c = ngram_join.share(a, b, t)
            assert 5 * c >= 4 * (a + b - c) and 5 * (c - 1) < 4 * (a + b - c + 1)
    assert ngram_join.boundary({}, t) >= 2
    rng = np.random.default_rng(3)
    x, y = (np.unique(rng.integers(0, 2**63, 900).astype(np.uint64)) for _ in range(2))
    x[:700] = y[:700]
    least = np.minimum(np.frombuffer(ngram_join.sketch(x), np.uint8), np.frombuffer(ngram_join.sketch(y), np.uint8)).sum(dtype=int)
    assert least >= len(np.intersect1d(x, y))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {x: u.find(x) for x in u.up}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).isEmpty()


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[j - 1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance(spark):
    rng = random.Random(2)
    rows = [("", "a"), ("a", "ab"), ("abc", "abc"), ("éab", "eab")]
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(2, 24))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "ac"])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for tau in (1, 2, 3):
        got = df.select("a", "b", lines.banded_distance(F.split("a", ""), F.split("b", ""), tau).alias("d")).collect()
        assert all((r["d"] if r["d"] <= tau else None) == (d if (d := distance(r["a"], r["b"])) <= tau else None) for r in got if len(r["a"]) >= tau and r["b"])


def alike(a, b):
    """The relation of the line operator, by its definition."""
    x, y = a.split(" "), b.split(" ")
    few = min(len(x), len(y))
    if min(len(a), len(b)) < lines.NEAR:
        return False
    if few >= lines.WORDS:
        most = min(3, few // 10)
        return abs(len(x) - len(y)) <= most and len(set(x) - set(y)) <= most and distance(x, y) <= most
    return abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2


def deduplicated(docs):
    """Texts without the lines that are alike to, or linked with, a line before; by all pairs."""
    places = [(i, k, line) for i, t in docs.items() if t is not None for k, line in enumerate(t.split("\n")) if line]
    distinct, u, first = sorted({p[2] for p in places}), Union(), {}
    for n, a in enumerate(distinct):
        u.find(a)
        for b in distinct[:n]:
            if alike(a, b):
                u.join(a, b)
    for i, k, line in sorted(places, key=lambda p: (p[0] is None, p[0], p[1])):
        first.setdefault(u.find(line), (i, k))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x or first[u.find(x)] == (i, k)) for i, t in docs.items()}


def test_line_dedup(spark):
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 90))) for _ in range(25)]

    def vary(line):
        line = list(line)
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            line[rng.randrange(len(line))] = rng.choice("xyz ")
        return "".join(line)

    docs = {i: "\n".join(rng.choice([vary(rng.choice(known)), "short", "", "a line of its own " + str(rng.random())]) for _ in range(rng.randint(1, 9))) for i in range(90)}
    docs |= {90: None, 91: "", 92: known[0], 93: "é" * 30 + "\n" + "é" * 29 + "è", 94: " ".join("abcdefghi") + " jklm", 95: " ".join("abcdefghi") + "jklm"}
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4, 5, 6) for i, t in docs.items()], EXTRA).repartition(4)
    got = lines.without_repeats(df).collect()
    assert {r["doc_id"]: r["text"] for r in got} == deduplicated(docs)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and (r["row"], r["key"], r["h"]) == (5, 2, 3) for r in got)
    assert lines.without_repeats(df.limit(0)).isEmpty()


def test_lines_with_replaced_words(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    kept = []
    for size in [9, 10, 11, 12, 15, 19, 20, 25, 29, 30, 31, 40, 60, 100, 200, 700] * 2:
        base = rng.choices(vocabulary, k=size)
        kept.append(base)
        for n in {1, 2, 3, 4}:
            kept.append(edited(rng, base, n))
            cut, more = list(base), list(base)
            for _ in range(n):
                del cut[rng.randrange(len(cut))]
                more.insert(rng.randrange(len(more) + 1), "new")
            kept += [cut, more]
    kept += [["a"] * n for n in (10, 11, 12, 30, 33, 40)]
    docs = {i: " ".join(w) for i, w in enumerate(kept)}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(df).collect()}
    assert got == deduplicated(docs)
    assert sum(t == "" for t in got.values()) > 100


def test_alike_lines_share_a_key(spark):
    """One of two alike lines is found under a key of the other, wherever words come in and go."""
    rng = random.Random(31)
    pairs = []
    for size in [10, 11, 12, 15, 19, 20, 21, 24, 29, 30, 31, 33, 35, 40, 47, 60] * 25:
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(rng.choice([2, 40]))) for _ in range(size)]
        b = list(a)
        for kind in rng.choice([("ins", "del"), ("del", "ins"), ("ins", "del", "put"), ("del", "put", "ins"), ("ins",), ("del", "del"), ("ins", "ins", "del"), ("put", "put", "put")]):
            k = rng.randrange(len(b))
            b[k : k + (kind != "ins")] = [] if kind == "del" else [f"new{rng.randrange(9)}"]
        if distance(a, b) <= min(3, min(len(a), len(b)) // 10) and min(len(a), len(b)) >= lines.WORDS:
            pairs.append((a, b))
    df = spark.createDataFrame([(2 * i + k, " ".join(x)) for i, p in enumerate(pairs) for k, x in enumerate(p)], "id bigint, line string").where(F.char_length("line") >= lines.NEAR)
    keys = {}
    for r in lines.segment_keys(df, 10, 3, 2).where("key % 2 <> 0").collect():
        keys.setdefault(r["id"], {}).setdefault(r["key"], set()).add(r["own"])
    assert len(pairs) > 150
    for i in range(len(pairs)):
        a, b = keys[2 * i], keys[2 * i + 1]
        assert any(True in a[k] | b[k] for k in a.keys() & b.keys()), pairs[i]


def test_lines_of_a_template(spark, monkeypatch):
    """Lines that share segments but aren't alike aren't compared, and those that are still meet."""
    rng = random.Random(12)
    base = [f"word{i}" for i in range(30)]

    def of_template(count):
        out = list(base)
        for k in rng.sample(range(30), count):
            out[k] = f"c{rng.randrange(10**7)}"
        return out

    kept = [of_template(rng.choice([6, 6, 6, 7, 9])) for _ in range(300)]
    kept += [edited(rng, rng.choice(kept), rng.choice([1, 2, 3, 4])) for _ in range(60)]
    docs = {i: " ".join(w) for i, w in enumerate(kept)} | {1000 + i: f"Order {rng.randrange(10**9, 10**10)} has been sent" for i in range(150)}
    compared = []
    real = lines._compared
    monkeypatch.setattr(lines, "_compared", lambda pairs, *a: (compared.append(pairs.count()), real(pairs, *a))[1])
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["text"] for r in lines.without_repeats(df).collect()} == deduplicated(docs)
    assert sum(compared) < 10 * len(docs)


def test_short_lines_that_repeat(spark):
    df = spark.createDataFrame([(1, "Les.\n\nLes.\nLet.\n "), (2, "Les.\na\n\n "), (3, "a")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(df).collect()}
    assert got == {1: "Les.\n\nLet.\n ", 2: "a\n", 3: ""}


def test_rows_that_repeat_are_treated_alike(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line), (2**63 - 1, line + "\nhere alone"), (None, "here alone")], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in lines.without_repeats(df).collect())
    assert got == [("1", line), ("1", line), ("2", ""), (str(2**63 - 1), "here alone"), ("None", ""), ("None", "")]


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300, 2000])), "en", rng.choice(["a", "b", "é", None, "a"]), 1, 2, 3, 4, 5, 6) for i in range(600)]
    rows += [(1000, None, "en", "a", 1, 2, 3, 4, 5, 6)] + [(2000, "w " * 30, "en", "b", 1, 2, 3, 4, 5, 6)] * 40
    df = spark.createDataFrame(rows, EXTRA).repartition(3)
    got = mixing.mix(df).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(mixing.mix(df.repartition(7)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect(), key=str)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, rest = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(sizes.values())
    open_ = list(names)
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        target |= {s: 2 * sizes[s] for s in over} if over else share
        rest -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s in over and False or s not in over] if over else []
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - target[s]) <= max(5, 0.01 * target[s])
        assert all(0 <= r["copies"] <= 2 for r in mine)
    again = mixing.mixed(df)
    assert again.columns == df.columns and again.count() == sum(r["copies"] for r in got)
    assert mixing.mix(df.limit(0)).isEmpty()


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 16))
    for i in range(200):
        x[500 + i] = x[i % 40] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4])
    x[650:] = x[3] * 2.5
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)]
    odd = [(700, None, "x", 1), (701, [0.0] * 16, "x", 1), (702, [float("nan")] * 16, "x", 1), (703, [1.0, None] * 8, "x", 1), (704, [], "x", 1), (705, [1.0, 2.0], "x", 1), (706, [2.0, 4.0], "x", 1), (707, [1e300] * 16, "x", 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, node string, cell int").repartition(4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in cosine.near_duplicates(df).collect()}
    assert len(got) == 708
    found = sum(got[i]["n_links"] for i in range(700))
    assert found <= linked.sum() and found >= 0.98 * linked.sum()
    assert all(got[i]["n_links"] <= linked[i].sum() for i in range(700))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (700, 701, 702, 703, 704)) and got[706]["component_id"] == 705
    exact = {r["vec_id"]: r for r in cosine.near_duplicates(df, cells=1).collect()}
    u = Union()
    for i, j in zip(*np.nonzero(linked), strict=True):
        u.join(int(i), int(j))
    assert all((exact[i]["n_links"], exact[i]["component_id"]) == (linked[i].sum(), u.find(i)) for i in range(700))
    assert cosine.near_duplicates(df.limit(0)).isEmpty()


def test_archives(spark):
    html = ["<p>é</p>", "", None, "x" * 50000, "<p>é</p>", "same", "same", "same"]
    rows = [(i, f"http://h/{i}\r\nX: y", h, "d") for i, h in enumerate(html)] + [(None, None, "same", "d")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(3)
    root = new_dir(spark, "test")
    m = warc.write_archives(df, root, roll=2000)
    got = {r["page_id"]: r for r in warc.read_archives(spark, root).collect()}
    largest = {}
    for i, h in enumerate(html):
        largest[h or ""] = i
    for i, h in enumerate(html):
        raw, top = (h or "").encode(), largest[h or ""]
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == top else ("revisit", top))
        assert r["payload"] == (raw if i == top else None)
    assert got[None]["refers_to"] == 7 and len(m["files"]) > 1
    again = warc.write_archives(df.repartition(5), new_dir(spark, "test"), roll=2000)
    assert sum(f["records"] for f in again["files"]) == 9
    small = new_dir(spark, "test")
    warc.write_archives(df, small, least=10)
    assert {r["page_id"] for r in warc.read_archives(spark, small).collect() if r["record_type"] == "revisit"} == set()
    nothing = new_dir(spark, "test")
    warc.write_archives(df.limit(0), nothing)
    assert warc.read_archives(spark, nothing).isEmpty()
