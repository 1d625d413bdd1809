"""URL filters, ranked search and resampling against brute force, and their SQL on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import resample, search, urlfilter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [urlfilter, search, resample])
def test_query_agrees_with_sql(spark, module):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in module.ORACLE.items():
        got = module.QUERIES[name](spark, SF)
        cur = con.execute(sql)
        order = [c[0] for c in cur.description]
        assert sorted(got.columns) == sorted(order)
        assert sorted(map(repr, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(repr, cur.fetchall()))


# --- url filters

TERMS = {"ab": 1, "abc": 1, "c-d": 1, "bad": 2, "a": 1, "d-ab": 2}


def occurrences(url, terms):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url)
    solid = lambda c: c.isascii() and c.isalnum() or not c.isascii()
    out = Counter()
    for t in terms:
        for i in range(len(low) - len(t) + 1):
            if low.startswith(t, i) and not (i and solid(low[i - 1])) and not (i + len(t) < len(low) and solid(low[i + len(t)])):
                out[t] += 1
    return out


def test_vocabulary_equals_a_plain_scan(spark, monkeypatch):
    rng = random.Random(1)
    urls = ["".join(rng.choice(["a", "b", "c", "d", "-", "/", "AB", "bad", "é", ".", "c-d", "€"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    urls += ["http://x/" + "ab/" * 3000 + "bad", "x" * 511 + "/bad/", "x" * 508 + "/bad", "-" * 510 + "d-ab", None, "", "://", "ab"] + ["bad"] * 50
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in urlfilter.judged(df, (), TERMS).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        hits = occurrences(url or "", TERMS)
        want = (sum(n for t, n in hits.items() if TERMS[t] >= 2), len([t for t in hits if TERMS[t] < 2]), sum(TERMS[t] for t in hits))
        assert (got[i]["strict_hits"], got[i]["soft_terms"], got[i]["weight"]) == want, url
        assert got[i]["verdict"] == ("block" if want[2] >= 2 else "allow") and got[i]["rule"] is None


def test_longest_rule_wins_before_the_vocabulary(spark):
    cases = {
        "https://a.com/": ("a.com", "/", "com/", "allow"),
        "https://a.com": ("a.com", "", None, "allow"),
        "https://notcom/": ("notcom", "/", None, "allow"),
        "https://COM/x?y": ("com", "/x", "com/", "allow"),
        "https://spam-farm.com/": ("spam-farm.com", "/", "com/", "allow"),
        "https://spam-farm.org/": ("spam-farm.org", "/", None, "block"),
        "http://m.Example.com/en/1#z": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/1": ("a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://myexample.com/en/1": ("myexample.com", "/en/1", "com/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/ES/": ("x.net", "/ES/", None, "allow"),
        "x.net/es/": ("", "", None, "allow"),
        "a://b.net?c://d/es/": ("b.net", "", None, "allow"),
        "http:///p\nq?r": ("", "/p\nq", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judged(df, urlfilter.RULES).collect()}
    assert got == cases
    assert urlfilter.judged(df.limit(0), urlfilter.RULES).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judged(df, (), {"Upper": 1})


# --- ranked search


def tokens(text):
    return search.TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """Every document scored for every item, by the formula as it is written."""
    bags = [(d, Counter(tokens(t))) for d, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            if b:
                m = 100 - 75 + (75 * sum(b.values()) * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in tokens(text))
                if s > 0:
                    scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return out


def text_of(rng, words):
    return " ".join(rng.choice(["w", "Word", "é"]) + str(int(rng.paretovariate(0.5)) % 60) + rng.choice(["", ",", "-x", "\n"]) for _ in range(words))


@pytest.mark.parametrize("seed,most,k", [(1, 1 << 20, 10), (2, 400, 3), (3, 2000, 1), (4, 3000, 500)])
def test_search_equals_brute_force(spark, seed, most, k):
    rng = random.Random(seed)
    docs = [(i * 7 % 301, text_of(rng, rng.randint(0, 40))) for i in range(150)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(5000, "w1 " * 3000 + text_of(rng, 500)), (6000, None), (6001, ""), (6002, " .,"), docs[5], docs[5], (None, docs[3][1])]
    rng.shuffle(docs)
    items = [(i, text_of(rng, rng.randint(1, 12))) for i in range(20)] + [(90, docs[3][1]), (91, None), (92, "unseen"), (93, "w1 w1 W1"), (None, "w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    at = search.build_index(df, most=most)
    got = search.search(spark, at, spark.createDataFrame(items, "item_id long, text string"), k)
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(ranked(docs, items, k), key=key)


def test_queries_in_several_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(search, "BLOCK_PAIRS", 12)
    monkeypatch.setattr(search, "SIDE_BY_SIDE", 5)
    rng = random.Random(9)
    docs = [(i, text_of(rng, 15)) for i in range(60)]
    items = [(i % 6, text_of(rng, rng.randint(0, 9))) for i in range(10)]
    at = search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = search.search(spark, at, spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(ranked(docs, items, 4))


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(spark, search.build_index(none), items).count() == 0
    some = search.build_index(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"))
    assert search.search(spark, some, items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(spark, some, items).collect()] == ranked([(1, "a"), (2, None)], [(1, "a")], 10)


def test_only_a_part_of_the_documents_is_looked_at(monkeypatch):
    """Bounds save work: a rare phrase among many documents opens few leaves."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 60)) for _ in range(4096)]
    texts[1234] = "alpha beta gamma delta " * 3
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    made = search._shard(np.arange(4096), data, offsets, 4096, 250_000)
    import pyarrow as pa

    shard = search.Shard({k: pa.scalar(v, pa.binary()) for k, v in made.items()})
    hashes = search._hashes(["alpha", "beta", "gamma", "w7", "w8"])
    best, leaves = search.Best(1, 1), []
    add = best.add
    monkeypatch.setattr(best, "add", lambda q, s, d: (leaves.append(len(d)), add(q, s, d)))
    a, b = shard.lists(hashes)
    search.best_first(shard, best, np.zeros(5, np.int64), np.array([8000, 8000, 8000, 4000, 4000]), a, b)
    assert best.doc.tolist() == [1234] and sum(leaves) < 410  # of 4,096


# --- resampling


def drawn(docs, target, percent, seed, longest, count, least):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % count for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    of = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in of for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + count) / ((s[b] + 1) * (big_t + count)))) for b in range(count)]
    rows = []
    for d, n, f in of:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("longest,count,percent", [(1, 10_000, 10), (2, 50, 35), (3, 7, 100)])
def test_resampling_equals_brute_force(spark, longest, count, percent):
    rng = random.Random(longest)
    docs = [(i, text_of(rng, rng.randint(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, "w1 " * 9000), (None, text_of(rng, 30))]
    docs += [(300 + i, docs[7][1]) for i in range(30)]
    target = [text_of(rng, 25) for _ in range(9)] + [None]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit(0), "w": F.lit(1), "score": F.lit("s")}).repartition(5)
    got = resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, 11, longest, count, 20)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, drawn(docs, target, percent, 11, longest, count, 20)))


def test_resampling_ranks_rows_that_repeat_and_empty_tables(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    same = spark.createDataFrame([(1, "a b c " * 10)] * 20, "doc_id long, text string").repartition(4)
    ranks = sorted(r["rank"] for r in resample.resampled(same, target, percent=50).collect() if r["rank"])
    assert ranks == list(range(1, 11))
    assert resample.resampled(same.limit(0), target).count() == 0
    assert resample.resampled(same, target.limit(0)).count() == 20
