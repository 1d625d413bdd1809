"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated without labels.

Each rule says good (1), bad (-1) or nothing (0) about a document. Expectation-maximisation over the
counts of vote patterns, of which there are at most 3 ** rules whatever the corpus, estimates how
often each rule is right about good and about bad documents and how many documents are good; a
document is kept when the posterior probability of good is a half or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import _text as tx
from tagloom.llm._work import stored, table

WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks", "n_echoes", "n_distinct", "n_alnum", "n_bare")
_SYMBOL, _MARK, _UPPER, _LOWER, _ALNUM = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"!?")] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER[ord("a") : ord("z") + 1] = True
_ALNUM[list(b"0123456789") + list(range(0xC0, 0x100))] = True  # first bytes of characters beyond ASCII count as letters
_ALNUM |= _UPPER | _LOWER


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _firsts(key: np.ndarray) -> np.ndarray:
    """Flags of the first row of each key."""
    out = np.zeros(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All features of each text, counted over the whole text."""
    data, offsets = tx.column(column)
    n, docs = int(offsets[-1]), len(offsets) - 1
    body = data[:n]
    starts, lens, first = tx.words(data, offsets)
    h = tx.hash_spans(data, starts, lens)
    doc = np.repeat(np.arange(docs), np.diff(first))
    salt = tx.mix(np.arange(docs, dtype=np.uint64) + np.uint64(1))
    out = {"n_words": np.diff(first)}
    out["word_chars"] = _per_doc(~tx.SPACE[body] & ((body & 0xC0) != 0x80), offsets)
    for name, table_ in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_marks", _MARK), ("n_alnum", _ALNUM)):
        out[name] = _per_doc(table_[body], offsets)
    alnum = np.concatenate(([0], np.cumsum(_ALNUM[body], dtype=np.int32)))
    out["n_bare"] = _per_doc(alnum[starts + lens] == alnum[starts], first)
    # words in windows that occur again in the text
    g, at = tx.grams(h, first, WINDOW)
    owner = doc[at]
    _, back, counts = np.unique(g ^ salt[owner], return_inverse=True, return_counts=True)
    again = at[counts[back] > 1] if len(g) else at
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(cover)[: len(h)] > 0, first)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out["n_echoes"] = _per_doc(echo, first)
    out["n_distinct"] = _per_doc(_firsts(h ^ salt[doc]), first)
    # lines with a word
    newline = np.flatnonzero(body == 0x0A)
    begin = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], newline[newline + 1 < n] + 1)))
    stop = np.minimum(np.append(begin[1:], n), n)
    size = stop - begin
    ends = size > 0
    size[ends] -= body[stop[ends] - 1] == 0x0A
    worded = np.searchsorted(starts, begin + size) > np.searchsorted(starts, begin)
    begin, size = begin[worded], size[worded]
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    fresh = _firsts(tx.hash_spans(data, begin, size) ^ salt[line_doc])
    out["n_lines"] = np.bincount(line_doc, minlength=docs)
    out["n_dup_lines"] = np.bincount(line_doc, weights=~fresh, minlength=docs).astype(np.int64)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.slices(batches, "text"):
        got = measure(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[f].astype(np.int64)) for f in FEATURES)], names=["doc_id", *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of each row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features, "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES))


def _vote(ratio: Column, good: Column, bad: Column) -> Column:
    return F.when(ratio.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name, over the columns of ``features``. An empty document makes most rules abstain."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    part = lambda name, of=words: F.col(name) / of
    low = lambda x, good, bad: _vote(x, x <= good, x > bad)
    high = lambda x, good, bad: _vote(x, x >= good, x < bad)
    mean = part("word_chars")
    letters = F.col("n_upper") + F.col("n_lower")
    return {
        "length": high(F.col("n_words"), 50, 20),
        "word_length": _vote(mean, mean.between(3, 10), ~mean.between(2, 15)),
        "symbols": low(part("n_symbols"), 0.02, 0.1),
        "dup_lines": low(part("n_dup_lines", F.when(F.col("n_lines") > 1, F.col("n_lines"))), 0.05, 0.3),
        "repeats": low(part("n_repeat_words"), 0.05, 0.2),
        "capitals": low(part("n_upper", F.when(letters > 0, letters)), 0.2, 0.4),
        "marks": low(part("n_marks"), 0.05, 0.2),
        "echoes": low(part("n_echoes"), 0.02, 0.1),
        "letters": high(part("n_alnum", F.when(F.col("word_chars") > 0, F.col("word_chars"))), 0.9, 0.8),
        "bare": low(part("n_bare"), 0.02, 0.1),
        "variety": high(part("n_distinct"), 0.3, 0.1),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents and, for each rule, how often its vote is right about good and about bad ones.

    ``patterns``: votes, a row for each pattern; ``counts``: its documents. A rule looks for one kind
    of fault, so it begins as one that seldom blames a good document and finds three bad ones in
    ten; some made-up documents of that kind keep a rule that never votes there. A bad vote stays
    evidence of a bad document: a rule is never believed to be worse than a coin.
    """
    good, bad = patterns == 1, patterns == -1
    k = patterns.shape[1]
    prior, of_good, of_bad = 0.8, np.full(k, 0.99), np.full(k, 0.3)
    weight = counts.astype(np.float64)
    for _ in range(rounds):
        p = posterior(patterns, prior, of_good, of_bad)
        before = np.concatenate(([prior], of_good, of_bad))
        w, v = (weight * p)[:, None], (weight * (1 - p))[:, None]
        of_good = np.clip(((w * good).sum(0) + 9.9) / ((w * (good | bad)).sum(0) + 10), 0.5, 0.999)
        of_bad = np.clip(((v * bad).sum(0) + 3) / ((v * (good | bad)).sum(0) + 10), 1.001 - of_good, 0.999)
        prior = float(np.clip((w.sum() + 8) / (weight.sum() + 10), 0.05, 0.95))
        if np.abs(np.concatenate(([prior], of_good, of_bad)) - before).max() < 1e-10:
            break
    return prior, of_good, of_bad


def weights(prior: float, of_good: np.ndarray, of_bad: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log odds of good: at first, of a good vote and of a bad vote of each rule."""
    return float(np.log(prior / (1 - prior))), np.log(of_good / (1 - of_bad)), np.log((1 - of_good) / of_bad)


def posterior(patterns: np.ndarray, prior: float, of_good: np.ndarray, of_bad: np.ndarray) -> np.ndarray:
    first, up, down = weights(prior, of_good, of_bad)
    return 1 / (1 + np.exp(-(first + (patterns == 1) @ up + (patterns == -1) @ down)))


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed, kept and p_good of each row of ``docs`` (doc_id, text).

    base_failed: fewer than 20 words, or over 30 % of the words repeated. kept: not base_failed and
    p_good, rounded to nine places, is ``least`` or more. Null text is an empty one and fails. Null
    and repeated doc_ids: a row each. Other columns are left out; an empty table gives none.
    """
    votes = rules()
    measured = features(docs).withColumns({f"vote_{k}": v for k, v in votes.items()})
    measured = stored(measured, "quality")
    names = [f"vote_{k}" for k in votes]
    counted = measured.groupBy(*names).agg(F.count(F.lit(1)).alias("docs")).collect()  # at most 3 ** rules rows
    counted.sort()
    patterns = np.array([r[:-1] for r in counted], np.int64).reshape(-1, len(names))
    first, up, down = weights(*estimate(patterns, np.array([r["docs"] for r in counted], np.float64)))
    odds = F.lit(first)
    for name, u, d in zip(names, up, down, strict=True):
        odds = odds + F.when(F.col(name) == 1, float(u)).when(F.col(name) == -1, float(d)).otherwise(0.0)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    p = F.round(1 / (1 + F.exp(-odds)), 9)
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & (p >= least)).alias("kept"), p.alias("p_good"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


QUERIES = {"op2_quality": query}
ORACLE: dict[str, str] = {}
