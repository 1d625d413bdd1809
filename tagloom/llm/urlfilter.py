"""URL filters: a weighted vocabulary sought with Aho-Corasick, behind rules on hosts and paths.

The terms become one automaton with a next state for every byte. All URLs of an Arrow slice walk it
together, a byte a step, so a slice costs as many numpy steps as its longest piece has bytes; a long
URL is cut into pieces that overlap by the longest term. A term counts where no letter or digit
touches it. Rules are looked up by the suffixes of the host; the longest that fits goes before the
vocabulary.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import _text as tx
from tagloom.llm._work import table

#: Weight from which on a url is blocked; a strict term has it alone.
LIMIT = 2
#: Terms that block alone.
STRICT = ("cheap-pills", "casino-win", "spam-farm", "buy-followers", "xxx", "porn", "viagra", "warez")
#: Terms of weight 1: several different ones block.
SOFT = ("casino", "pills", "spam", "adult", "bet", "jackpot", "loan", "cheap", "win", "free-download", "crack", "escort")
#: The rules of the registered query, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PIECE = 512
_SOLID = np.zeros(256, bool)
_SOLID[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True


def vocabulary(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, limit: int = LIMIT) -> dict[str, int]:
    """Weights by term; a term that is both is strict."""
    return dict.fromkeys(soft, 1) | dict.fromkeys(strict, limit)


@dataclass
class Automaton:
    """``step[state, byte]`` is the next state; ``ends[state]`` starts the terms that end there, ``then`` lists them."""

    step: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    lens: np.ndarray


def automaton(terms: Sequence[bytes]) -> Automaton:
    """Trie, failure links in breadth-first order, and the transitions they complete."""
    step, own = [[-1] * 256], [[]]
    for n, term in enumerate(terms):
        at = 0
        for b in term:
            if step[at][b] < 0:
                step[at][b] = len(step)
                step.append([-1] * 256)
                own.append([])
            at = step[at][b]
        own[at].append(n)
    fail, queue = [0] * len(step), deque([0])
    while queue:
        at = queue.popleft()
        for b, to in enumerate(step[at]):
            back = step[fail[at]][b] if at else 0
            if to < 0:
                step[at][b] = back
            else:
                fail[to] = back
                own[to] = own[to] + own[back]
                queue.append(to)
    counts = [len(o) for o in own]
    return Automaton(np.array(step, np.int32), np.concatenate(([0], np.cumsum(counts))).astype(np.int64), np.array([t for o in own for t in o], np.int64), np.array([len(t) for t in terms], np.int64))


@lru_cache(8)
def _compiled(terms: tuple[str, ...]) -> Automaton:
    return automaton([t.encode() for t in terms])


def occurrences(machine: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every occurrence that no letter or digit touches; ``data`` is in lower case and ends with eight zero bytes."""
    overlap = int(machine.lens.max(initial=1)) - 1
    size = np.diff(offsets)
    pieces = np.maximum(1, -(-size // PIECE))
    row = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    keep_from = offsets[row] + nth * PIECE  # ends before this belong to the piece before
    begin = np.maximum(keep_from - overlap, offsets[row])
    stop = np.minimum(keep_from + PIECE, offsets[row + 1])
    order = np.argsort(begin - stop, kind="stable")  # the longest first, so that those still walking are a prefix
    row, begin, stop, keep_from = row[order], begin[order], stop[order], keep_from[order]
    length, state = stop - begin, np.zeros(len(row), np.int32)
    loud = np.diff(machine.first) > 0
    rows, ends, states = [], [], []
    for k in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -k, "left"))  # pieces longer than k
        state[:live] = machine.step[state[:live], data[begin[:live] + k]]
        hit = np.flatnonzero(loud[state[:live]])
        hit = hit[begin[hit] + k >= keep_from[hit]]
        if len(hit):
            rows.append(row[hit])
            ends.append(begin[hit] + k + 1)
            states.append(state[hit])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, e, s = np.concatenate(rows), np.concatenate(ends), np.concatenate(states)
    many = machine.first[s + 1] - machine.first[s]
    r, e = np.repeat(r, many), np.repeat(e, many)
    at = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(machine.first[s], many)
    term = machine.terms[at]
    b = e - machine.lens[term]
    before = (b > offsets[r]) & _SOLID[data[b - 1]]
    after = (e < offsets[r + 1]) & _SOLID[data[e]]
    ok = ~(before | after)
    return r[ok], term[ok]


def _scan(name: str, weights: dict[str, int], limit: int):
    terms = tuple(sorted(weights))
    weight = np.array([weights[t] for t in terms], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(terms)
        for batch in tx.slices(batches, name):
            data, offsets = tx.column(batch.column(name))
            row, term = occurrences(machine, tx.LOWER[data], offsets)
            n, k = batch.num_rows, max(1, len(terms))
            strict = weight[term] >= limit if len(term) else np.zeros(0, bool)
            pair = np.unique(row * k + term)
            row_of, w = pair // k, weight[pair % k] if len(pair) else np.zeros(0, np.int64)
            count = lambda rows, of=None: pa.array(np.bincount(rows, weights=of, minlength=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, count(row[strict]), count(row_of[w < limit]), count(row_of, w)],
                names=[*batch.schema.names, "strict_hits", "soft_terms", "weight"],
            )

    return run


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty where it is null or has no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<size, rule, verdict> of the longest rule whose host is the url's or one above it and whose path the url's begins with; null if none fits.

    Each suffix of the host at a dot looks into a literal map, so the cost of a row doesn't grow with
    the number of rules. Two rules of one host and path: the later one stands.
    """
    by_host: dict[str, dict[str, str]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h.lower(), {})[p] = verdict
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    listed = [(h, [(len(h) + len(p), p, h + p, v) for p, v in per.items()]) for h, per in sorted(by_host.items())]
    found = F.map_from_entries(F.array(*[F.struct(F.lit(h).alias("k"), F.array(*[F.struct(F.lit(n).alias("size"), F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for n, p, r, v in of]).alias("v")) for h, of in listed]))
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fitting = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(found, s)), lambda x: x.isNotNull())), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return best


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = (), weights: dict[str, int] | None = None, limit: int = LIMIT, url: str = "url") -> DataFrame:
    """The rows of ``pages`` with host, path, rule, verdict, strict_hits, soft_terms and weight.

    The verdict is the longest fitting rule's; where none fits (rule null), ``block`` if the weights
    of the different terms found in the whole url come to ``limit`` (2: one strict or two different soft
    ones), else ``allow``. strict_hits counts every occurrence of strict terms, soft_terms different
    soft ones. Null and empty urls have no host, path or hits. A column that has one of the new names
    is replaced. Nothing is shuffled; equal rows are judged alike; an empty table gives none. Rules and
    vocabulary are parameters that every task holds: up to some 100,000 rules or terms.
    """
    weights = vocabulary(limit=limit) if weights is None else weights
    if any(not t or t != t.lower() for t in weights):
        raise ValueError("terms are in lower case and not empty")
    new = ("host", "path", "rule", "verdict", "strict_hits", "soft_terms", "weight")
    kept = pages.drop(*new)
    out = kept.mapInArrow(_scan(url, weights, limit), f"{_ddl(kept)}, strict_hits long, soft_terms long, weight long")
    host, path = host_path(F.col(url))
    out = out.withColumns({"host": host, "path": path}).withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    by_terms = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    return out.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce("__rule.verdict", by_terms)}).drop("__rule")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def _sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    edge = r"[^0-9a-z\x{80}-\x{10FFFF}]"
    # a shared boundary character may end one occurrence and begin the next, so it is doubled before counting
    text = rf"regexp_replace(low, '({edge})', '\1\1', 'g')"
    bounded = lambda t: rf"(?:^|{edge}){''.join(c * 2 if not c.isalnum() else c for c in t)}(?:$|{edge})"
    strict = " + ".join(f"len(regexp_extract_all({text}, '{bounded(t)}'))" for t in STRICT)
    soft = " + ".join(f"regexp_matches(low, '(^|{edge}){t}($|{edge})')::bigint" for t in SOFT)
    any_strict = " + ".join(f"{LIMIT} * regexp_matches(low, '(^|{edge}){t}($|{edge})')::bigint" for t in STRICT)
    fits = " union all ".join(f"select '{v}' as v, '{h}' as h, '{p}' as p" for v, h, p in RULES)
    return f"""
with u as (select page_id, {low} as low, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
t as (select *, ({strict})::bigint as strict_hits, ({soft})::bigint as soft_terms, ({soft} + {any_strict})::bigint as weight from s),
rules as ({fits}),
f as (select t.*, r.h || r.p as rule, r.v from t left join rules r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p)),
b as (select * from f qualify row_number() over (partition by page_id order by len(rule) desc nulls last) = 1)
select page_id, host, path, rule, coalesce(v, case when weight >= {LIMIT} then 'block' else 'allow' end) as verdict, strict_hits, soft_terms, weight from b
"""


QUERIES = {"op11_url_filter": query}
ORACLE = {"op11_url_filter": _sql()}
