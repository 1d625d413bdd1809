"""Language identification by cross-parsing.

For each language the labelled text of a bounded sample is put into a suffix automaton. A document
is read from left to right: the longest match of what follows with the language's text is a phrase
(Ziv and Merhav, 1993). Phrases per character estimate the cross entropy between the document and
the language; the language that needs the fewest wins.

An automaton's transitions are stored sparsely: rows of a table (state x letter) are laid over each
other so that no two entries share a place, so memory grows with the sample, not with the alphabet.
Many documents advance together, one letter a step, so that a step is a few numpy operations. Long
documents are cut into segments that advance side by side; afterwards each segment's beginning is
parsed again from the state in which the one before it ends, until both parses are in the same
state, so that the phrases are those of the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm import _text as tx
from tagloom.llm._work import table

#: Bounds of the sample: characters of each language and documents they come from.
CHARS, DOCS = 50_000, 200
#: Letters of a segment; no result depends on it.
SEGMENT = 1024
UNKNOWN = "und"
_SALTS = 64


def sample(docs: DataFrame, label: str, chars: int, docs_each: int) -> dict[str, str]:
    """Text of each label: the documents first by hash, at most ``docs_each`` of them, until ``chars`` characters are reached.

    Texts are taken whole but for the one in which the bound lies. Copies of a text count once. Only
    hashes and lengths are ranked, in two rounds, the first inside a label's parts by hash, so that no
    task gets a whole label; then the chosen texts are fetched.
    """
    rows = docs.where(F.col(label).isNotNull() & (F.length("text") > 0)).select(F.col(label).alias("label"), F.xxhash64("text", F.lit("sample")).alias("at"), F.char_length("text").alias("n"), "text")
    keys = rows.drop("text").dropDuplicates(["label", "at", "n"]).withColumn("salt", F.pmod("at", F.lit(_SALTS)))
    for parts in (["label", "salt"], ["label"]):
        keys = keys.withColumn("rank", F.row_number().over(W.partitionBy(*parts).orderBy("at", "n"))).where(F.col("rank") <= docs_each)
    keys = keys.withColumn("before", F.sum("n").over(W.partitionBy("label").orderBy("rank")) - F.col("n")).where(F.col("before") < chars)
    taken = rows.join(F.broadcast(keys.select("label", "at", "n", "before")), ["label", "at", "n"])  # at most docs_each rows a label
    parts = taken.select("label", "before", F.substring("text", F.lit(1), (chars - F.col("before")).cast("int")).alias("part")).distinct().collect()  # at most ``chars`` characters a label
    out: dict[str, str] = {}
    for r in sorted(parts, key=lambda r: (r["label"], r["before"], r["part"])):
        out[r["label"]] = f"{out[r['label']]}\n{r['part']}" if r["label"] in out else r["part"]
    return out


def normal(text: str) -> str:
    """Lower case, everything but letters a single space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Letters:
    """Codes of characters: 0 a break, 1.. the letters of the samples, the last one any other letter."""

    def __init__(self, texts: list[str]):
        top = sorted({c for t in texts for c in t if c != " "})
        self.size = len(top) + 2
        codes = {c: i + 1 for i, c in enumerate(top)}
        every = [chr(i) for i in range(0x3000)]
        self.table = np.array([codes.get(c.lower() if len(c.lower()) == 1 else c, self.size - 1) if c.isalpha() else 0 for c in every], np.int32)
        self.far = {ord(c): i for c, i in codes.items() if ord(c) >= 0x3000}

    def encode(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        low = points < 0x3000
        out[low] = self.table[points[low]]
        high = np.flatnonzero(~low)
        if len(high):
            names, back = np.unique(points[high], return_inverse=True)
            out[high] = np.array([self.far.get(int(p), self.size - 1 if chr(p).isalpha() else 0) for p in names], np.int32)[back]
        return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``; state 0 is the empty match."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(step)
        step.append({}), length.append(length[last] + 1), link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q])), length.append(length[p] + 1), link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


class Automaton:
    """Sparse transitions: that of state s by letter c stands at ``base[s] + c`` if ``owner`` says s there."""

    def __init__(self, step: list[dict[int, int]], letters: int):
        rows = sorted(range(len(step)), key=lambda s: -len(step[s]))
        base, taken, free, end = [0] * len(step), bytearray(letters + 1), 0, 0
        for s in rows:
            own = step[s]
            if not own:
                break
            least = min(own)
            gaps = [c - least for c in own]
            while taken[free]:
                free += 1
            at, tries = max(free, least), 0
            while True:
                if at + letters >= len(taken):
                    taken.extend(bytes(len(taken)))
                if not any(taken[at + g] for g in gaps):
                    break
                tries += 1
                at = at + 1 if tries < 64 else max(at + 1, end)  # a row that soon fits nowhere goes where all is free
            base[s] = at - least
            for g in gaps:
                taken[at + g] = 1
            end = max(end, at + max(gaps) + 1)
        self.base = np.array(base, np.int32)
        self.owner = np.full(max(base) + letters, -1, np.int32)
        self.to = np.zeros(len(self.owner), np.int32)
        for s, own in enumerate(step):
            for c, t in own.items():
                self.owner[base[s] + c], self.to[base[s] + c] = s, t
        self.root = np.zeros(letters, np.int32)  # a letter that the language lacks is a phrase of its own
        for c, t in step[0].items():
            self.root[c] = t

    def advance(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind letters ``c``, and whether a phrase begins with each of them."""
        at = self.base[state] + c
        goes = self.owner[at] == state
        return np.where(goes, self.to[at], self.root[c]), ~goes | (state == 0)

    def phrases(self, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Where in ``codes`` phrases begin, as a mask; segments codes[start:start+len], lens descending.

        ``follows``: the segment that a segment continues, -1 where a document begins.
        """
        begins = np.zeros(len(codes), bool)
        states = np.zeros(len(codes), np.int32)
        state, live, at = np.zeros(len(starts), np.int32), len(lens), 0
        while live := int(np.searchsorted(-lens[:live], -at, "left")):
            here = starts[:live] + at
            state[:live], begins[here] = self.advance(state[:live], codes[here])
            states[here] = state[:live]
            at += 1
        # a segment that was parsed from the empty match is parsed again from where the one before it ends
        redo = np.flatnonzero(follows >= 0)
        while len(redo):
            now, rows, at = states[starts[follows[redo]] + lens[follows[redo]] - 1], redo, 0
            changed = []
            while len(rows):
                here = starts[rows] + at
                now, new = self.advance(now, codes[here])
                begins[here] = new
                same = now == states[here]
                states[here] = now
                at += 1
                over = ~same & (lens[rows] == at)  # the segment now ends in another state
                changed.append(rows[over])
                on = ~same & ~over
                now, rows = now[on], rows[on]
            changed = np.concatenate(changed)
            redo = np.flatnonzero(np.isin(follows, changed)) if len(changed) else changed
        return begins


class Model:
    """Automata of all languages, some 2 MB for each, as the sample is bounded."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        clean = [normal(texts[n]) for n in self.names]
        self.letters = Letters(clean)
        coded = (self.letters.encode(np.frombuffer(t.encode("utf-32-le"), np.uint32)).tolist() for t in clean)
        self.automata = [Automaton(suffix_automaton(c), self.letters.size) for c in coded]

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language (languages x texts), and whether a text has letters."""
        data, offsets = tx.column(column)
        docs = len(offsets) - 1
        n = int(offsets[-1])
        lead = (data[:n] & 0xC0) != 0x80  # a character begins
        points = np.frombuffer(data[:n].tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.concatenate(([0], np.cumsum(lead)))[offsets]
        codes = self.letters.encode(points)
        doc = np.repeat(np.arange(docs), np.diff(first))
        # runs of breaks become one, and none stands at the start
        keep = codes > 0
        keep[1:] |= (codes[1:] == 0) & (codes[:-1] > 0) & (doc[1:] == doc[:-1])
        codes, doc = codes[keep], doc[keep]
        size = np.bincount(doc, minlength=docs)
        total = np.concatenate(([0], np.cumsum(size)))
        parts = -(-size // SEGMENT)
        owner = np.repeat(np.arange(docs), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = total[owner] + number * SEGMENT
        lens = np.minimum(SEGMENT, total[owner + 1] - starts)
        order = np.argsort(-lens, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        follows = np.where(number > 0, np.concatenate(([-1], place[:-1]))[: len(order)], -1)[order]
        counts = np.zeros((len(self.names), docs))
        for k, automaton in enumerate(self.automata):
            counts[k] = np.bincount(doc[automaton.phrases(codes, starts[order], lens[order], follows)], minlength=docs)
        return counts, np.bincount(doc, weights=codes > 0, minlength=docs) > 0

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the winner (-1: no letters or no languages), score, and whether there are letters, of each text."""
        counts, letters = self.counts(column)
        docs = len(letters)
        if not len(self.names):
            return np.full(docs, -1), np.zeros(docs), letters
        ranked = np.sort(counts, axis=0)
        best, second = ranked[0], ranked[1] if len(ranked) > 1 else 2 * ranked[0]
        score = np.where(letters, second / np.maximum(best + second, 1), 0.0)
        return np.where(letters, counts.argmin(0), -1), score, letters


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs`` (doc_id, text); neither a label nor a source is read.

    Score: the second language's share of the two best languages' phrases, 0.5 (a tie) to 1. A tie
    goes to the first name by code point. Null text or text without letters, or a model without
    languages: ``und`` with score 0. Very long texts are parsed whole. Null and
    repeated doc_ids: a row each. Other columns are left out; an empty table gives none.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.names, UNKNOWN], object)
        for batch in tx.slices(batches, "text"):
            best, score, _ = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, label: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a language, with all columns and the predicted language as their ``label``.

    Null texts and those without letters have none and go. Where the model knows no language, rows
    with letters stay as they are. A table without a column ``label`` only loses rows. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.names, None], object)
        for batch in tx.slices(batches, "text"):
            best, _, letters = shared.value.predict(batch.column("text"))
            if len(names) > 1 and label in batch.schema.names:
                batch = batch.set_column(batch.schema.names.index(label), label, pa.array(names[best], pa.string()))
            yield batch.filter(pa.array(letters))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, chars: int = CHARS, docs_each: int = DOCS) -> Model:
    """Fit on the bounded sample of the rows of ``docs`` (doc_id, text, lang) that aren't held out."""
    return Model(sample(docs.where(~held_out() & F.col("doc_id").isNotNull()), "lang", chars, docs_each))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).withColumn("held_out", held_out())


QUERIES = {"op3_langid": query}
ORACLE: dict[str, str] = {}
