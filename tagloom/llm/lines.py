"""Near-duplicate lines by a segment-partition edit join, with DataFrame operations only.

Lines of NEAR characters or more are compared by edit distance, in words where both have WORDS words or more, else in characters:

* words: at most one word in ``share`` of the shorter line is inserted, deleted or replaced, ``most`` words at most;
* characters: at most ``tau`` are.

With a threshold of t a line is cut into t + 1 segments of nearly equal length; by the pigeonhole
principle an alike line holds one of them unchanged, near its place. So a line writes its segments
as index keys (segment number, line length, text) and, for each length of t less at most, the
runs that can be a segment of a line of that length, chosen by the shifts that t allows
(Li et al., "Pass-Join", 2011). Lines that meet at a key are compared by a banded bit-parallel edit
distance: the band of 2 t + 1 diagonals is one machine word for each unit (Hyyrö, 2003).

Equal lines are one node, found by a hash. At a key every line is first compared with one line of
the index, the most frequent one where that is known; only where a key's lines are then still in
several components are others compared, across components, and only those that share a rare token
of the key: alike lines differ in t words (3 t runs of three characters) at most, so of the t + 1
tokens of each that are rarest among the key's lines one is common to both. So variants of one line
cost a few comparisons each, and lines that share a template but little else none.

The classes are the connected components. Of each the first line, by doc_id and place, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm._graph import components
from tagloom.llm._work import remove, stored, table

#: Lines of fewer characters are left alone: only empty ones.
LEAST = 1
#: Lines of fewer characters go only where they repeat exactly: an edit or two makes another word of a short one.
NEAR = 20
#: Lines of so many words are compared by words.
WORDS = 10
#: A line that makes up more than 1 / HOT of all lines is reduced to its first place before keys are written.
HOT = 100_000
#: Characters of a token of lines that are compared by characters.
GRAM = 3


def _let(s: Column, f) -> Column:
    """f(s), with s computed once: an expression that is used twice would be computed twice."""
    return F.get(F.transform(F.array(s), f), F.lit(0))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later expressions read instead of computing it anew."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _div(a: Column, b: Column | int) -> Column:
    return ((a - a % b) / b).cast("int")


def segment_keys(lines: DataFrame, share: int, most: int, tau: int) -> DataFrame:
    """id, key and own of ``lines`` (id, line): keys under which a line looks for lines of its length and up to the threshold less; ``own``: also those under which it is found.

    The lowest bit of a key says whether it is one of words. A line of WORDS words or a little more may
    be compared with one of fewer, so it writes keys of both kinds.
    """
    words = _once(lines, "words", F.split("line", " "))
    n, chars = F.size("words"), F.split("line", "")
    unit = lambda worded, u: F.struct(F.lit(worded).alias("worded"), u.alias("u"))
    both = F.when(n >= WORDS + tau, F.array(unit(1, F.col("words")))).when(n >= WORDS, F.array(unit(1, F.col("words")), unit(0, chars))).otherwise(F.array(unit(0, chars)))
    units = words.select("id", F.explode(both).alias("x")).select("id", "x.worded", "x.u", F.size("x.u").alias("n"))
    units = units.where((F.col("worded") == 1) | (F.col("n") >= NEAR))
    limit = lambda m: F.when(F.col("worded") == 1, F.least(F.lit(most), _div(m, share))).otherwise(tau)
    at = units.select("*", F.explode(F.sequence(F.lit(0), limit(F.col("n")))).alias("less"))
    at = at.withColumn("m", F.col("n") - F.col("less")).withColumn("t", limit(F.col("m")))
    at = at.where((F.col("less") <= F.col("t")) & (F.col("m") >= F.when(F.col("worded") == 1, WORDS).otherwise(NEAR)))
    at = at.withColumn("base", _div(F.col("m"), F.col("t") + 1)).withColumn("longer", F.col("m") % (F.col("t") + 1))
    at = at.select("*", F.explode(F.sequence(F.lit(0), F.col("t"))).alias("i"))
    t, less, base, longer, i = (F.col(c) for c in ("t", "less", "base", "longer", "i"))
    # the last ``longer`` segments have one unit more
    at = at.withColumn("start", base * i + F.greatest(F.lit(0), longer - (t + 1 - i))).withColumn("size", base + F.when(t + 1 - i <= longer, 1).otherwise(0))
    # lines of one length look for each other: with one insertion and one deletion, in one of the two directions the insertion comes first
    lowest = F.when((less == 0) & (t <= 3), F.lit(0)).otherwise(F.greatest(-i, less - (t - i)))
    at = at.select("*", F.explode(F.sequence(lowest, F.least(i, less + t - i))).alias("off"))
    key = F.xxhash64("worded", "i", "m", F.slice("u", F.col("start") + F.col("off") + 1, F.col("size")))
    key = F.shiftleft(key, 1).bitwiseOR(F.col("worded").cast("long"))
    return at.select("id", key.alias("key"), ((less == 0) & (F.col("off") == 0)).alias("own"))


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of the arrays of characters a and b where it is at most tau, else more than tau.

    Bit k of the words at character j of b stands for row j - tau + k of the distance matrix. The
    distance is followed down the lowest diagonal of the band to the last row, then along that row.
    """
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda s: _banded(s["a"], s["b"], F.size(s["a"]), F.size(s["b"]), tau, _let))


def _banded(a: Column, b: Column, m: Column, n: Column, tau: int, let) -> Column:
    band = (1 << (2 * tau + 1)) - 1

    def step(acc: Column, j: Column) -> Column:
        here = F.get(b, j - 1)
        x = sum((F.when(F.get(a, j - tau - 1 + k) == here, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(2 * tau + 1)), F.lit(0))
        return F.struct(acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d"), x.alias("x"), j.alias("j"))

    def zero(s: Column) -> Column:
        vp, vn, x = s["vp"], s["vn"], s["x"]
        d0 = (((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(F.lit(band))
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"), s["j"].alias("j"), d0.alias("d0"))

    def across(s: Column) -> Column:
        hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"])).bitwiseAND(F.lit(band)))
        hn = s["d0"].bitwiseAND(s["vp"])
        return F.struct(s["d"].alias("d"), s["j"].alias("j"), s["d0"].alias("d0"), hp.alias("hp"), hn.alias("hn"))

    def down(s: Column) -> Column:
        low = F.shiftright(s["d0"], 1)
        vp = s["hn"].bitwiseOR(F.bitwise_not(low.bitwiseOR(s["hp"])).bitwiseAND(F.lit(band)))
        row = m - s["j"] + tau  # bit of the last row, beyond the band's lowest while the diagonal goes on
        bit = lambda w: w.bitwiseAND(F.pow(F.lit(2), F.greatest(row, F.lit(0))).cast("int")) != 0
        d = F.when(row >= 2 * tau, s["d"] + F.when(s["d0"].bitwiseAND(F.lit(1 << 2 * tau)) == 0, 1).otherwise(0)).otherwise(s["d"] + F.when(bit(s["hp"]), 1).otherwise(0) - F.when(bit(s["hn"]), 1).otherwise(0))
        return F.struct(vp.alias("vp"), low.bitwiseAND(s["hp"]).alias("vn"), d.alias("d"))

    begin = F.struct(F.lit(band & ~((1 << tau) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("d"))
    last = F.aggregate(F.sequence(F.lit(1), n), begin, lambda acc, j: let(let(let(step(acc, j), zero), across), down))
    return F.when(F.abs(m - n) > tau, F.lit(tau + 1)).when((n == 0) | (m < tau), F.greatest(m, n) + tau).otherwise(last["d"])


def pieces_agree(a: Column, b: Column, tau: int) -> Column:
    """Whether enough pieces of a stand in b near their places for an edit distance of tau.

    Of 3 tau pieces an edit touches one at most, and the others move by tau places at most. The text
    is compared here as it is, so most candidates go before characters are walked through.
    """
    parts = 3 * tau
    size = F.floor(F.char_length(a) / parts).cast("int")

    def stands(i: int) -> Column:
        piece, start = F.substring(a, size * i + 1, size), size * i + 1
        near = F.lit(False)
        for by in sorted(range(-tau, tau + 1), key=abs):
            near = near | (F.substring(b, start + by, size) == piece if i or by >= 0 else F.lit(False))
        return F.when(near, 1).otherwise(0)

    return sum((stands(i) for i in range(1, parts)), stands(0)) >= parts - tau


def _grams(line: Column) -> Column:
    return _let(line, lambda s: F.transform(F.sequence(F.lit(1), F.char_length(s) - (GRAM - 1)), lambda i: F.substring(s, i, F.lit(GRAM))))


def _parity(tokens: Column) -> Column:
    """struct<p, q>: for each of 128 parts of the hash range whether an odd number of the distinct ``tokens`` falls into it.

    Two sets differ in at least as many tokens as their parities do, whatever they have in common.
    """
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    fold = lambda hashes, part: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.when(h.bitwiseAND(F.lit(64)) == part, bit(h)).otherwise(F.lit(0).cast("long"))))
    return _let(F.transform(F.array_distinct(tokens), lambda x: F.xxhash64(x)), lambda hashes: F.struct(fold(hashes, 0).alias("p"), fold(hashes, 64).alias("q")))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a["p"].bitwiseXOR(b["p"])) + F.bit_count(a["q"].bitwiseXOR(b["q"]))


def _compared(pairs: DataFrame, texts: DataFrame, share: int, most: int, tau: int) -> DataFrame:
    """(u, v): the alike ones of the pairs (a, b) of ids."""
    one, two = (texts.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("line", "words", "by_word", "by_gram"))) for c in "ab")
    worded = (F.col("words_a") >= WORDS) & (F.col("words_b") >= WORDS)
    t = F.least(F.lit(most), _div(F.least("words_a", "words_b"), share))
    # each word that the other line lacks takes an edit, and so do three runs of characters
    can = F.when(worded, (F.abs(F.col("words_a") - F.col("words_b")) <= t) & (_apart(F.col("by_word_a"), F.col("by_word_b")) <= 2 * t)).otherwise(_apart(F.col("by_gram_a"), F.col("by_gram_b")) <= 2 * GRAM * tau)
    both = pairs.join(one, "a").join(two.withColumnRenamed("b", "b_"), (F.col("b") == F.col("b_")) & can).select("a", "b", "line_a", "line_b", worded.alias("worded"), t.alias("t"))
    # few bytes, but much work for each: dealt out evenly, whatever their size
    both = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    spoken = _once(both.where("worded"), "s", F.struct(F.split("line_a", " ").alias("x"), F.split("line_b", " ").alias("y")))
    x, y = F.col("s.x"), F.col("s.y")
    spoken = spoken.where((F.size(F.array_except(x, y)) <= F.col("t")) & (F.size(F.array_except(y, x)) <= F.col("t")))
    # replaced words alone are counted in place
    in_place = (F.size(x) == F.size(y)) & (F.size(F.filter(F.zip_with(x, y, lambda i, j: i == j), lambda same: ~same)) <= F.col("t"))
    spoken = spoken.where(F.when(in_place, F.lit(0)).otherwise(banded_distance(x, y, most)) <= F.col("t")).select("a", "b")
    spelt = both.where(~F.col("worded") & (F.abs(F.char_length("line_a") - F.char_length("line_b")) <= tau) & pieces_agree(F.col("line_a"), F.col("line_b"), tau))
    spelt = spelt.where(banded_distance(F.split("line_a", ""), F.split("line_b", ""), tau) <= tau).select("a", "b")
    return spoken.unionByName(spelt).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _across(met: DataFrame, roots: DataFrame, texts: DataFrame, share: int, most: int, tau: int) -> tuple[DataFrame | None, tuple[DataFrame, ...]]:
    """Pairs (a, b) of lines of a key that are in different components and share one of the tokens rarest in it, None where no key has such lines; the tables they are read from."""
    # all have been compared with the first line of the key, so others must differ among themselves
    w = W.partitionBy("key")
    rooted = met.where("id <> low").join(roots, met["id"] == roots["node"], "left").select("key", "id", "own", F.coalesce("root", "id").alias("root"))
    several = rooted.withColumn("one", F.min("root").over(w)).withColumn("other", F.max("root").over(w)).withColumn("found", F.max("own").over(w)).where("one < other and found").select("key", "id", "own", "root")
    several = stored(several, "lines-several")
    if several.isEmpty():
        return None, (several,)
    worded = F.col("key").bitwiseAND(F.lit(1)) == 1
    told = lambda df: df.join(texts, "id").withColumn("differ", F.when(worded, F.least(F.lit(most), _div(F.col("words"), share))).otherwise(GRAM * tau))
    lines = _once(told(several.select("key", "id")), "tokens", F.array_distinct(F.when(worded, F.split("line", " ")).otherwise(_grams(F.col("line")))))
    # all tokens of lines with few different ones: their rarest may all be other ones
    first = F.when(F.size("tokens") <= 2 * F.col("differ"), F.size("tokens")).otherwise(F.col("differ") + 1)
    lines = lines.select("key", "id", first.alias("first"), F.explode("tokens").alias("token")).withColumn("token", F.xxhash64("token"))
    ranked = lines.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key", "token")))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("key", "id").orderBy("n", "token"))).where("rank <= first and n > 1")
    # what else a line carries joins the few tokens that are left
    attributes = told(several).select("key", "id", "own", "root", "differ", F.when(worded, F.col("by_word")).otherwise(F.col("by_gram")).alias("parity"))
    ranked = stored(ranked.select("key", "token", "id").join(attributes, ["key", "id"]).select("key", "token", "id", "own", "root", "differ", "parity"), "lines-ranked")
    # the component of most lines isn't joined with itself
    counts = ranked.groupBy("key", "token", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("key", "token").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    placed = ranked.join(main, ["key", "token"])
    few = placed.where("root <> main").select("key", "token", F.col("id").alias("mate"), F.col("own").alias("mate_own"), F.col("root").alias("mate_root"), F.col("differ").alias("mate_differ"), F.col("parity").alias("mate_parity"))
    near = _apart(F.col("parity"), F.col("mate_parity")) <= 2 * F.least("differ", "mate_differ")
    cross = placed.join(few, ["key", "token"]).where((F.col("root") != F.col("mate_root")) & (F.col("own") | F.col("mate_own")) & near).select(*_pairs(F.col("id"), F.col("mate"))).distinct()
    return cross, (several, ranked)


def repeated_lines(docs: DataFrame, share: int = 10, most: int = 3, tau: int = 2, least: int = LEAST) -> DataFrame:
    """doc, text_hash and removed (array of line, first_doc, first_line) of the documents that lose lines.

    doc is the doc_id, null as it is; documents are told apart by doc_id and text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    lines = docs.select("doc", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.char_length("line") >= least)
    # null doc_ids come last: a place begins with whether there is none
    lines = lines.select(F.xxhash64("line").alias("h"), F.struct(F.col("doc").isNull().alias("nameless"), "doc", "text_hash", "pos").alias("at"), "line")
    every = stored(lines.select("h", "at"), "lines-places")
    counted = every.groupBy("h").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # ids order lines: the frequent ones come first, by their number's logarithm; each of the others has its hash
    often = F.floor(F.log2("n")).cast("int")
    firsts = stored(counted, "lines-first")
    total = firsts.agg(F.sum("n")).head()[0] or 0
    bound = max(8, total // HOT)
    plain = F.when(F.shiftright("h", 56) == -128, F.col("h").bitwiseXOR(F.lit(-(2**63)))).otherwise(F.col("h"))
    named = F.lit(-(2**63)).bitwiseOR(F.shiftleft((63 - often).cast("long"), 50)).bitwiseOR(F.col("h").bitwiseAND(F.lit(2**50 - 1)))
    firsts = firsts.withColumn("id", F.when(F.col("n") > bound, named).otherwise(plain))
    hot = firsts.where(F.col("n") > bound).select("h", "first", F.col("id").alias("hot_id"))  # at most HOT rows
    unique = lines.join(F.broadcast(hot), "h", "left").where(F.col("first").isNull() | (F.col("first") == F.col("at")))
    keys = segment_keys(unique.where(F.char_length("line") >= NEAR).select(F.coalesce("hot_id", plain).alias("id"), "line"), share, most, tau)

    w = W.partitionBy("key")
    met = keys.withColumn("low", F.min(F.when(F.col("own"), F.col("id"))).over(w)).withColumn("least", F.min("id").over(w)).withColumn("top", F.max("id").over(w))
    met = stored(met.where("low is not null and least < top").groupBy("key", "id", "low").agg(F.max("own").alias("own")), "lines-met")

    star = stored(met.where("id <> low").select(*_pairs(F.col("id"), F.col("low"))).distinct(), "lines-pairs")
    places = firsts.join(met.select("id").distinct(), "id", "left_semi").groupBy("first.doc", "first.text_hash").agg(F.collect_list(F.struct("id", "first.pos")).alias("places"))
    # a document's lines are told apart once, whatever their number
    found = _let(F.split("text", "\n", -1), lambda x: F.transform("places", lambda p: F.struct(p["id"].alias("id"), F.get(x, p["pos"]).alias("line"))))
    places = places.withColumnRenamed("doc", "doc_").withColumnRenamed("text_hash", "hash_")
    texts = docs.join(places, docs["doc"].eqNullSafe(places["doc_"]) & (docs["text_hash"] == places["hash_"])).select(F.explode(found).alias("p")).select("p.id", "p.line").dropDuplicates(["id"])
    texts = texts.select("id", "line", F.size(F.split("line", " ")).alias("words"), _parity(F.split("line", " ")).alias("by_word"))
    texts = stored(texts.withColumn("by_gram", F.when(F.col("words") < WORDS + tau, _parity(_grams(F.col("line"))))), "lines-texts")
    links = stored(_compared(star, texts, share, most, tau), "lines-links")
    roots = stored(components(links), "lines-roots")
    cross, spent = _across(met, roots, texts, share, most, tau)
    more = None if cross is None else stored(_compared(cross.join(star, ["a", "b"], "left_anti"), texts, share, most, tau), "lines-more")
    remove(spark, met, star, texts, links, *spent)
    if more is not None and not more.isEmpty():
        roots = stored(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "lines-roots")

    grouped = firsts.join(roots, F.col("id") == F.col("node"), "left").where("n > 1 or root is not null").select("h", "first", F.coalesce("root", "id").alias("root"))
    keep = grouped.groupBy("root").agg(F.min("first").alias("keep"))
    keep = stored(grouped.join(keep, "root").select("h", "keep"), "lines-keep")
    gone = every.join(keep, "h").where("at <> keep")
    return gone.groupBy("at.doc", "at.text_hash").agg(F.array_sort(F.collect_list(F.struct(F.col("at.pos").alias("line"), F.col("keep.doc").alias("first_doc"), F.col("keep.pos").alias("first_line")))).alias("removed"))


def dedup_lines(docs: DataFrame, share: int = 10, most: int = 3, tau: int = 2, least: int = LEAST) -> DataFrame:
    """``row`` (the document as a struct), n_lines, removed and text without them, of each row of ``docs`` (doc_id, text).

    Lines are what stands between newlines. A line of ``least`` characters or more goes if a line
    before it, by doc_id (null last), text hash and place, is in its class; shorter lines always stay.
    The class of a line under NEAR characters holds its exact repeats only. A document all of whose lines go stays with an empty text. Rows of
    equal doc_id and text count as one document and are treated alike. Null text stays null, with 0
    lines. An empty table gives none. Other columns stay in ``row`` untouched, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    gone = repeated_lines(docs, share, most, tau, least).withColumnRenamed("doc", "doc_").withColumnRenamed("text_hash", "hash_")
    keyed = docs.select(row.alias("row")).withColumn("doc", F.col("row.doc_id").cast("long")).withColumn("text_hash", F.xxhash64("row.text"))
    # a table of what goes in each partition, so that whole texts aren't sorted
    joined = keyed.join(gone.hint("shuffle_hash"), keyed["doc"].eqNullSafe(gone["doc_"]) & (keyed["text_hash"] == gone["hash_"]), "left")
    count = F.when(F.col("row.text").isNotNull(), F.octet_length("row.text") - F.octet_length(F.replace(F.col("row.text"), F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    kept = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.transform("removed", lambda r: r["line"])), lambda i: F.get(x, i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(_let(F.split("row.text", "\n", -1), kept))
    return joined.select("row", count.cast("long").alias("n_lines"), F.coalesce("removed", F.expr("cast(array() as array<struct<line:int,first_doc:bigint,first_line:int>>)")).alias("removed"), text.alias("text"))


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with their columns; text without repeated lines, n_chars (if there is such a column) its length."""
    done = dedup_lines(docs, **how)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


QUERIES = {"op4_line_dedup": query}
ORACLE: dict[str, str] = {}
