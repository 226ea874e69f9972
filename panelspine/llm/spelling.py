"""Spelling variants: words one edit apart, found by pivotal grams.

All bigrams have one order, rare ones first. A word's prefix is its first three
bigrams in that order (Q * EDITS + 1) and some repeats of the last one; its
pivots are two disjoint ones of the three, the rarest pair, chosen by dynamic
programming. One edit harms one pivot at most, so of two words one edit
apart either one's pivots meet the other's prefix: of the two prefixes, the one
that reaches further in the order holds all earlier bigrams of its word.

An edit is on one side of a shared bigram, so the text on the other side is the
same: it is at the same distance from the word's begin or its end. This limit
of its place is part of the join key. Pairs are verified in the join, by the
sets of their letters and then by a banded edit distance, so that it gives
pairs of near words alone.

Joins are merge joins by hint: Spark sizes the index by the file that the words
come from, a small part of its rows, and the other tables by compressed files,
and would broadcast them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices
from .words import coded, mix

Q, EDITS = 2, 1
#: Bigrams are told apart by so many hash values: bounds the table of their frequencies.
GRAMS = 1 << 16
#: Maximal runs of at least so many letters.
RUN = "[a-zÀ-ÿ]{%d,}"


def spelled(ids: list[str], texts: list[str], least: int) -> Counter:
    """Words of at least that many code points, with counts over all texts. Where
    97 divides the crc32 of id, colon and word, one code point is left out."""
    run = re.compile(RUN % least)
    codes, names, bounds = coded([run.findall(t.encode().lower().decode()) for t in texts])  # bytes: A-Z alone are lower-cased
    pairs, n = np.unique(np.repeat(np.arange(len(texts)), np.diff(bounds)) * max(1, len(names)) + codes, return_counts=True)
    doc, code = np.divmod(pairs, max(1, len(names)))
    raw, starts, crc = [w.encode() for w in names], [zlib.crc32(f"{i}:".encode()) for i in ids], zlib.crc32
    h = np.fromiter((crc(raw[c], starts[d]) for d, c in zip(doc.tolist(), code.tolist(), strict=True)), np.int64, len(pairs))
    hit = h % 97 == 0
    whole = np.bincount(code[~hit], n[~hit], minlength=len(names)).astype(np.int64)
    out = Counter({names[c]: int(whole[c]) for c in np.flatnonzero(whole).tolist()})
    for c, x, k in zip(code[hit].tolist(), h[hit].tolist(), n[hit].tolist(), strict=True):
        word, at = names[c], x % len(names[c])
        if len(word) > least:
            out[word[:at] + word[at + 1 :]] += k
    return out


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """word and n, its occurrences in all of docs. A null text has no words, a
    null id counts as empty; repeated rows each count; no rows: no rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_slices(texts, 4_000_000):
                out = spelled(ids[a:b], texts[a:b], least_chars)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["word", "n"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(text(id_col).alias("doc_id"), text(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of all words in order, as codes below GRAMS, and each word's
    bounds. Equal bigrams have equal codes; others may share one."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(points), bool)
    inner[last[sizes > 0]] = False
    at = np.flatnonzero(inner)
    codes = mix((points[at] << np.uint64(32)) | points[at + 1]) if len(at) else np.zeros(0, np.uint64)
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.maximum(sizes - (Q - 1), 0), out=bounds[1:])
    return (codes % np.uint64(GRAMS)).astype(np.int64), bounds


def prefix_of(codes: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of a word's bigrams in the order of (frequency, code, place), and how
    many of them, Q * EDITS + 1 if there are as many, pivots are chosen from.

    Behind those follow repeats of the last one. Pivots are among the first
    Q * EDITS + 1 equal ones of their word, and an edit makes at most Q more, so
    a shared bigram is among the first 2 * Q * EDITS + 1 equal ones here."""
    order = np.lexsort((np.arange(len(codes)), codes, frequency[codes]))
    few = min(Q * EDITS + 1, len(order))
    if not few:
        return order, 0
    equal = codes[order] == codes[order[few - 1]]
    return order[(np.arange(len(order)) < few) | (equal & (np.cumsum(equal) <= 2 * Q * EDITS + 1))], few


def pivots_of(places: np.ndarray, weights: np.ndarray, count: int = EDITS + 1) -> list[int]:
    """count places at least Q apart with the least sum of weights: best[j][i] is
    the best choice of j places of which i is the last. Fewer if there are none."""
    order = np.argsort(places, kind="stable")
    p, w = places[order].tolist(), weights[order].tolist()
    best: list[dict[int, tuple[float, list[int]]]] = [{i: (w[i], [p[i]]) for i in range(len(p))}]
    for _ in range(count - 1):
        best.append({})
        for i in range(len(p)):
            earlier = [best[-2][j] for j in best[-2] if p[j] + Q <= p[i]]
            if earlier:
                cost, chosen = min(earlier)
                best[-1][i] = (cost + w[i], [*chosen, p[i]])
        if not best[-1]:
            return sorted(p)
    return min(best[-1].values())[1]


def _frequencies(words: DataFrame) -> np.ndarray:
    """How many bigrams of the words have each code: at most GRAMS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for batch in batches:
            total += np.bincount(gram_codes(batch.column(0).to_pylist())[0], minlength=GRAMS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(GRAMS, np.int64)
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


def _indexed(words: DataFrame, frequency: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(pivots, prefixes): word, n, letters and key, a hash of a bigram, the text
    on one side of it and the length of the other word. A pivot has one row for
    each side and each length that a near word can have."""
    shared = words.sparkSession.sparkContext.broadcast(frequency)

    def index(want_pivots: bool):
        #: Fixed values of one edit: how much longer the other word can be.
        longer = np.array([-1, 0, 1] if want_pivots else [0])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = shared.value
            for batch in batches:
                names = batch.column(0).to_pylist()
                for a, b in text_slices(names, 200_000):
                    codes, bounds = gram_codes(names[a:b])
                    at, gram, side, letters = [], [], [], []
                    for i, name in enumerate(names[a:b]):
                        own = codes[bounds[i] : bounds[i + 1]]
                        spots, few = prefix_of(own, weights)
                        for s in pivots_of(spots[:few], weights[own[spots[:few]]]) if want_pivots else spots.tolist():
                            at += (a + i, a + i)
                            gram += (own[s], own[s])
                            side += (zlib.crc32(name[:s].encode()), zlib.crc32(name[s + Q :].encode(), 1) | 1 << 32)
                        letters.append(sum({1 << (ord(x) & 63) for x in name}))
                    chars = np.array([len(x) for x in names[a:b]], np.int64)[np.array(at, np.int64) - a]
                    key = mix(mix(np.array(side, np.uint64)) + np.array(gram, np.uint64))
                    key = mix(key[:, None] ^ (chars[:, None] + longer).astype(np.uint64)).reshape(-1)
                    take = pa.array(np.repeat(np.array(at, np.int64), len(longer)))
                    mask = np.array(letters, np.uint64)[np.array(at, np.int64) - a].repeat(len(longer))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(mask.view(np.int64)), pa.array(key.view(np.int64))], ["word", "n", "letters", "key"])

        return words.select("word", "n").mapInArrow(rows, "word string, n long, letters long, key long")

    return index(True), index(False)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: each pair of words one edit apart once, a < b. words: word, n."""
    pivots, prefixes = _indexed(words, _frequencies(words))
    x, y = pivots.alias("x"), prefixes.alias("y")
    few = F.bit_count(F.col("x.letters").bitwiseXOR(F.col("y.letters"))) <= 2 * EDITS  # letters that one word has alone
    near = F.levenshtein(F.col("x.word"), F.col("y.word"), EDITS) == EDITS
    found = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & few & (F.col("x.word") != F.col("y.word")) & near)
    one, other = F.struct("x.word", "x.n"), F.struct("y.word", "y.n")
    return found.select(F.least(one, other).alias("l"), F.greatest(one, other).alias("g")).select(F.col("l.word").alias("a"), F.col("l.n").alias("na"), F.col("g.word").alias("b"), F.col("g.n").alias("nb")).distinct()


def _roots(links: DataFrame) -> DataFrame:
    """word, root of (word, form): forms are followed by doubling steps. Counts
    at least double along a chain, so that it is short and has no cycle."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(step.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants_of(words: DataFrame, *, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of words (word, n).

    The form is the near word of largest n, ties to the smallest, if that n is
    at least times (over 1) the word's own; else null. Words must be distinct and
    of five code points at least. A word without near words is its own root; a
    word of any length is compared whole; no rows: no rows.
    """
    if times <= 1:
        raise ValueError("times must be over 1, or forms could go round in circles")
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("top"))
    out = words.join(best.hint("merge"), "word", "left").withColumn("far", -F.col("top.less") >= times * F.col("n"))
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("far"), F.col("top.other")).alias("form"), F.when(F.col("far"), -F.col("top.less")).alias("form_n"))
    out = stored(out, "forms")
    roots = _roots(out.where("form is not null"))
    return out.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants_of the vocabulary of docs. Nulls, repeated and absent rows as in
    vocabulary; other columns are not looked at."""
    return variants_of(stored(vocabulary(docs, id_col=id_col, text_col=text_col), "vocabulary"))
