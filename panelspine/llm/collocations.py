"""Collocations by Toivonen's method, scored by their weakest cut.

A sample of the documents proposes frequent phrases. A full pass then counts
them exactly, by their texts, together with the negative border: every phrase
that occurs and is not proposed although all shorter ones in it are, counted by
a hash (never less than the true count). If a border phrase is frequent,
an expansion pass counts, by their texts, all phrases that no infrequent phrase
rules out and that were not counted before; after it nothing is left open. So
the phrases found are exactly the frequent ones, whatever the sample.

What is proposed reaches the tasks as a table of bits of bounded size. A false
bit, or two phrases of one hash, only has a phrase counted that need not be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_slices
from .words import GOLDEN, coded, hashes, mix

LONGEST = 5
BREAK, END = "\n", "\x0b"
#: Bytes: A-Z to lower case, the characters that end a piece to BREAK, tab to space.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
SCHEMA = "h long, lang string, phrase string, n long"
#: Rows to the shuffle: a phrase with its text, or a block of border phrases of one part of the hashes.
SENT = "part long, h long, lang string, phrase string, n long, keys binary, counts binary"
#: So many characters of the input count as one part of the hashes.
PART_CHARS = 16_000_000


class Pieces:
    """The words of some texts: exact codes of (word, language), and of each
    position how many words of its piece begin there or later."""

    def __init__(self, texts: list[str], langs: list[str]):
        joined = f" {END} ".join(t.encode().translate(BYTES).decode() for t in texts)
        codes, names, _ = coded([joined.replace(BREAK, f" {BREAK} ").split(" ")])
        code_of = {x: int(k) for x in ("", BREAK, END) for k in np.flatnonzero(names == x)}
        end = codes == code_of.get(END, -1)
        ends_piece = end | (codes == code_of.get(BREAK, -1))
        is_word = ~(ends_piece | (codes == code_of.get("", -1)))
        doc, piece = np.cumsum(end)[is_word], np.cumsum(ends_piece)[is_word]
        lang_codes, self.langs = pd.factorize(np.array(langs, object))
        pair, kinds = pd.factorize(codes[is_word] * len(self.langs) + lang_codes[doc])
        self.ids, self.words, self.lang_of = pair.astype(np.int64), names[kinds // len(self.langs)], kinds % len(self.langs)
        n = len(self.ids)
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if n else np.zeros(0, np.int64)
        self.left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)
        by_lang = mix(hashes(np.asarray(self.langs, object)))
        self.word_hash = mix(hashes(self.words) ^ by_lang[self.lang_of])[self.ids] if n else np.zeros(0, np.uint64)

    def hashed(self) -> Iterator[tuple[int, np.ndarray]]:
        """k and the hash of the k words from each position, for k = 1 .. LONGEST."""
        rolled = self.word_hash
        for k in range(1, LONGEST + 1):
            if k > 1:
                rolled = rolled * GOLDEN
                rolled[: len(rolled) - k + 1] += self.word_hash[k - 1 :]
            yield k, mix(rolled + np.uint64(k))

    def both(self, k: int, shorter: np.ndarray) -> np.ndarray:
        """Where k words are in one piece and both phrases of one word less are marked."""
        return (self.left >= k) & shorter & np.append(shorter[1:], False)[: len(shorter)]

    def totals(self) -> Iterator[tuple[tuple[int, str, str], int]]:
        """The number of words of each language, as counts of the empty phrase."""
        n = np.bincount(self.lang_of[self.ids], minlength=len(self.langs))
        return (((0, lang, ""), int(k)) for lang, k in zip(self.langs, n, strict=True))

    def counted(self, k: int, at: np.ndarray, hash_k: np.ndarray) -> Iterator[tuple[tuple[int, str, str], int]]:
        """(hash, language, phrase) and exact count of the phrases of k words that
        begin at the positions."""
        group = self.ids[at]
        for j in range(1, k):
            group = pd.factorize(group * len(self.words) + self.ids[at + j])[0]
        group, _ = pd.factorize(group)
        first = np.zeros(group.max() + 1 if len(group) else 0, np.int64)
        first[group[::-1]] = at[::-1]
        phrases = [self.words[self.ids[first + j]] for j in range(k)]
        text = [" ".join(x) for x in zip(*phrases, strict=True)]
        lang = self.langs[self.lang_of[self.ids[first]]]
        keys = zip(hash_k[first].view(np.int64).tolist(), lang, text, strict=True)
        return zip(keys, np.bincount(group, minlength=len(first)).tolist(), strict=True)


class Texts:
    """Counts of phrases by their texts."""

    def __init__(self, most: int = 1_000_000):
        self.n: dict[tuple[int, str, str], int] = {}
        self.most = most

    def add(self, counts) -> bool:
        """True if so many phrases are held that it is time to take()."""
        n = self.n
        for key, k in counts:
            n[key] = n.get(key, 0) + k
        return len(n) > self.most

    def take(self) -> tuple[list, list, list, list]:
        """h, language, phrase and count of all phrases held."""
        h, lang, phrase = map(list, zip(*self.n, strict=True)) if self.n else ([], [], [])
        counts, self.n = list(self.n.values()), {}
        return h, lang, phrase, counts


class Tally:
    """Counts of hashes, summed whenever many are held."""

    def __init__(self, most: int = 1_000_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, most

    def add(self, h: np.ndarray, n: np.ndarray | None = None) -> bool:
        """True if, even summed, more than most are held: time to take()."""
        if n is None:
            h, n = np.unique(h, return_counts=True)
        self.parts.append((h, n))
        self.held += len(h)
        if self.held > 2 * self.most:
            self._sum()
        return self.held > self.most

    def _sum(self) -> None:
        h, back = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([p[1] for p in self.parts])).astype(np.int64)
        self.parts, self.held = [(h, n)], len(h)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending hashes and their counts."""
        if self.parts:
            self._sum()
        h, n = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.held = [], 0
        return h, n


def _blocks(tally: Tally, bits: int) -> pa.RecordBatch:
    """What a tally holds, one row per part: the part is the first bits of the
    hashes, keys are the next 32."""
    h, n = tally.take()
    part = (h >> np.uint64(64 - bits)).astype(np.int64)
    keys = ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
    last = np.append(first[1:], len(part))[: len(first)]
    counts = np.minimum(n, 0xFFFFFFFF).astype("<u4")
    none = pa.nulls(len(first), pa.string())
    blobs = [pa.array([x[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary()) for x in (keys, counts)]
    return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.nulls(len(first), pa.int64()), none, none, pa.nulls(len(first), pa.int64()), *blobs], SENT_NAMES)


SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]


def _lines(exact: Texts, bits: int) -> pa.RecordBatch:
    h, lang, phrase, n = exact.take()
    part = (np.array(h, np.int64).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    none = pa.nulls(len(h), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(part), pa.array(h, pa.int64()), pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64()), none, none], SENT_NAMES)


def _merged(bits: int, least: int):
    """Sums rows of SENT, ordered by part, one part after the other; border
    phrases are given from least on."""

    def result(exact: Texts, tally: Tally, part: int) -> Iterator[pa.RecordBatch]:
        h, lang, phrase, n = exact.take()
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())], ["h", "lang", "phrase", "n"])
        keys, n = tally.take()
        keys, n = keys[n >= least], n[n >= least]
        h = (np.uint64(part) << np.uint64(64 - bits)) | (keys << np.uint64(32 - bits))
        none = pa.nulls(len(h), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), none, none, pa.array(n)], ["h", "lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, exact, tally = None, Texts(), Tally()
        for batch in batches:
            for part, h, lang, phrase, n, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part != now:
                    if now is not None:
                        yield from result(exact, tally, now)
                    now = part
                if keys is None:
                    exact.add([((h, lang, phrase), n)])
                else:
                    tally.add(np.frombuffer(keys, "<u4").astype(np.uint64), np.frombuffer(counts, "<u4").astype(np.int64))
        if now is not None:
            yield from result(exact, tally, now)

    return run


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set in the table."""
    at = h >> np.uint64(64 - int(math.log2(len(bits) * 64)))
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


# What a pass emits from each slice: (k, positions, hashes, whether by text).


def _short(p: Pieces, first, second):
    """All phrases of one and two words, by hash."""
    for k, h in p.hashed():
        if k > 2:
            return
        yield k, np.flatnonzero(p.left >= k), h, False


def _long(p: Pieces, first, second):
    """Phrases of three and more words all of whose word pairs are in first, by hash."""
    for k, h in p.hashed():
        if k == 1:
            open_ = _known(first.value, h)
        elif k == 2:
            open_ = p.both(2, open_) & _known(first.value, h)
        else:
            open_ = p.both(k, open_)
            yield k, np.flatnonzero(open_), h, False


def _proposed(p: Pieces, first, second):
    """Phrases in first by text, the negative border by hash."""
    old = None
    for k, h in p.hashed():
        tested = p.left >= 1 if old is None else p.both(k, old)
        old = tested & _known(first.value, h)
        yield k, np.flatnonzero(old), h, True
        yield k, np.flatnonzero(tested & ~old), h, False


def _expanded(p: Pieces, first, second):
    """By text: what was not in first, and was found frequent (second) or not
    counted at all, although no shorter phrase in it is known to be infrequent."""
    old = possible = None
    for k, h in p.hashed():
        tested = p.left >= 1 if old is None else p.both(k, old)
        alive = p.left >= 1 if possible is None else p.both(k, possible)
        old = tested & _known(first.value, h)
        possible = alive & (~tested | _known(second.value, h))
        yield k, np.flatnonzero(possible & ~old), h, True


def _pass(rows: DataFrame, emit, bits: int, least: int, first=None, second=None) -> DataFrame:
    """h, lang, phrase and n over rows (text, lang): sums of what emit gives, from
    least on. The pass that counts everything gives the totals of words too.

    Tasks sum what they see; 2 ** bits parts of the hashes are then summed one
    after the other, so that the more parts there are the less memory it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, exact = Tally(), Texts()
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_slices(texts, 1_000_000):
                pieces = Pieces(texts[a:b], langs[a:b])
                if emit is _proposed:
                    exact.add(pieces.totals())
                for k, at, h, by_text in emit(pieces, first, second):
                    if by_text and exact.add(pieces.counted(k, at, h)):
                        yield _lines(exact, bits)
                    elif not by_text and tally.add(h[at]):
                        yield _blocks(tally, bits)
        yield _blocks(tally, bits)
        yield _lines(exact, bits)

    sent = rows.mapInArrow(run, SENT).repartition("part").sortWithinPartitions("part")
    return sent.mapInArrow(_merged(bits, least), SCHEMA).where((F.col("n") >= least) | (F.col("phrase") == ""))


def _bits(found: DataFrame, least: int = 16, most: int = 30):
    """The hashes h of found as a broadcast table of 2 ** least to 2 ** most bits
    (128 MB), about 32 bits a hash between these bounds; beyond, false bits grow."""
    found = found.select("h").distinct()
    size = min(most, max(least, math.ceil(math.log2(32 * max(1, found.count())))))
    words = found.select(F.shiftrightunsigned("h", 70 - size).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - size}) & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(2 ** (size - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return found.sparkSession.sparkContext.broadcast(out)


def frequent_phrases(docs: DataFrame, *, least: int = 100, lang_col: str = "lang", text_col: str = "text", one_in: int = 16) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase and f of every phrase of 1 to LONGEST words
    within a piece that occurs at least that often in its language; and lang and
    n, its word occurrences.

    A null text is empty; a null language is 'und'; repeated rows each count;
    texts of any length are counted whole; no rows: no rows. About one document
    in one_in proposes: that decides on the work, not on the result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    sample = stored(rows.where(F.rand(7) < 1 / one_in), "phrase-sample")
    chars = (sample.agg(F.sum(F.length("text"))).first()[0] or 0) * one_in
    bits = max(4, min(24, math.ceil(math.log2(1 + chars / PART_CHARS))))
    enough = max(2, least // (2 * one_in))
    short = stored(_pass(sample, _short, bits, enough), "sample-short")
    long_ = stored(_pass(sample, _long, bits, enough, _bits(short)), "sample-long")
    first = _bits(short.union(long_))
    found = stored(_pass(rows, _proposed, bits, least, first), "phrases")
    exact = found.where("phrase != ''")
    if not found.where("phrase is null").isEmpty():
        more = _pass(rows, _expanded, bits, least, first, _bits(found))
        exact = exact.union(stored(more, "more-phrases"))
    return exact.select("lang", "phrase", F.col("n").alias("f")), found.where("phrase = ''").select("lang", "n")


def _part(start, length):
    return F.array_join(F.slice("words", start, length), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words and more
    that are in no longer one of the same count: floor(1000 a n / (l r)) of the
    cut (l left, r right) where it is least, ties to the first cut.

    phrases holds every part of each of its phrases, so all counts are in it.
    If a longer phrase has the count of one inside it, so has one longer by one
    word only, as counts cannot rise with length."""
    words = phrases.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words"))
    several = words.where("k > 1")
    inner = several.where("k > 2").select("lang", F.explode(F.array(_part(F.lit(1), F.col("k") - 1), _part(F.lit(2), F.col("k") - 1))).alias("phrase"), F.col("f").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = several.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f")))
    cuts = kept.select("lang", "phrase", "words", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    l, r = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    counts = cuts.join(l, ["lang", "left"]).join(r, ["lang", "right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    # the quotient is at most 1000 n / a; products of two counts have at most 38 digits
    counts = counts.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n")), "under": big("l") * big("r")})
    counts = counts.withColumn("score", F.expr("over div under"))
    best = counts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", *[F.col(f"best.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def top_phrases(rows: DataFrame, most: int, parts: int = 8) -> DataFrame:
    """The first rows of each language by falling score and a, then phrase, with
    their rank. Each part of a language is cut first: one task sees most * parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("part")


def collocations(docs: DataFrame, *, least: int = 100, most: int = 2000, lang_col: str = "lang", text_col: str = "text", one_in: int = 16) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first most collocations of each
    language. Nulls, empty and long texts, repeated and absent rows as in
    frequent_phrases; other columns are not looked at."""
    phrases, totals = frequent_phrases(docs, least=least, lang_col=lang_col, text_col=text_col, one_in=one_in)
    return top_phrases(scored(phrases, totals), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
