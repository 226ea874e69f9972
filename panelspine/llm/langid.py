"""Language of a text by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. A language is a probability
for each piece; a word's probability is the sum over all its segmentations in
pieces, by the forward algorithm; a text's is the product over its words. The
piece probabilities are learned by expectation maximisation with the forward
and backward sums of the training words. A character that no piece covers is a
piece of its own with a small probability.

Words are scored once per slice of texts: distinct words of one length form a
matrix of characters, and each step of the forward sum is a lookup of substring
hashes for all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_texts, is_held_out, stored, text_slices
from .words import GOLDEN, coded, mix

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
UNKNOWN = 1e-9
#: Longer words are scored in parts of this length.
LONGEST = 40


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts_of(words: list[str]) -> list[str]:
    """Words with the mark of a word's start, in parts of LONGEST characters at most."""
    out = []
    for w in words:
        w = START + w
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out += [w[k : k + LONGEST] for k in range(0, len(w), LONGEST)]
    return out


class Pieces:
    """The vocabulary as a hash table. pieces: strings of letters, START first or nowhere."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p})
        self.longest = max(map(len, self.pieces), default=1)
        keys = np.array([self.key_of(p) for p in self.pieces], np.uint64)
        size = 1 << (4 * max(2, len(keys)) - 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys, self.ids = np.zeros(size, np.uint64), np.full(size, len(keys), np.int64)
        self.probes = 1
        for i, k in enumerate(keys.tolist()):
            at, n = k & (size - 1), 1
            while self.ids[at] != len(keys):
                at, n = (at + 1) & (size - 1), n + 1
            self.keys[at], self.ids[at] = k, i
            self.probes = max(self.probes, n)

    @staticmethod
    def key_of(p: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in p:
            h = h * GOLDEN + np.uint64(ord(c))
        return int(mix(h)[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of rolling hashes; len(pieces) where there is none."""
        key = mix(h)
        at = key & self.mask
        out = np.where(self.keys[at] == key, self.ids[at], len(self.pieces))
        for _ in range(self.probes - 1):
            at = (at + np.uint64(1)) & self.mask
            out = np.where((out == len(self.pieces)) & (self.keys[at] == key), self.ids[at], out)
        return out


def matrix_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row per position."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).T.astype(np.uint64)


def spans(pieces: Pieces, chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, piece ids) of all substrings, by end."""
    n = len(chars)
    rolling: dict[int, np.ndarray] = {}
    for end in range(1, n + 1):
        c = chars[end - 1]
        for start in range(max(0, end - pieces.longest), end):
            rolling[start] = (rolling[start] if start in rolling else np.zeros_like(c)) * GOLDEN + c
            yield start, end, pieces.find(rolling[start])
        rolling.pop(end - pieces.longest, None)


def forward(pieces: Pieces, prob: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """log of the words' probabilities, (words, languages). prob: (pieces + 1,
    languages), the last row 0. Sums are scaled at each place by their largest
    language, and the scale is kept as a logarithm, so that long words that no
    piece covers still tell languages apart."""
    n, m = chars.shape
    alpha = np.zeros((n + 1, m, prob.shape[1]))
    alpha[0] = 1.0
    scale = np.zeros((n + 1, m))  # the true sum is alpha * exp(scale)
    at = 1
    for start, end, ids in spans(pieces, chars):
        if end > at:
            _rescale(alpha, scale, at)
            at = end
            scale[end] = scale[end - 1]
        known = np.nonzero(ids < len(pieces.pieces))[0]
        if len(known):
            alpha[end, known] += alpha[start, known] * prob[ids[known]] * np.exp(scale[start, known] - scale[end, known])[:, None]
        if start == end - 1:
            alpha[end] += alpha[start] * UNKNOWN * np.exp(scale[start] - scale[end])[:, None]
    if n:
        _rescale(alpha, scale, n)
    return np.log(np.maximum(alpha[n], 1e-300)) + scale[n][:, None]


def _rescale(alpha: np.ndarray, scale: np.ndarray, at: int) -> None:
    top = np.maximum(alpha[at].max(axis=1, initial=0.0), 1e-300)
    alpha[at] /= top[:, None]
    scale[at] += np.log(top)


class Model:
    def __init__(self, languages: list[str], pieces: Pieces, prob: np.ndarray):
        self.languages, self.pieces, self.prob = languages, pieces, prob

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages) log probabilities."""
        out = np.zeros((len(words), len(self.languages)))
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            at = np.nonzero(lengths == n)[0]
            for a in range(0, len(at), 20_000):
                some = at[a : a + 20_000]
                out[some] = forward(self.pieces, self.prob, matrix_of([words[k] for k in some]))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages ('und' without a letter) and their posterior probabilities."""
        lists = [parts_of(words_of(t)) for t in texts]
        codes, distinct, bounds = coded(lists)
        scores = self.word_scores(list(distinct))
        total = np.zeros((len(texts), len(self.languages)))
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(doc, scores[codes, k], len(texts)) if len(codes) else 0
        some = np.array([any(any(map(str.isalpha, w)) for w in ws) for ws in lists], bool)  # not only other numbers
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, np.clip(post, 0, 1), 0.0)


def fit(rows: list[tuple[str, str]], vocabulary: list[str], rounds: int = 4, smoothing: float = 0.1) -> Model:
    """rows: (language, text). The vocabulary is cut to the pieces that occur in them and single letters."""
    languages = sorted({lang for lang, _ in rows})
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        k = languages.index(lang)
        for w in parts_of(words_of(text)):
            counts.setdefault(w, np.zeros(len(languages)))[k] += 1
    seen = {w[i:j] for w in counts for i in range(len(w)) for j in range(i + 1, min(len(w), i + 16) + 1)}
    pieces = Pieces([p for p in {START, *vocabulary} if p in seen])
    n = len(pieces.pieces)
    by_length: dict[int, list[str]] = {}
    for w in sorted(counts):
        by_length.setdefault(len(w), []).append(w)
    prob = np.zeros((n + 1, len(languages)))
    prob[:n] = 1 / max(1, n)
    for _ in range(rounds):
        expected = np.zeros((n + 1, len(languages)))
        for group in by_length.values():
            chars = matrix_of(group)
            weight = np.array([counts[w] for w in group])
            size, m = chars.shape
            alpha, beta = np.zeros((size + 1, m, len(languages))), np.zeros((size + 1, m, len(languages)))
            alpha[0], beta[size] = 1.0, 1.0
            found = list(spans(pieces, chars))
            for start, end, ids in found:
                alpha[end] += alpha[start] * (prob[ids] + (UNKNOWN if start == end - 1 else 0))
            for start, end, ids in reversed(sorted(found, key=lambda x: x[0])):
                beta[start] += beta[end] * (prob[ids] + (UNKNOWN if start == end - 1 else 0))
            scale = weight / np.maximum(alpha[size], 1e-300)
            for start, end, ids in found:
                np.add.at(expected, ids, alpha[start] * prob[ids] * beta[end] * scale)
        prob[:n] = expected[:n] + smoothing
        prob[:n] /= prob[:n].sum(axis=0)
    return Model(languages, pieces, prob)


def vocabulary_of(path: str) -> list[str]:
    """The letter pieces of a sentencepiece model, in lower case."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()))
    return sorted({p for p in pieces if WORD.fullmatch(p.removeprefix(START)) or p == START})


def training_rows(docs: DataFrame, per_language: int, most_languages: int, most_chars: int, lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most per_language documents of each of the most_languages most frequent
    languages outside the held-out fold, those of least id hash, and of their
    texts at most most_chars characters in all. Ids are chosen first, without
    reading texts: the least of each part of a language, then of the language,
    so no task ranks more than a bounded number of them. Of rows of one id and
    language the least text counts; a null text counts among the chosen ones."""
    lang = F.col(lang_col).cast("string")
    named = docs.where(F.col(lang_col).isNotNull() & ~is_held_out(F.col("doc_id"))).withColumn("of", lang)
    top = named.groupBy("of").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "of").limit(most_languages).drop("n")
    ids = named.select("of", F.col("doc_id").alias("chosen"), F.xxhash64("doc_id").alias("h")).distinct().join(F.broadcast(top), "of")
    for part in ([F.pmod("h", F.lit(256))], []):
        least = Window.partitionBy("of", *part).orderBy("h", "chosen")
        ids = ids.withColumn("r", F.row_number().over(least)).where(F.col("r") <= per_language).drop("r")
    wanted = ids.drop("h").withColumnRenamed("of", "language")
    rows = named.where("text is not null").join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("of") == F.col("language")))
    rows = rows.groupBy("doc_id", "language").agg(F.min(F.col("text").cast("string")).alias("text"))
    return bounded_texts(stored(rows, "learned"), "language", most_chars)


def identify(docs: DataFrame, vocabulary: str, *, per_language: int = 400, most_languages: int = 200, most_chars: int = 40_000_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    Learns from the texts and languages of at most per_language documents of each
    of at most most_languages languages, and most_chars characters of them
    (documented bounds: the model is small), whose id is not in the held-out
    fold, and from nothing else. A null text or one without letters is 'und'
    with score 0, as is every text if no row has a language. Texts of any length
    are read whole; repeated rows are each returned; no rows: no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(training_rows(docs, per_language, most_languages, most_chars), vocabulary_of(vocabulary)))
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_slices(texts, 3_000_000):
                langs, scores = model.value.predict(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
