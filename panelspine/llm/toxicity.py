"""Toxicity by a bag of subword embeddings and a linear softmax.

A word stands for itself and its character n-grams, each hashed to a row of an
embedding table; a text is the mean of all its rows; two linear outputs and a
softmax give the label. Table and outputs are trained jointly by Adam. As rows
belong to n-grams, a misspelling that training never saw shares most rows with
the word it stands for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, is_held_out, stored, text_slices
from .langid import matrix_of
from .words import GOLDEN, coded, mix

WORD = re.compile(r"[^\W\d_]+")
GRAMS = (3, 4, 5)
#: Longer words are cut to parts of this length.
LONGEST = 32


def words_of(text: str) -> list[str]:
    out = []
    for w in WORD.findall(text.lower()):
        out += [f"<{w}>"] if len(w) <= LONGEST else [f"<{w[k : k + LONGEST]}>" for k in range(0, len(w), LONGEST)]
    return out


def subwords(words: list[str], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row ids, word of each): the word itself and its n-grams."""
    ids, owner = [], []
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.nonzero(lengths == n)[0]
        chars = matrix_of([words[k] for k in at])
        for g in {*(g for g in GRAMS if g < n), int(n)}:
            for s in range(n - g + 1):
                h = np.full(len(at), np.uint64(g))
                for c in chars[s : s + g]:
                    h = h * GOLDEN + c
                ids.append((mix(h) % np.uint64(rows)).astype(np.int64))
                owner.append(at)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(owner)


class Model:
    """table: (rows, dimensions); out: (dimensions, 2); bias: (2,);
    share: of label 1 among the training rows."""

    def __init__(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray, share: float | None = None):
        self.table, self.out, self.bias, self.share = table, out, bias, share
        self.logit = table @ (out[:, 1] - out[:, 0])  # what a row adds to the log odds

    def scores(self, texts: list[str]) -> np.ndarray:
        codes, distinct, bounds = coded([words_of(t) for t in texts])
        ids, owner = subwords(list(distinct), len(self.table))
        word_sum = np.bincount(owner, self.logit[ids], len(distinct))
        word_n = np.bincount(owner, minlength=len(distinct))
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        total = np.bincount(doc, word_sum[codes], len(texts)) if len(codes) else np.zeros(len(texts))
        n = np.bincount(doc, word_n[codes], len(texts)) if len(codes) else np.zeros(len(texts))
        odds = total / np.maximum(n, 1) + self.bias[1] - self.bias[0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit(rows: list[tuple[int, str]], *, table_rows: int = 1 << 18, dimensions: int = 4, epochs: int = 12, least_steps: int = 600, batch: int = 32, rate: float = 0.05, decay: float = 1e-6, seed: int = 7) -> Model:
    """rows: (label, text). Without both labels the model answers the share of label 1."""
    rng = np.random.default_rng(seed)
    labels = np.array([y for y, _ in rows], np.int64)
    table = rng.normal(0, 0.1, (table_rows, dimensions))
    out = rng.normal(0, 0.5, (dimensions, 2))
    share = np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3)
    bias = np.array([0.0, np.log(share / (1 - share))])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros_like(table), out, bias)
    codes, distinct, bounds = coded([words_of(t) for _, t in rows])
    ids, owner = subwords(list(distinct), table_rows)
    order = np.argsort(owner, kind="stable")
    ids, first = ids[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1))
    bags = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        words, n = np.unique(codes[a:b], return_counts=True)
        size = first[words + 1] - first[words]
        at = np.repeat(first[words] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(words) else np.zeros(0, np.int64)
        weight = np.repeat(n, size).astype(float)
        row, where = np.unique(ids[at], return_inverse=True)
        bags.append((row, np.bincount(where, weight, len(row)) / max(1.0, weight.sum())))
    moment, square = np.zeros_like(table), np.zeros_like(table)
    m_out, s_out = np.zeros_like(out), np.zeros_like(out)
    last = np.zeros(table_rows, np.int64)
    step = 0
    epochs = max(epochs, -(-least_steps // max(1, len(rows) // batch)))  # few rows are seen more often
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            step += 1
            flat = np.concatenate([bags[k][0] for k in part])
            weight = np.concatenate([bags[k][1] for k in part])
            doc = np.repeat(np.arange(len(part)), [len(bags[k][0]) for k in part])
            used, where = np.unique(flat, return_inverse=True)
            mean = np.stack([np.bincount(doc, weight * table[flat, d], len(part)) for d in range(dimensions)], axis=1)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            g_mean, g_out = p @ out.T, mean.T @ p
            g = np.stack([np.bincount(where, weight * g_mean[doc, d], len(used)) for d in range(dimensions)], axis=1) + decay * table[used]
            idle = step - last[used]
            last[used] = step
            moment[used] = moment[used] * 0.9 ** idle[:, None] + 0.1 * g
            square[used] = square[used] * 0.999 ** idle[:, None] + 0.001 * g * g
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            table[used] -= lr * fix * moment[used] / (np.sqrt(square[used]) + 1e-8)
            m_out, s_out = 0.9 * m_out + 0.1 * g_out, 0.999 * s_out + 0.001 * g_out * g_out
            out -= lr * fix * m_out / (np.sqrt(s_out) + 1e-8)
            bias -= 0.1 * lr * p.sum(axis=0)
    return Model(table, out, bias, float(share))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int, most_chars: int) -> list[tuple[int, str]]:
    """At most per_label labelled documents of either label outside the held-out
    fold, by least id hash, and of their texts at most most_chars characters in
    all. An id with both labels counts as 1; of rows of one id the least text
    counts. Texts are taken by ascending hash until the characters are reached."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = [named.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]  # the least of every task, then of those
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    rows = stored(rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "labelled")
    return bounded_texts(rows, "toxic", most_chars)


def _odds(share: float) -> float:
    return float(np.log(share / (1 - share)))


def label_share(labels: DataFrame) -> float | None:
    """The share of label 1 outside the held-out fold, if both labels occur."""
    row = labels.where(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    return row if row and row < 1 else None


def score_toxicity(docs: DataFrame, labels: DataFrame, *, per_label: int = 1500, most_chars: int = 40_000_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns from at most per_label labelled documents of either label and
    most_chars characters of them (documented bounds) outside the held-out fold.
    A null or wordless text gets the score of the bias alone; without labels
    every score is the least share, 0.001. Texts of any length are scored whole;
    repeated rows are each returned; no rows: no rows; other columns are not read.
    """
    spark = docs.sparkSession
    fitted = fit(training_rows(docs, labels, per_label, most_chars))
    share = label_share(labels)
    if share is not None and fitted.share is not None:
        fitted.bias[1] += _odds(share) - _odds(fitted.share)  # from the sample's share of label 1 to that of all labels
    model = spark.sparkContext.broadcast(fitted)
    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_slices(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.value.scores(texts[a:b]))], ["doc_id", "held_out", "score"])

    got = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
