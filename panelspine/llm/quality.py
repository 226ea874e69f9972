"""Quality rules by document, and by host with shrunken failure rates.

Every document is counted once for four rules; a host (the source column) is
judged by the share of its documents that fail each rule, shrunk towards the
corpus by a beta prior whose mean and strength are estimated from all hosts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, text_slices
from .words import coded

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window of five words which the text
    holds twice or more. Windows are compared exactly, by ids of their halves."""
    n_docs = len(bounds) - 1
    n = len(codes) - WINDOW + 1
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    pair = pd.factorize(codes[:-1] * (codes.max() + 1) + codes[1:])[0].astype(np.int64)
    four = pd.factorize(pair[:-2] * (pair.max() + 1) + pair[2:])[0].astype(np.int64)
    five = pd.factorize(four[:-1] * (codes.max() + 1) + codes[4:])[0].astype(np.int64)
    whole = doc[:n] == doc[WINDOW - 1 :]
    at = np.nonzero(whole)[0]
    key, _ = pd.factorize(five[at] * n_docs + doc[at])
    again = at[np.bincount(key)[key] > 1] if len(at) else at
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    marked = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[marked], minlength=n_docs)


def count_rules(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [b.split() for b in raw]  # bytes split at ASCII white space only
    codes, _, bounds = coded(words)
    dup = []
    for b in raw:
        seen, k = set(), 0
        for line in b.split(b"\n"):
            if line in seen:
                k += 1
            elif line.strip():
                seen.add(line)
        dup.append(k)
    return {
        "n_words": np.diff(bounds),
        "word_chars": np.array([len(t) - sum(map(t.count, " \t\n\v\f\r")) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": repeated_words(codes, bounds).astype(np.int64),
    }


def _with_counts(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """keep's columns and the counts; only these columns are read."""
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in text_slices(texts):
                got = count_rules(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(got[c], pa.int64()) for c in COUNTS], [*keep, *COUNTS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, ", ".join(x for x in (kinds, ", ".join(f"{c} long" for c in COUNTS)) if x))


def rules() -> dict[str, Column]:
    """What fails a document, by rule."""
    n = F.col("n_words")
    return {
        "short": n < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": F.col("n_dup_lines") > 10,
    }


def base_failed() -> Column:
    r = rules()
    return r["short"] | r["repeats"]


def host_rates(counted: DataFrame, host_col: str, least_strength: float = 2.0, most_strength: float = 1000.0) -> DataFrame:
    """One row per host: n, failures and shrunken rate of each rule.

    The prior of a rule has the mean rate over all documents and a strength by
    the method of moments from the spread of the hosts' rates, held in
    [least_strength, most_strength]. Rows without a host are left out.
    """
    names = list(rules())
    hosts = counted.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host"))
    hosts = hosts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("long")).alias(f"k_{r}") for r, x in rules().items()])
    hosts = stored(hosts, "hosts")
    mean = hosts.agg(F.sum("n").alias("n"), *[(F.sum(f"k_{r}") / F.sum("n")).alias(r) for r in names]).first()
    if not mean["n"]:
        return hosts.select("*", *[F.lit(0.0).alias(f"rate_{r}") for r in names])
    spread = hosts.agg(*[(F.sum(F.col("n") * F.pow(F.col(f"k_{r}") / F.col("n") - mean[r], F.lit(2))) / F.sum("n")).alias(r) for r in names]).first()
    out = hosts
    for r in names:
        var = mean[r] * (1 - mean[r])
        strength = min(most_strength, max(least_strength, var / spread[r] - 1 if spread[r] else most_strength))
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + mean[r] * strength) / (F.col("n") + strength))
    return out


def failed_hosts(hosts: DataFrame, most: float) -> DataFrame:
    """Hosts of which some rule's shrunken rate exceeds most."""
    return hosts.where(F.greatest(*[F.col(f"rate_{r}") for r in rules()]) > most).select("host")


def quality_verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row per document.

    A null text has no words and fails; a null host gives no host verdict;
    repeated rows each count and are each returned. Empty input: no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    counted = stored(_with_counts(rows, ["doc_id", "host"], "text"), "rule-counts")
    bad = failed_hosts(host_rates(counted, "host"), most).withColumn("host_failed", F.lit(True))
    out = counted.join(bad, "host", "left")
    return out.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & F.col("host_failed").isNull()).alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", most: float = 0.5, most_hosts: int = 1_000_000) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with all their columns.

    A null or empty text has no words and goes; a null host gives no host
    verdict; repeated rows each count and are each kept or dropped; texts of any
    length are counted whole; no rows: no rows. The counts are made twice, once
    for the hosts and once to pass rows on, so that no text is stored. Failed
    hosts up to most_hosts reach the tasks as a set; more are joined to the rows,
    salted, so that a host with a third of all rows is spread.
    """
    host = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    bad = stored(failed_hosts(host_rates(_with_counts(host, ["host"], "text"), "host"), most), "failed-hosts")
    names = docs.columns

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in text_slices(texts):
                got = count_rules(texts[a:b])
                good = (got["n_words"] >= 10) & (100 * got["n_repeat_words"] <= 20 * got["n_words"])
                yield batch.slice(a, b - a).filter(pa.array(good))

    kept = docs.mapInArrow(passing, docs.schema)
    if bad.limit(most_hosts + 1).count() <= most_hosts:
        return kept.join(F.broadcast(bad.withColumnRenamed("host", host_col)), host_col, "left_anti").select(*names)
    part, salt = free_name(docs, "part"), 64
    salted = bad.withColumnRenamed("host", host_col).withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return kept.withColumn(part, F.pmod(F.xxhash64(text_col), F.lit(salt)).cast("int")).join(salted, [host_col, part], "left_anti").select(*names)
