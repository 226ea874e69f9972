"""Best-fit packing of documents into sequences under conflict constraints.

A bin is one training sequence of ``capacity`` tokens. It may not hold two
documents of one duplicate cluster, nor more than ``per_source`` of one
source. Bins stand in residual order and carry bitmaps: one of the clusters
they hold, and one plane for each further document of a source. A document
goes to the tightest bin that fits: the search starts at the least residual
that is large enough and goes to the next one until no bitmap forbids it.

Documents are dealt to packs of bounded size by a hash of their row, and each
pack is packed by itself, so a source or cluster with any share of the rows is
spread evenly, and no group grows with the data; equal rows are numbered and
dealt by their number too. Members of one cluster may thus be in different
packs, where they share no bin anyway.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices
from .token_blocks import word_tokenizer


def best_fit(items: list[tuple[int, int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) for each item (size, tie key, source, cluster).

    Largest first; ties by the tie key. Sizes are at most capacity; items of
    size 0 take no room but keep the constraints. A source or cluster of None
    has no constraint.
    """
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1]))
    source_bit: dict = {}
    cluster_bit: dict = {}
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    planes: list[list[int]] = []  # per bin: plane k has the sources with over k documents
    clusters: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(items)
    least = min((size for size, *_ in items), default=0)
    for i in order:
        size, _, source, cluster = items[i]
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        k = bisect_left(open_bins, (size, -1))
        while k < len(open_bins) and (clusters[open_bins[k][1]] & c or planes[open_bins[k][1]][-1] & s):
            k += 1
        if k < len(open_bins):
            residual, at = open_bins.pop(k)
        else:
            residual, at = capacity, len(planes)
            planes.append([0] * per_source)
            clusters.append(0)
        out[i] = (at, capacity - residual)
        clusters[at] |= c
        carry = s
        for plane in range(per_source):
            planes[at][plane], carry = planes[at][plane] | carry, planes[at][plane] & carry
        if residual - size >= least:
            insort(open_bins, (residual - size, at))
    return out


def numbered(rows: DataFrame, at_once: int = 10_000) -> DataFrame:
    """rows with copy, a number 0, 1, ... among equal rows. Equal rows are counted
    and made again from their count, in two steps, so that no task holds them all."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    firsts = counted.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(at_once).cast("long"))))
    few = firsts.where("n = 1").select(*rows.columns, F.col("from").alias("copy"))
    many = firsts.where("n > 1").repartition("from", *rows.columns)
    return few.union(many.select(*rows.columns, F.explode(F.sequence("from", F.least(F.col("from") + at_once, F.col("n")) - 1))))


def pack(items: DataFrame, capacity: int, *, per_source: int = 2, pack_rows: int = 3000) -> DataFrame:
    """bin_id, bin_offset, doc_id, piece, n_tokens.

    items: doc_id, n_tokens, source, cluster. A document longer than capacity
    is cut in pieces: full ones take a bin each, the rest is packed. Nothing is
    dropped: a document of 0 tokens has one piece of 0 tokens. Null sizes count
    as 0; null sources and clusters are free of constraints, null ids are packed
    like others; repeated rows are each packed; other columns are not read.
    Empty input: no rows.
    """
    n = max(1, -(-items.count() // pack_rows))
    size = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    cut = numbered(items.select("doc_id", size.alias("size"), "source", "cluster"))
    cut = cut.withColumn("pack", F.pmod(F.xxhash64(F.lit(17), "doc_id", "source", "cluster", "copy"), F.lit(n)))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / capacity).cast("long"))))
    cut = cut.withColumn("n", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        null = lambda x: None if pd.isna(x) else x
        doc = [-1 if pd.isna(d) else int(d) for d in rows["doc_id"]]
        placed = best_fit(
            [(int(z), (d, int(p), int(k)), null(s), null(c)) for z, d, p, k, s, c in zip(rows["n"], doc, rows["piece"], rows["copy"], rows["source"], rows["cluster"], strict=True)],
            capacity,
            per_source,
        )
        return pd.DataFrame(
            {
                "bin_id": [int(key[0]) << 32 | b for b, _ in placed],
                "bin_offset": [o for _, o in placed],
                "doc_id": rows["doc_id"].astype("Int64"),
                "piece": rows["piece"],
                "n_tokens": rows["n"],
            }
        )

    return cut.groupBy("pack").applyInPandas(one, "bin_id long, bin_offset long, doc_id long, piece long, n_tokens long")


def measured(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Items of documents: n_tokens is the number of ids that token_blocks writes
    for the text, with the one that ends it; cluster is the same for texts equal
    but for case and white space. Null texts count as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(tokenizer)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_slices(texts):
                part = batch.slice(a, b - a)
                sizes = [tokens.count(t) + 1 for t in texts[a:b]]
                clusters = [int.from_bytes(hashlib.blake2b(" ".join(t.lower().split()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), part.column(1), pa.array(clusters, pa.int64())], ["doc_id", "n_tokens", "source", "cluster"])

    return rows.mapInArrow(measure, "doc_id long, n_tokens long, source string, cluster long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, *, clusters: DataFrame | None = None, **options) -> DataFrame:
    """Documents packed by pack, measured by measured.

    clusters (doc_id, class_id), such as near_duplicates gives, take the place of
    equal texts as duplicate clusters; of several classes of one id the least
    counts, and an id without one is free of constraints.
    """
    items = measured(docs, tokenizer)
    if clusters is not None:
        classes = clusters.groupBy(F.col("doc_id").alias("of")).agg(F.min("class_id").alias("class_id"))
        items = items.join(classes, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "n_tokens", "source", F.col("class_id").alias("cluster"))
    return pack(stored(items, "items"), capacity, **options)
