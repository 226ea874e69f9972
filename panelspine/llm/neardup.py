"""Near-duplicate groups by weighted Jaccard similarity of word shingles.

A text is the multiset of its five-word shingles (lower case, split at white
space; a text of one to four words is one shingle). BagMinHash draws, for each
shingle, Poisson points over its weight axis. The axis is cut into the dyadic
layers [0,1), [1,2), [2,4), ...; the points of a layer descend by hash bits to
one of its unit cells and count if that cell is below the shingle's count. A
signature component is the earliest point that falls to it, so two texts agree
in a component with exactly their weighted Jaccard similarity.

Steps: texts of equal multisets become one node; signatures are cut in bands;
in each bucket every node is compared with the bucket's smallest node; nodes of
buckets that hold several components get finer bands and are compared there; all comparisons are of whole multisets; connected
components of the links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices
from .words import GOLDEN, coded, hashes, mix

SHINGLE = 5
#: Two texts of similarity 0.8 share a band with probability 0.9999, a fine one with 0.99.
BANDS, ROWS = 30, 6
FINE_BANDS, FINE_ROWS = 160, 16
SKETCH = 1024


def _times(k: int) -> np.uint64:
    return np.uint64(int(GOLDEN) * k & 0xFFFFFFFFFFFFFFFF)


def shingle_bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes, ascending, and their counts, for each text."""
    codes, distinct, bounds = coded([t.lower().split() for t in texts])
    h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(h) - SHINGLE + 1
    rolled = np.zeros(max(0, n), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        rolled = rolled * GOLDEN + h[k : k + n]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1], return_counts=True))
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = np.uint64((int(one) * int(GOLDEN) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append((mix(np.array([one], np.uint64)), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def bag_signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """One row of m signature components (float64 times) per bag; an empty bag's are infinite."""
    sig = np.full(len(bags) * m, np.inf)
    sizes = [len(b[0]) for b in bags]
    doc = np.repeat(np.arange(len(bags)), sizes)
    element = np.concatenate([b[0] for b in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([b[1] for b in bags]) if bags else np.zeros(0, np.int64)
    layers = [(doc, mix(element), weight, np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64))]
    low = 1
    while True:
        over = weight > low
        if not over.any():
            break
        k = int(over.sum())
        layers.append((doc[over], mix(element[over] + _times(low + 1)), weight[over], np.full(k, low), np.full(k, low)))
        low *= 2
    doc, state, weight, lowest, length = (np.concatenate(x) for x in zip(*layers, strict=True))
    time = np.zeros(len(doc))
    while len(doc):
        steps = int(min(64, max(1, 60_000 // len(doc))))
        draws = mix(state[:, None] + GOLDEN * np.arange(1, steps + 1, dtype=np.uint64))
        state = state + _times(steps)
        gaps = -np.log1p(-((draws >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / length[:, None]
        gaps[:, 0] += time  # one addition after the other, so that rounding does not depend on steps
        times = np.cumsum(gaps, axis=1)
        where = mix(draws ^ GOLDEN)
        place = ((where >> np.uint64(40)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        cell = lowest[:, None] + (where & (length[:, None] - 1).astype(np.uint64)).astype(np.int64)
        inside = cell < weight[:, None]
        np.minimum.at(sig, (doc[:, None] * m + place)[inside], times[inside])
        time = times[:, -1]
        live = time < sig.reshape(-1, m).max(axis=1)[doc]
        doc, state, weight, lowest, length, time = (x[live] for x in (doc, state, weight, lowest, length, time))
    return sig.reshape(-1, m)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for k in range(rows):
        h = mix(h * GOLDEN + bits[:, :, k])
    return h.view(np.int64)


def content_key(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.blake2b(bag[0].tobytes() + bag[1].astype("<i8").tobytes(), digest_size=16).digest()


# --------------------------------------------------------------------------
# Spark


def _signed(rows: DataFrame) -> DataFrame:
    """doc, th, key, node, size and bands of (doc, th, text) rows."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_slices(texts):
                bags = shingle_bags(texts[a:b])
                bands = band_hashes(bag_signatures(bags))
                keys = [content_key(x) for x in bags]
                full = np.array([len(x[0]) > 0 for x in bags])
                offsets = np.zeros(len(bags) + 1, np.int32)
                np.cumsum(np.where(full, BANDS, 0), out=offsets[1:])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(keys, pa.binary()),
                        pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()),
                        pa.array([int(x[1].sum()) for x in bags], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[full].reshape(-1), pa.int64())),
                    ],
                    ["doc", "th", "key", "node", "size", "bands"],
                )

    return rows.mapInArrow(sign, "doc long, th long, key binary, node long, size long, bands array<long>")


def _similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with their exact similarity j. texts: node, text."""
    rows = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, None
        for batch in batches:
            ids, left, right = batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            out = np.empty(len(ids))
            for s, e in text_slices(right):
                for k, other in enumerate(shingle_bags(right[s:e]), s):
                    if ids[k] != last:
                        last, bag = ids[k], shingle_bags([left[k].as_py()])[0]
                    out[k] = weighted_jaccard(bag, other)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "j"])

    return rows.mapInArrow(compare, "a long, b long, j double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node of its
    component. edges: a, b. Alternates large-star and small-star steps, each a
    minimum and a join, until the stars stand still."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct(), "stars")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def links(signed: DataFrame, docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): one row per distinct multiset, and the verified pairs (a, b)."""
    nodes = signed.groupBy("key").agg(F.min(F.struct("doc", "th")).alias("rep"), F.first("node").alias("node"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stored(nodes.select("key", "node", "size", F.col("rep.doc").alias("doc"), F.col("rep.th").alias("th"), "bands"), "nodes")
    inside = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = stored(inside.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    many = stored(inside.join(buckets.where("n > 2").select("bucket", "a"), "bucket"), "bucket-members")
    first = stored(buckets.where("n = 2").select("a", F.col("z").alias("b")).union(many.select("a", F.col("node").alias("b"))).where("a != b").distinct(), "pairs")
    used = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(used, "node", "left_semi").select("node", F.col("doc").alias("doc0"), F.col("th").alias("th0"))
    texts = docs.join(wanted, F.col("doc").eqNullSafe(F.col("doc0")) & (F.col("th") == F.col("th0"))).select("node", "text")
    texts = stored(texts.dropDuplicates(["node"]), "texts")
    seen = stored(_similarities(first, texts), "similar")
    near = seen.where(F.col("j") >= threshold).select("a", "b")
    found = _missed(nodes, many, seen, texts, near, first, threshold)
    return nodes, stored(near.union(found), "links")


def _missed(nodes: DataFrame, many: DataFrame, seen: DataFrame, texts: DataFrame, near: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """Links that comparing with each bucket's least node alone could miss.

    They join two components that meet in a bucket. There, the nodes outside the
    most frequent one are compared with one of its nodes more. What stays apart
    gets finer bands, which dissimilar texts seldom share; there, nodes of
    different components are compared unless their sizes, their sketches, or by
    the triangle inequality their distances to a common least node rule the link out. Nodes
    of a bucket's most frequent component are not paired with each other.
    """
    member = many.where("a != node").join(seen.withColumnRenamed("b", "node"), ["a", "node"]).select("bucket", "node", "a", "j")

    def rooted(edges: DataFrame) -> DataFrame:
        return stored(member.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")), "members")

    # A second comparison per bucket: with a node, drawn by hash, of its most frequent component.
    now = rooted(near)
    of = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("bucket", "node")).alias("pick"))
    of = of.groupBy("bucket").agg(F.max(F.struct("n", "root", "pick")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    second = now.join(of, "bucket").where("root != top.root").select(F.least("node", "top.pick").alias("a"), F.greatest("node", "top.pick").alias("b"))
    second = stored(second.distinct().join(first, ["a", "b"], "left_anti"), "second-pairs")
    found = stored(_similarities(second, texts).where(F.col("j") >= threshold).select("a", "b"), "second-links")
    now = rooted(near.union(found))
    split = now.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    again = now.join(split, "bucket", "left_semi").groupBy("node").agg(F.min(F.struct("a", "j", "root")).alias("m"))
    again = stored(again.select("node", "m.*").join(nodes.select("node", "size"), "node"), "open-nodes")
    signed = stored(_finer(texts.join(again.select("node"), "node", "left_semi")), "fine-signed")
    slim = stored(signed.select("node", F.explode("buckets").alias("bucket")).join(again.select("node", "root"), "node"), "fine-members")
    count = slim.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    top = count.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    words = [f"k{i}" for i in range(SKETCH // 64)]
    known = again.join(signed.select("node", *[F.col("sketch")[i].alias(k) for i, k in enumerate(words)]), "node")
    fine = slim.drop("root").join(top.select("bucket", F.col("top.root").alias("top")), "bucket").join(known, "node")
    fine = stored(fine, "fine-open")
    x, y = fine.where("root != top").alias("x"), fine.alias("y")
    apart = reduce(add, [F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in words])
    pairs = x.join(
        y,
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.root") != F.col("y.root"))
        & ((F.col("x.node") < F.col("y.node")) | (F.col("y.root") == F.col("y.top")))
        & ((F.col("x.a") != F.col("y.a")) | (F.abs(F.col("x.j") - F.col("y.j")) <= 1 - threshold + 1e-9))
        & (F.least("x.size", "y.size") >= threshold * F.greatest("x.size", "y.size"))
        & (apart <= sketch_limit(threshold)),
    ).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    pairs = stored(pairs.distinct().join(first.union(second), ["a", "b"], "left_anti"), "more-pairs")
    return found.union(_similarities(pairs, texts).where(F.col("j") >= threshold).select("a", "b"))


def sketch_limit(threshold: float) -> int:
    """How many of the SKETCH bits may differ: a bit of two texts of similarity
    j agrees with probability (1 + j) / 2; the limit is 4.5 deviations beyond
    the mean at the threshold, where it rules out 3 in a million links."""
    p = (1 - threshold) / 2
    return int(SKETCH * p + 4.5 * (SKETCH * p * (1 - p)) ** 0.5)


def _finer(texts: DataFrame) -> DataFrame:
    """(node, buckets, sketch) of (node, text) rows: the fine bands, and one bit
    of each of the first SKETCH signature components."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column(1).to_pylist()
            for a, b in text_slices(got, 300_000):
                sig = bag_signatures(shingle_bags(got[a:b]), FINE_BANDS * FINE_ROWS)
                bits = (mix(np.ascontiguousarray(sig[:, :SKETCH]).view(np.uint64)) >> np.uint64(63)).astype(np.uint8)
                sketch = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                buckets = band_hashes(sig, FINE_BANDS, FINE_ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(buckets), pa.list_(pa.int64())), pa.array(list(sketch), pa.list_(pa.int64()))], ["node", "buckets", "sketch"])

    return texts.select("node", "text").mapInArrow(sign, "node long, buckets array<long>, sketch array<long>")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """doc, th, class_id, class_th: each row's class by its least (id, hash)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("th"), "text")
    signed = stored(_signed(rows), "signed")
    nodes, near = links(signed, rows, threshold)
    rooted = nodes.join(components(near), "node", "left").select("key", F.struct("doc", "th").alias("rep"), F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted")
    top = rooted.groupBy("root").agg(F.min("rep").alias("top"))
    by_key = rooted.join(top, "root").select("key", "top")
    return signed.select("doc", "th", "key").join(by_key, "key").select("doc", "th", F.col("top.doc").alias("class_id"), F.col("top.th").alias("class_th"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id and class_id (the class's least id), one row per row of docs.

    Texts without words (null, empty, blank) form one class. Null ids sort
    first. Repeated rows are each returned, in one class. Empty input: no rows.
    """
    return _classes(docs, id_col, text_col, threshold).select(F.col("doc").alias("doc_id"), "class_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of docs per class, the least by id and text hash, with all its columns."""
    got = stored(_classes(docs, id_col, text_col, threshold), "classes")
    first = got.where(F.col("doc").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th")))
    first = stored(first.groupBy("doc", "th").agg(F.count(F.lit(1)).alias("n")).toDF("__doc", "__th", "__n"), "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.join(first, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__th")))
    once = out.where("__n = 1").select(*docs.columns)
    if first.where("__n > 1").isEmpty():
        return once
    return once.union(out.where("__n > 1").dropDuplicates(["__doc", "__th"]).select(*docs.columns))
