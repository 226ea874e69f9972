"""Benchmark passages in documents, by an edit-to-Hamming embedding.

Texts are lower-case words. A CGK random walk maps a word string to a longer
string: at step j it copies the word under its pointer and then, by a random
bit for (j, word), moves the pointer on or leaves it. Two strings at a small
edit distance stay aligned for most steps, so their embeddings have a small
Hamming distance, and a few sampled steps agree with good probability. Each
repetition has a walk and a sample of its own. As edits push the walks apart in
time, half of the repetitions walk from the end of the string to its start, and
samples come from the whole walk or from its first half, quarter or eighth.

A window of an item's size that begins (or, for the walks from the end, ends)
where a passage does differs from the item by edits, so both are embedded and
meet in some repetition's bucket; a meeting is verified by the exact word edit
distance. The number of repetitions is chosen by item size: items of random
words with the largest allowed number of deletions, insertions or substitutions
are embedded, and repetitions are doubled until the wanted share of each kind
is found.

Before that, an exact count filter spares clean text: an edit breaks at most two
of an item's n - 1 word pairs, or one and pushes another out of a window of n
words, so at least n - 1 - 2e pairs of the item stand in the window.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_slices
from .words import GOLDEN, coded, hashes, mix

WORD = re.compile(r"\w+")
#: The items are held in every task; beyond this they are not broadcast but
#: handled in blocks of this many characters, one pass over documents each.
BLOCK_CHARS = 32_000_000
#: Texts are searched together up to this many characters.
SLICE_CHARS = 4_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def closest_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the substring of text closest to item; of equals
    the earliest end, then the earliest start. Cost and start are one integer,
    so that a row of the table is a few minima."""
    one, at = np.int64(1) << 32, np.arange(len(text) + 1)
    step = at * one
    row = at.copy()  # cost 0, start j
    for i, x in enumerate(item, 1):
        best = row + one
        np.minimum(best[1:], row[:-1] + np.where(text != x, one, 0), out=best[1:])
        best[0] = i * one
        row = np.minimum.accumulate(best - step) + step
    end = int((row >> 32).argmin())
    return int(row[end] >> 32), int(row[end] & (one - 1)), end


class Benchmark:
    """Items prepared for the search. items: (id, text); recall: the share of
    passages with the most edits that the embedding alone shall find."""

    SCALES = (1, 2, 4, 8)
    MOST = 1024

    def __init__(self, items: list[tuple[int, str]], similarity: float = 0.8, recall: float = 0.99, samples: int = 2, seed: int = 1):
        self.similarity, self.recall, self.samples, self.seed = similarity, recall, samples, seed
        lists = [(i, words_of(t)) for i, t in items]
        self.items = [(i, hashes(np.array(w, object)), self.edits(len(w))) for i, w in lists if w]
        self.sizes: dict[int, list[int]] = defaultdict(list)
        for k, (_, h, _) in enumerate(self.items):
            self.sizes[len(h)].append(k)
        # For each word pair (and lone word of one-word items), a bit for each size of the items that hold it.
        self.bit = {n: np.uint64(k % 64) for k, n in enumerate(sorted(self.sizes))}
        bits: dict[int, int] = defaultdict(int)
        self.holders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, members in self.sizes.items():
            keys = [np.unique(self.keys_of(self.items[k][1])) for k in members]
            for x in np.concatenate(keys).tolist():
                bits[x] |= 1 << int(self.bit[n])
            flat, who = np.concatenate(keys), np.repeat(members, [len(x) for x in keys])
            order = np.argsort(flat, kind="stable")
            self.holders[n] = flat[order], who[order]
        self.pairs = np.array(sorted(bits), np.uint64)
        self.pair_bits = np.array([bits[x] for x in self.pairs.tolist()], np.uint64)
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.pairs >> np.uint64(44)).astype(np.int64)] = True
        self.lone = 1 in self.sizes
        self.walks = {n: self._plan(n) for n in self.sizes}
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, members in self.sizes.items():
            words = np.concatenate([self.items[k][1] for k in members])
            at = np.arange(len(members)) * n
            keys = np.concatenate([self.embed(words, at, at + n, n, way) for way in (0, 1)], axis=1)
            flat, who = keys.reshape(-1), np.repeat(members, keys.shape[1])
            order = np.argsort(flat, kind="stable")
            self.known[n] = flat[order], who[order]

    @staticmethod
    def keys_of(h: np.ndarray) -> np.ndarray:
        return pair_keys(h) if len(h) > 1 else h

    def edits(self, n: int) -> int:
        return math.floor((1 - self.similarity) * n + 1e-9)

    def need(self, n: int) -> int:
        """The fewest pairs of an item of n words in the right window."""
        return max(1, n - 1 - 2 * self.edits(n))

    def _walk(self, n: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The sampled steps and, for each step, the multiplier of which the top
        bit with the word moves the pointer, of repetition number of size n."""
        rng = np.random.default_rng([self.seed, n, number])
        steps = max(2 * self.samples, -(-2 * n // self.SCALES[number % len(self.SCALES)]))
        taken = np.sort(rng.choice(steps, self.samples, replace=False))
        return taken, rng.integers(0, 2**63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _plan(self, n: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """Walks (number, taken, multipliers) of either direction; as many as find
        the wanted share of simulated passages."""
        rng, e, trials = np.random.default_rng([self.seed, n]), self.edits(n), 100
        pairs = []
        for kind in range(3):
            for _ in range(trials):
                x = rng.integers(1, 2**62, n).astype(np.uint64)
                if kind == 0:
                    y = np.delete(x, rng.choice(n, e, replace=False))
                elif kind == 1:
                    y = np.insert(x, rng.integers(0, n + 1, e), rng.integers(1, 2**62, e).astype(np.uint64))
                else:
                    y = x.copy()
                    y[rng.choice(n, e, replace=False)] = rng.integers(1, 2**62, e).astype(np.uint64)
                pairs.append((x, y))
        ends = np.cumsum([0, *(len(y) for _, y in pairs)])
        xs, ys = (np.concatenate(c) for c in zip(*pairs, strict=True))
        at = np.arange(len(pairs)) * n
        plan: list[list] = [[], []]
        found, first, more = np.zeros(len(pairs), bool), 0, 2 * len(self.SCALES)
        while first < self.MOST:
            for way in (0, 1):
                some = [(k, *self._walk(n, 2 * len(self.SCALES) * k + k % len(self.SCALES) + way * len(self.SCALES))) for k in range(first, first + more)]
                plan[way] += some
                a = self._embed(xs, at, at + n, some, way)
                lo, hi = (ends[:-1], np.minimum(ends[:-1] + n, ends[1:])) if way == 0 else (np.maximum(ends[1:] - n, ends[:-1]), ends[1:])
                found |= (a == self._embed(ys, lo, hi, some, way)).any(axis=1)
            first += more
            more = first
            if found.reshape(3, trials).mean(axis=1).min() >= self.recall:
                break
        return plan

    def embed(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, way: int) -> np.ndarray:
        """Bucket keys (one per repetition) of the windows words[s:e] of items' size n."""
        return self._embed(words, starts, ends, self.walks[n][way], way)

    @staticmethod
    def _embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, walks: list, way: int) -> np.ndarray:
        padded = np.append(words, np.uint64(0))  # what a walk reads beyond its window
        walks = sorted(walks, key=lambda w: -len(w[2]))  # the longest first: those that still walk are a prefix
        shape = (len(walks), len(starts))
        pointer = np.broadcast_to(starts if way == 0 else ends - 1, shape).astype(np.int64)
        key = np.broadcast_to(np.array([2 * w[0] + way + 1 for w in walks], np.uint64)[:, None], shape).copy()
        longest = max((len(w[2]) for w in walks), default=0)
        odd, hit = np.zeros((len(walks), longest), np.uint64), np.zeros((len(walks), longest), bool)
        for k, (_, taken, odds) in enumerate(walks):
            odd[k, : len(odds)] = odds
            hit[k, taken] = True
        last = np.array([w[1].max() for w in walks])
        for j in range(longest):
            live = int(np.nonzero(last >= j)[0].max(initial=-1)) + 1
            if not live:
                break
            p = pointer[:live]
            symbol = padded[np.where(p < ends if way == 0 else p >= starts, p, len(words))]
            at = np.nonzero(hit[:live, j])[0]
            if len(at):
                key[at] = mix(key[at] * GOLDEN + symbol[at])
            move = ((symbol * odd[:live, j : j + 1]) >> np.uint64(63)).view(np.int64)
            if way == 0:
                p += move
            else:
                p -= move
        return key.T

    def pair_masks(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """At each word, the bits of the pair that begins there (0 at a text's end)."""
        out = np.zeros(len(h), np.uint64)
        if not len(self.pairs) or not len(h):
            return out
        keys = np.append(pair_keys(h), np.uint64(0))
        for x, last in ((keys, True), (h, False))[: 2 if self.lone else 1]:
            at = np.nonzero(self.quick[(x >> np.uint64(44)).astype(np.int64)])[0]
            where = np.minimum(np.searchsorted(self.pairs, x[at]), len(self.pairs) - 1)
            same = self.pairs[where] == x[at]
            got = np.zeros(len(h), np.uint64)
            got[at[same]] = self.pair_bits[where[same]]
            if last:
                got[bounds[1:][np.diff(bounds) > 0] - 1] = 0
            out |= got
        return out

    def windows(self, n: int, h: np.ndarray, masks: np.ndarray, hot: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the windows of n words, cut at their texts' ends, in
        which some item of that size has enough pairs: those for the walks from
        the start, then those for the walks from the end."""
        at = hot[(masks[hot] >> self.bit[n]) & np.uint64(1) == 1]
        need, reach = self.need(n), max(0, n - 2)
        none = np.zeros(0, np.int64)
        if len(at) < need:
            return none, none
        near = at[need - 1 :] - at[: len(at) - need + 1] <= reach  # pooled over items first, as that is cheap
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, np.nonzero(near)[0], 1)
        np.add.at(edge, np.nonzero(near)[0] + need, -1)
        at = at[np.cumsum(edge[:-1]) > 0]
        keys, who = self.holders[n]
        own = h[at] if n == 1 else mix(h[at] * GOLDEN + h[at + 1])
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        count = hi - lo
        item = who[_ranges(lo, count)]
        place = np.repeat(at, count)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        if len(item) < need:
            return none, none
        first, last = place[: len(place) - need + 1], place[need - 1 :]
        doc = np.searchsorted(bounds, first, "right") - 1
        good = (item[: len(first)] == item[need - 1 :]) & (last - first <= reach) & (last < bounds[doc + 1])
        first, last, doc = first[good], last[good], doc[good]
        low = np.maximum(last - reach, bounds[doc])
        starts = np.unique(_ranges(low, first - low + 1))
        low, high = np.minimum(last + min(n, 2), bounds[doc + 1]), np.minimum(first + n, bounds[doc + 1])
        return starts, np.unique(_ranges(low, high - low + 1))


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (count of them) for each row, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(low, count) if len(count) else np.zeros(0, np.int64)


def pair_keys(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * GOLDEN + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)


def _regions(near: list[tuple[int, int]], bounds: np.ndarray, n: int, e: int) -> Iterator[tuple[int, int, int, int]]:
    """(item, text, from, to): near windows of an item joined where they overlap."""
    now = None
    for k, start in near:
        doc = int(np.searchsorted(bounds, max(start, 0), "right")) - 1
        lo, hi = max(int(bounds[doc]), start - 2 * e), min(int(bounds[doc + 1]), start + n + 2 * e)
        if now and now[:2] == (k, doc) and lo <= now[3]:
            now = (k, doc, now[2], hi)
            continue
        if now:
            yield now
        now = (k, doc, lo, hi)
    if now:
        yield now


def search(bench: Benchmark, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For every text, (item, edits, start, n words) of each item that it holds.
    A text's answer does not depend on the other texts."""
    codes, distinct, bounds = coded([words_of(t) for t in texts])
    h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    masks = bench.pair_masks(h, bounds)
    hot = np.nonzero(masks)[0]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for n in sorted(bench.sizes) if len(hot) else ():
        e = bench.edits(n)
        known, who = bench.known[n]
        near: set[tuple[int, int]] = set()
        for way, edges in enumerate(bench.windows(n, h, masks, hot, bounds)):
            for a in range(0, len(edges), 1000):
                some = edges[a : a + 1000]
                if way == 0:
                    starts, ends = some, np.minimum(some + n, bounds[np.searchsorted(bounds, some, "right")])
                else:
                    starts, ends = np.maximum(some - n, bounds[np.searchsorted(bounds, some, "left") - 1]), some
                base, top = int(starts[0]), int(ends[-1])
                keys = bench.embed(h[base:top], starts - base, ends - base, n, way).reshape(-1)
                lo, hi = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                window = np.repeat(np.arange(len(keys)) // (len(keys) // len(some)), hi - lo)
                near.update(zip(who[_ranges(lo, hi - lo)].tolist(), starts[window].tolist(), strict=True))
        for k, doc, lo, hi in _regions(sorted(near), bounds, n, e):
            edits, begin, end = closest_window(bench.items[k][1], h[lo:hi])
            begin += lo - int(bounds[doc])
            if edits <= e and ((doc, k) not in found or (edits, begin) < found[doc, k][:2]):
                found[doc, k] = (edits, begin, end + lo - int(bounds[doc]) - begin)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for (doc, k), v in sorted(found.items()):
        out[doc].append((bench.items[k][0], *v))
    return out


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The benchmark in blocks of bounded size, and whether a block is the only
    one; the driver holds one block and one partition of items at a time."""
    block, size, first = [], 0, True
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if size > BLOCK_CHARS:
            yield block, False
            block, size, first = [], 0, False
        block.append((row[0], row[1] or ""))
        size += len(row[1] or "")
    yield block, first


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, edits, start_word, n_words: the closest passage of each
    item in each document, where its word edits are at most (1 - similarity)
    of the item's words.

    Null and empty texts and items match nothing; repeated rows each report, a
    null id as null; of equally close passages the first counts; texts of any
    length are searched whole; no documents or no items: no rows. Other columns
    are not read. The benchmark is broadcast in blocks of bounded size; where
    there are several, the matches of one are written before the next is read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = None
    for block, only in _blocks(items):
        shared = spark.sparkContext.broadcast(Benchmark(block, similarity))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_slices(texts, SLICE_CHARS):
                    found = [(ids[a + k], *x) for k, hits in enumerate(search(shared.value, texts[a:b])) for x in hits]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "item_id", "edits", "start_word", "n_words"])

        part = rows.mapInArrow(scan, "doc_id long, item_id long, edits long, start_word long, n_words long")
        if not only:
            part = stored(part, "matches")
            shared.unpersist()
        out = part if out is None else out.union(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of docs in which contaminated finds nothing, with all their columns.

    Null and empty texts are clean; repeated rows are each kept or dropped; no
    items: all rows are kept. Where the benchmark has several blocks, the rows
    that pass one are written before the next is read.
    """
    spark, names = docs.sparkSession, docs.columns
    for block, only in _blocks(items):
        shared = spark.sparkContext.broadcast(Benchmark(block, similarity))

        def passing(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            at = names.index(text_col)
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                for a, b in text_slices(texts, SLICE_CHARS):
                    clean = [not hits for hits in search(shared.value, texts[a:b])]
                    yield batch.slice(a, b - a).filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(passing, docs.schema)
        if not only:
            docs = stored(docs, "clean")
            shared.unpersist()
    return docs
