"""Token-id files in patched frame-of-reference blocks.

A shard file holds the ids of a contiguous range of documents as one stream,
cut into blocks of 128 ids. From each block its minimum is subtracted; the
offsets are packed at the bit width that the chosen percentile of them needs;
the high bits of the others (the exceptions) go to a list with their places in
the block. Blocks are gathered in segments of at most ``SEGMENT`` ids:

    segment: n_ids, n_blocks, n_words, n_exceptions   (4 x uint32)
             block minimum            uint32[n_blocks]
             block start in words     uint32[n_blocks]
             block's first exception  uint32[n_blocks]
             width                    uint8[n_blocks]
             packed offsets           uint64[n_words]
             exception places         uint8[n_exceptions]
             exception high bits      uint32[n_exceptions]
    footer:  segment starts uint64[], segment first ids uint64[],
             doc ids int64[], null flags uint8[], doc lengths uint64[]
    tail:    n_segments, n_docs, footer start (3 x uint64), magic

So any range of ids is read from the footer, one segment header and the blocks
that it touches. Files are written under a temporary name and renamed, so a
task that runs twice leaves the same file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, shuffle_partitions, stored

MAGIC = b"PFORTOK1"
BLOCK = 128
SEGMENT = 8192 * BLOCK


# --------------------------------------------------------------------------
# blocks


def encode_segment(ids: np.ndarray, percentile: int = 90) -> bytes:
    """One segment's bytes. ids: uint32, at most SEGMENT of them, may be empty."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n_blocks and n % BLOCK:
        padded[n:] = ids[(n_blocks - 1) * BLOCK :].min()
    v = padded.reshape(n_blocks, BLOCK)
    low = v.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    d = v - low[:, None]
    k = min(BLOCK - 1, max(0, -(-BLOCK * percentile // 100) - 1))
    at = np.partition(d, k, axis=1)[:, k] if n_blocks else np.zeros(0, np.uint32)
    width = np.frexp(at.astype(np.float64))[1].astype(np.uint8)  # bits of the percentile
    starts = np.zeros(n_blocks + 1, np.int64)
    np.cumsum(2 * width.astype(np.int64), out=starts[1:])
    words = np.zeros(starts[-1], np.uint64)
    over = (d.astype(np.uint64) >> width[:, None].astype(np.uint64)) != 0
    row, place = np.nonzero(over)
    high = (d[row, place].astype(np.uint64) >> width[row].astype(np.uint64)).astype(np.uint32)
    first = np.zeros(n_blocks, np.uint32)
    if n_blocks:
        first[1:] = np.cumsum(over.sum(axis=1))[:-1]
    for w in np.unique(width):
        if not w:
            continue
        w = int(w)
        rows = np.nonzero(width == w)[0]
        cols = np.ascontiguousarray((d[rows] & np.uint32((1 << w) - 1)).T).astype(np.uint64)
        out = np.zeros((2 * w, len(rows)), np.uint64)
        for i in range(BLOCK):
            word, off = divmod(i * w, 64)
            out[word] |= cols[i] << np.uint64(off)
            if off + w > 64:
                out[word + 1] |= cols[i] >> np.uint64(64 - off)
        words[starts[rows][:, None] + np.arange(2 * w)] = out.T
    return b"".join(
        (
            struct.pack("<4I", n, n_blocks, len(words), len(high)),
            low.astype("<u4").tobytes(),
            starts[:-1].astype("<u4").tobytes(),
            first.astype("<u4").tobytes(),
            width.tobytes(),
            words.astype("<u8").tobytes(),
            place.astype(np.uint8).tobytes(),
            high.astype("<u4").tobytes(),
        )
    )


def decode_segment(data: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids lo..hi-1 of a segment; only the blocks that they touch are unpacked."""
    n, n_blocks, n_words, n_exc = struct.unpack_from("<4I", data)
    at = 16
    low = np.frombuffer(data, "<u4", n_blocks, at)
    starts = np.frombuffer(data, "<u4", n_blocks, at := at + 4 * n_blocks)
    first = np.frombuffer(data, "<u4", n_blocks, at := at + 4 * n_blocks)
    width = np.frombuffer(data, np.uint8, n_blocks, at := at + 4 * n_blocks)
    words = np.frombuffer(data, "<u8", n_words, at := at + n_blocks)
    place = np.frombuffer(data, np.uint8, n_exc, at := at + 8 * n_words)
    high = np.frombuffer(data, "<u4", n_exc, at + n_exc)
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.uint32)
    b0, b1 = lo // BLOCK, -(-hi // BLOCK)
    low, starts, width = low[b0:b1], starts[b0:b1].astype(np.int64), width[b0:b1]
    e0, e1 = int(first[b0]), int(first[b1]) if b1 < n_blocks else n_exc
    d = np.zeros((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        w = int(w)
        rows = np.nonzero(width == w)[0]
        cols = np.ascontiguousarray(words[starts[rows][:, None] + np.arange(2 * w)].T)
        out = np.empty((BLOCK, len(rows)), np.uint32)
        mask = np.uint64((1 << w) - 1)
        for i in range(BLOCK):
            word, off = divmod(i * w, 64)
            x = cols[word] >> np.uint64(off)
            if off + w > 64:
                x |= cols[word + 1] << np.uint64(64 - off)
            out[i] = x & mask
        d[rows] = out.T
    if e1 > e0:
        counts = np.diff(np.append(first[b0:b1].astype(np.int64), e1))
        row = np.repeat(np.arange(b1 - b0), counts)
        d[row, place[e0:e1]] |= (high[e0:e1].astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    d += low[:, None]
    return d.reshape(-1)[lo - b0 * BLOCK : hi - b0 * BLOCK]


class ShardWriter:
    """Streams documents into one shard file."""

    def __init__(self, stream, percentile: int = 90):
        self.stream, self.percentile = stream, percentile
        self.stream.write(MAGIC)
        self.at, self.n_ids = len(MAGIC), 0
        self.segments: list[tuple[int, int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian uint32."""
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= SEGMENT:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        stop = len(ids) if last else len(ids) // SEGMENT * SEGMENT
        for a in range(0, stop, SEGMENT):
            part = ids[a : min(a + SEGMENT, stop)]
            data = encode_segment(part, self.percentile)
            self.segments.append((self.at, self.n_ids))
            self.stream.write(data)
            self.at += len(data)
            self.n_ids += len(part)
        self.waiting, self.n_waiting = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        foot = self.at
        for a, kind in (
            ([s for s, _ in self.segments], "<u8"),
            ([i for _, i in self.segments], "<u8"),
            ([0 if d is None else d for d in self.docs], "<i8"),
            ([d is None for d in self.docs], np.uint8),
            (self.lengths, "<u8"),
        ):
            self.stream.write(np.array(a, kind).tobytes())
        self.stream.write(struct.pack("<3Q", len(self.segments), len(self.docs), foot) + MAGIC)


class ShardReader:
    """Reads a shard file by its indexes. file: a seekable binary file."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 32)
        tail = file.read(32)
        if tail[24:] != MAGIC:
            raise ValueError("not a complete token shard")
        n_seg, n_docs, self.foot = struct.unpack("<3Q", tail[:24])
        file.seek(self.foot)
        data = file.read(size - 32 - self.foot)
        self.seg_at = np.frombuffer(data, "<u8", n_seg, 0).astype(np.int64)
        self.seg_first = np.frombuffer(data, "<u8", n_seg, 8 * n_seg).astype(np.int64)
        self.docs = np.frombuffer(data, "<i8", n_docs, 16 * n_seg)
        self.null = np.frombuffer(data, np.uint8, n_docs, 16 * n_seg + 8 * n_docs)
        self.lengths = np.frombuffer(data, "<u8", n_docs, 16 * n_seg + 9 * n_docs).astype(np.int64)
        self.n_ids = int(self.lengths.sum())

    def segment(self, k: int) -> bytes:
        stop = int(self.seg_at[k + 1]) if k + 1 < len(self.seg_at) else self.foot
        self.file.seek(int(self.seg_at[k]))
        return self.file.read(stop - int(self.seg_at[k]))

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi-1 of the shard."""
        out, k = [], int(np.searchsorted(self.seg_first, lo, "right")) - 1
        while lo < hi:
            first = int(self.seg_first[k])
            stop = int(self.seg_first[k + 1]) if k + 1 < len(self.seg_first) else self.n_ids
            out.append(decode_segment(self.segment(k), lo - first, min(hi, stop) - first))
            lo, k = stop, k + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc id, start, length, crc32 of its ids), in the file's order; one
        segment is held at a time."""
        k, ids, first, start = -1, np.zeros(0, np.uint32), 0, 0
        for doc, null, n in zip(self.docs.tolist(), self.null.tolist(), self.lengths.tolist(), strict=True):
            crc, at = 0, start
            while at < start + n:
                if at >= first + len(ids):
                    k += 1
                    first, ids = int(self.seg_first[k]), decode_segment(self.segment(k)).astype("<u4")
                stop = min(start + n, first + len(ids))
                crc = zlib.crc32(ids[at - first : stop - first], crc)
                at = stop
            yield None if null else doc, start, n, crc
            start += n


# --------------------------------------------------------------------------
# tokenizing

#: The pre-tokenizer's pattern, and byte values that byte-level
#: vocabularies write as themselves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


#: The steps before the model for which chunks can be looked up.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordTokenizer:
    """The ids of a text, by the tokenizers library, one distinct word at a time.

    Ids of a text are those of its white-space-separated chunks one after the
    other, as this kind of vocabulary drops white space and never joins across
    it, so chunks and their pieces are looked up in bounded caches first. That
    is exact for texts in Latin and Cyrillic letters without control characters,
    special tokens, separators that only Python counts as space, or combining
    marks; any other text, and every text where the file names other steps than
    NORMALIZER and PRE_TOKENIZER, is encoded as a whole.
    """

    LIMIT = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        self.known = steps["normalizer"] == NORMALIZER and steps["pre_tokenizer"] == PRE_TOKENIZER and steps["post_processor"] is None and all(t["content"].startswith("<|") for t in steps["added_tokens"])
        self.model = self.whole.model
        spare = iter(range(256, 512))
        self.table = {b: (b if b in OWN_BYTES else next(spare)) for b in range(256)}
        self.find = regex.compile(PIECES).findall
        self.odd = re.compile("<\\||[^\t-\r -~\xa0-įı-ɏЀ-҂Ҋ-ԯ‐-‧‰-⁞€]").search
        self.pieces: dict[str, bytes] = {}
        outer = self

        class Chunks(dict):
            def __missing__(self, chunk):
                ids = b"".join([outer.piece(p) for p in outer.find(chunk)])
                if len(chunk) <= 48:
                    if len(self) >= outer.LIMIT:
                        self.clear()
                    self[chunk] = ids
                return ids

        self.chunks = Chunks()

    def piece(self, p: str) -> bytes:
        ids = self.pieces.get(p)
        if ids is None:
            mapped = p if p.isascii() else p.encode().decode("latin-1").translate(self.table)
            ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(p) <= 48:
                if len(self.pieces) >= self.LIMIT:
                    self.pieces.clear()
                self.pieces[p] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.known or self.odd(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


    def count(self, text: str) -> int:
        return len(self(text)) // 4


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, with its caches."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


# --------------------------------------------------------------------------
# the operator


def arrow_uri(path: str) -> str:
    """A path with a Hadoop scheme as pyarrow names it."""
    return re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path))


def _open(path: str):
    return pafs.FileSystem.from_uri(arrow_uri(path))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would give it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def write_token_shards(docs: DataFrame, out: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, percentile: int = 90, shards: int | None = None) -> DataFrame:
    """Encode documents and write their ids, ascending by id, to shard files in out.

    Returns the manifest: shard, path, n_docs, n_ids, first_id (ids in all
    shards before it), one row per shard that has documents.

    The only shuffle is the range partitioning by id. A null text counts as
    empty and yields the end id alone; null ids come first; rows of equal id
    follow each other by a hash of the text and may span shards, as may equal
    rows, so that no id makes a shard large; texts of any length are encoded
    whole; other columns are not read. No rows: no files. A path without a
    scheme is on Spark's default file system.
    """
    spark = docs.sparkSession
    out = qualified(spark, out)
    n = shards or max(shuffle_partitions(spark), -(-docs.count() // 65_536))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "copy": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, "doc", "hash", "copy").sortWithinPartitions("doc", "hash", "text").select("doc", "text")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encode = word_tokenizer(tokenizer)
                shard = TaskContext.get().partitionId()
                fs, folder = _open(out)
                fs.create_dir(folder, recursive=True)
                name = f"{folder}/shard-{shard:07d}.pfor"
                temp = f"{folder}/_{shard:07d}-{uuid.uuid4().hex}"
                stream = fs.open_output_stream(temp)
                writer = ShardWriter(stream, percentile)
            texts = batch.column(1)
            for k, doc in enumerate(batch.column(0).to_pylist()):
                writer.add(doc, encode(texts[k].as_py()) + end)
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(temp, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{out}/shard-{shard:07d}.pfor"], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    written = stored(rows.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return written.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_shards(manifest: DataFrame, parallel: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = _open(row["path"])
                with fs.open_input_file(name) as f:
                    docs = list(ShardReader(f, fs.get_file_info(name).size).documents())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d[0] for d in docs], pa.int64()),
                        pa.array([row["first_id"] + d[1] for d in docs], pa.int64()),
                        pa.array([d[2] for d in docs], pa.int64()),
                        pa.array([d[3] for d in docs], pa.int64()),
                        pa.array([row["shard"]] * len(docs), pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    spread = manifest.repartition(parallel, "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_blocks(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write documents as token shards in the shared folder and read them back.

    Empty input gives no rows; see write_token_shards for nulls and ties.
    """
    spark = docs.sparkSession
    manifest = write_token_shards(docs, fresh_path(spark, "tokens"), tokenizer, **options)
    return read_token_shards(stored(manifest, "manifest-starts"), shuffle_partitions(spark))
