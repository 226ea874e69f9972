"""Shared helpers: places for intermediate tables, and cheap text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (spark.checkpoint.dir).

    A folder of its own is made only where the setting is absent and the master
    is local, which is the case in single-machine tests; on a cluster without
    the setting this fails, as executors do not share their disks.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="panelspine-")
    return _OWN_ROOTS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/panelspine/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows is read again from the files after the loss
    of an executor instead of being computed again.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it while df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fetch(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_of(doc_id):
    """crc32 of the id's decimal text modulo 4; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def is_held_out(doc_id):
    return fold_of(doc_id) == 2


def bounded_texts(rows: DataFrame, label: str, most_chars: int) -> list[tuple]:
    """Sorted (label, text) of few rows (doc_id, label, text), taken by ascending
    id hash until most_chars characters are reached: lengths are looked at
    before any text comes to the driver."""
    sizes = rows.select("doc_id", label, F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", label).collect()
    keep, size = [], 0
    for r in sizes:
        if size + r["n"] <= most_chars:
            keep.append((r["doc_id"], r[label]))
            size += r["n"]
    if len(keep) < len(sizes):
        kinds = dict(rows.dtypes)
        wanted = rows.sparkSession.createDataFrame(keep, f"chosen {kinds['doc_id']}, of {kinds[label]}")
        rows = rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col(label) == F.col("of")), "left_semi")
    return sorted((r[label], r["text"]) for r in rows.select(label, "text").collect())


def text_slices(texts: list[str], max_chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with about max_chars characters at most; a
    longer text has a range of its own. Bounds memory, drops nothing."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and size + n > max_chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
