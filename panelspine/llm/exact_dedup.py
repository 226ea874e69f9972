"""Exact duplicates: texts that are identical without white space.

Rows are grouped by a 128-bit hash of the normalised text. Rows of one hash are
then held against each other byte by byte, in one aggregate whose keys are hash
and text: a hash with two texts is a collision, and its rows are numbered by
text. Of each group the row with the longest original text stays, then the one
with the least id. Texts are shuffled once, each different one once per task at
most; all else moves hashes alone.

A group that holds more than one in HOT of all rows is one of fewer than HOT:
such groups reach the rows by a broadcast of that proven size. What is left for
the shuffled join has no hot key. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Groups with more than 1 / HOT of all rows are broadcast: fewer than HOT rows.
HOT = 1000


def normalised(text: Column) -> Column:
    """text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def content_hash(text: Column) -> Column:
    """128 bits of a normalised text."""
    return F.unhex(F.md5(text.cast("binary")))


def _grouped(docs: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): one row per row of docs with its group (key, variant), and
    one row per group with its size n and its best row."""
    original = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.length(original).alias("chars"), normalised(F.col(text_col)).alias("norm"))
    texts = texts.withColumn("key", hash_of(F.col("norm")))
    slim = lambda df, variant: df.select("id", "key", variant.alias("variant"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "chars", F.monotonically_increasing_id().alias("row"))
    rows = stored(slim(texts, F.lit(0)), "exact-rows")
    collided = texts.select("key", "norm").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key")
    collided = stored(collided, "exact-collisions")
    if not collided.isEmpty():
        own = Window.partitionBy("key").orderBy("norm")
        numbered = texts.select("key", "norm").join(collided, "key", "left_semi").distinct().withColumn("variant", F.row_number().over(own))
        apart = stored(slim(texts.join(numbered, ["key", "norm"]), F.col("variant")), "exact-collided-rows")
        rows = rows.join(collided, "key", "left_anti").select(*apart.columns).union(apart)
    best = F.min(F.struct((-F.col("chars")).alias("less"), "id", "row")).alias("best")
    return rows, stored(rows.groupBy("key", "variant").agg(F.count(F.lit(1)).alias("n"), best), "exact-groups")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id (id of the row that stays), group_size, kept and
    text_sha256 of the normalised text: one row per row of docs.

    Null texts, empty ones and ones of white space are one group. A null id is
    less than all others. Of repeated rows (same id and text) exactly one can
    be kept. Texts of any length are compared whole; other columns are not
    looked at, whatever their names; no rows: no rows. hash_of may be any
    function of the normalised text: groups stay exact, as texts are compared.
    """
    rows, groups = _grouped(docs, id_col, text_col, hash_of)
    total = rows.count()
    hot = F.col("n") * HOT > F.lit(total)
    found = groups.select("key", "variant", "n", "best", hot.alias("hot"))
    large = F.broadcast(found.where("hot").drop("hot"))
    by_size = [rows.join(large, ["key", "variant"]), rows.join(large, ["key", "variant"], "left_anti").join(found.where("not hot").drop("hot"), ["key", "variant"])]
    out = [
        df.select(
            F.col("id").alias("doc_id"),
            F.col("best.id").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("row") == F.col("best.row")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
        for df in by_size
    ]
    return out[0].union(out[1])

