"""Artifacts keyed by the content of their inputs.

Below an artifact's path, ``data/built=<id>/<unit>=.../`` holds the rows of units
as one build wrote them, and ``manifest/<number>`` holds one row per unit: the
fingerprint of all that it was made from and the build that holds its rows. A
build rewrites the units whose fingerprint changed and publishes a manifest last.
Readers take the newest finished manifest, so an interrupted build leaves what
was there readable, and two builds that publish at once do not mix: the number is
taken by the first, the second fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .artifacts import kept


def fingerprints(df: DataFrame, unit: list[str]) -> DataFrame:
    """unit, rows and two order-free sums over all columns: one row per unit.

    Sums of two independent hashes are taken as decimals, so that repeated rows
    count and nothing overflows; NULLs are told from their neighbours by place.
    """
    cols = sorted(df.columns)
    text = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
    wide = lambda seed: F.xxhash64(F.lit(seed), text).cast(T.DecimalType(20, 0))
    sums = df.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows"), F.sum(wide(1)).alias("a"), F.sum(wide(2)).alias("b"))
    return sums.select(*unit, F.concat_ws(":", F.lit(",".join(cols)), "rows", "a", "b").alias("print"))


def wanted(inputs: dict[str, DataFrame], unit: list[str], version: str) -> DataFrame:
    """unit, print: one digest per unit over all inputs, and version (the code's
    and its parameters'). An input without the unit's columns counts for all units."""
    parts, whole = [], []
    for name, df in sorted(inputs.items()):
        if set(unit) <= set(df.columns):
            parts.append(fingerprints(df, unit).select(*unit, F.concat(F.lit(f"{name}="), "print").alias("p")))
        else:
            whole.append(f"{name}={fingerprints(df, []).first()['print']}")
    every = reduce(DataFrame.unionByName, parts).groupBy(*unit).agg(F.sort_array(F.collect_list("p")).alias("p"))  # one element per input
    return every.select(*unit, F.sha2(F.concat_ws("|", F.lit(version), *map(F.lit, whole), F.array_join("p", "|")), 256).alias("print"))


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished manifests, in ascending order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/*/_SUCCESS")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return sorted(int(x.getPath().getParent().getName()) for x in found or [])


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """unit, print, built of the newest finished manifest; None before the first."""
    numbers = _finished(spark, path)
    return spark.read.parquet(f"{path}/manifest/{numbers[-1]}") if numbers else None


def _same(a: DataFrame, b: DataFrame, unit: list[str]) -> Column:
    return reduce(and_, [a[c].eqNullSafe(b[c]) for c in unit])


def read_versioned(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the published units, with built, the build that wrote them."""
    listed = manifest(spark, path)
    if listed is None:
        return None
    builds = [r["built"] for r in listed.select("built").distinct().collect()]  # one per build that is still in use
    unit = [c for c in listed.columns if c not in ("print", "built")]
    parts = []
    for b in builds:
        rows = spark.read.parquet(f"{path}/data/{b}")
        mine = listed.where(F.col("built") == b).select(*unit)
        parts.append(rows.join(mine, _same(rows, mine, unit), "left_semi").withColumn("built", F.lit(b)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def build_versioned(spark: SparkSession, path: str, inputs: dict[str, DataFrame], build: Callable[[dict[str, DataFrame]], DataFrame], unit: list[str], version: str) -> DataFrame:
    """The artifact at path, of which only units with changed inputs are built.

    build gets the inputs, cut to those units where they have the unit's columns,
    and returns rows with these columns. A unit that is no longer in any input is
    no longer listed. version names the code and its parameters: another version
    builds all. No input rows: no rows are listed.
    """
    prints = kept(wanted(inputs, unit, version), "prints")
    old = manifest(spark, path)
    if old is None:
        stale, fresh = prints, None
    else:
        hit = _same(prints, old, unit) & (prints["print"] == old["print"])
        stale, fresh = prints.join(old, hit, "left_anti"), old.join(prints, hit, "left_semi")
    name = uuid.uuid4().hex
    if not stale.isEmpty():
        todo = stale.select(*unit)
        cut = {k: df.join(todo, _same(df, todo, unit), "left_semi") if set(unit) <= set(df.columns) else df for k, df in inputs.items()}
        build(cut).repartition(*unit).write.parquet(f"{path}/data/{name}")
    rows = stale.select(*unit, "print", F.lit(name).alias("built"))
    rows = rows if fresh is None else rows.unionByName(fresh.select(*unit, "print", "built"))
    number = (_finished(spark, path) or [0])[-1] + 1
    rows.write.mode("error").parquet(f"{path}/manifest/{number}")
    return read_versioned(spark, path)
