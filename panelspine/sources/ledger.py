"""Backfills whose units fail alone.

A ledger beside the data has one row per attempt at a unit: its state (done,
empty or failed), rows and error. All open units are processed as one job; where
that raises, they are halved by hash of the unit until the failing ones stand
alone, so that b bad units among n cost about b log n jobs and the others are
written. Data are committed unit by unit by dynamic partition overwrite: a run
that dies between data and ledger does the unit again without repeating rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .artifacts import kept, read_if_there, unfinished

#: Slices are halved no further than this: units of one hash then fail together.
FINEST = 2**40


def ledger(spark, path: str) -> DataFrame | None:
    """Attempts: unit, run, state, rows, error."""
    return read_if_there(spark, f"{path}/ledger")


def standing(spark, path: str, unit: list[str]) -> DataFrame:
    """unit, state and rows of its last attempt, attempts, its last error."""
    return ledger(spark, path).groupBy(*unit).agg(
        F.max_by("state", "run").alias("state"), F.max_by("rows", "run").alias("rows"), F.count(F.lit(1)).alias("attempts"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("run"))).alias("error")
    )


def backfill_units(planned: DataFrame, path: str, unit: list[str], process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Process the planned units that are not done yet; returns the holes: unit,
    state (failed or empty), rows, attempts, error.

    process gets a DataFrame of units (no NULLs) and returns rows with the unit's
    columns. Planned units may repeat; no planned units: nothing is done, and no
    holes. Data are at path/data, partitioned by unit. A failed or empty unit is
    tried again by the next run, done ones never.
    """
    spark = planned.sparkSession
    seen = ledger(spark, path)
    run = 1 if seen is None else (seen.agg(F.max("run")).first()[0] or 0) + 1
    done = None if seen is None else seen.where("state = 'done'")
    todo = kept(unfinished(planned.select(*unit).distinct(), done, unit), "units")
    slices = [(1, 0)]

    def note(rows: DataFrame) -> None:
        rows.select(*unit, F.lit(run).alias("run"), "state", F.col("rows").cast("long").alias("rows"), F.col("error").cast("string").alias("error")).write.mode("append").parquet(f"{path}/ledger")

    note(todo.limit(0).withColumns({"state": F.lit(""), "rows": F.lit(0), "error": F.lit("")}))
    while slices:
        parts, k = slices.pop()
        some = todo.where(F.pmod(F.xxhash64(*unit), F.lit(parts)) == k)
        n = some.limit(2).count()
        if not n:
            continue
        try:
            process(some).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*unit).parquet(f"{path}/data")
        except Exception as e:  # whatever a unit raises is a row of the ledger
            if n == 1 or parts >= FINEST:
                note(some.withColumns({"state": F.lit("failed"), "rows": F.lit(0), "error": F.lit(f"{type(e).__name__}: {e}"[:500])}))
            else:
                slices += [(2 * parts, k), (2 * parts, k + parts)]
            continue
        data = read_if_there(spark, f"{path}/data")
        if data is None:
            counted = some.withColumn("rows", F.lit(0))
        else:
            counted = some.join(data.groupBy(*unit).agg(F.count(F.lit(1)).alias("rows")), unit, "left").fillna(0, ["rows"])
        note(counted.withColumns({"state": F.when(F.col("rows") > 0, "done").otherwise("empty"), "error": F.lit(None)}))
    return standing(spark, path, unit).where("state <> 'done'").join(planned.select(*unit).distinct(), unit, "left_semi")
