"""Queries on artifacts that know their inputs and on backfills whose units fail alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import artifacts as A
from ..sources import ledger as B
from ..sources import versions as S
from .registry import query


def _counts(given):
    return given["records"].groupBy("season_year", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def _rebuilt(t):
    """Two builds; in the second the records of one year differ in one column of some rows."""
    path, cols = A.scratch_path(t.spark, "by-year"), ["id", "season_year", "place", "size"]
    first = t.records.select(*cols)
    second = first.withColumn("size", F.when((F.col("season_year") == 1997) & (F.col("size") > 400000), 0.0).otherwise(F.col("size")))
    S.build_versioned(t.spark, path, {"records": first}, _counts, ["season_year"], "1")
    old = S.manifest(t.spark, path).select("built").distinct()
    now = S.build_versioned(t.spark, path, {"records": second}, _counts, ["season_year"], "1")
    return now.join(old.withColumn("kept", F.lit(True)), "built", "left").select("season_year", "place", "n", "size", F.col("kept").isNull().alias("rebuilt"))


query(
    "s08_changed_units",
    _rebuilt,
    "SELECT season_year, place, count(*) AS n, sum(CASE WHEN season_year = 1997 AND size > 400000 THEN 0 ELSE size END) AS size, season_year = 1997 AS rebuilt FROM records GROUP BY ALL",
    "size",
)


def _failing(t):
    """Two runs: in the first, two years raise and one has no rows; in the second none."""
    path, planned = A.scratch_path(t.spark, "units"), t.records.select("season_year").distinct()

    def process(todo, bad):
        rows = t.records.join(todo, "season_year", "left_semi").groupBy("season_year", "place").agg(F.count(F.lit(1)).alias("n"))
        year = F.col("season_year")
        failing = F.when(year.isin(1996, 1998) & (F.col("n") > 0), F.raise_error(F.concat(F.lit("no source for "), year.cast("string")))).otherwise(year != 2000)
        return rows.where(failing) if bad else rows

    B.backfill_units(planned, path, ["season_year"], lambda todo: process(todo, True))
    B.backfill_units(planned, path, ["season_year"], lambda todo: process(todo, False))
    data = t.spark.read.parquet(f"{path}/data").groupBy("season_year").agg(F.sum("n").alias("n"))
    return B.standing(t.spark, path, ["season_year"]).join(data, "season_year").select("season_year", "state", "attempts", "rows", "n", F.col("error").isNotNull().alias("failed_once"))


query(
    "s07_failing_units",
    _failing,
    "SELECT season_year, 'done' AS state, CASE WHEN season_year IN (1996, 1998, 2000) THEN 2 ELSE 1 END::BIGINT AS attempts, count(DISTINCT place) AS rows, count(*) AS n, season_year IN (1996, 1998) AS failed_once FROM records GROUP BY ALL",
)
