"""Versioned artifacts and ledgers: what is rebuilt, and what a failure leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelspine.sources import artifacts, ledger, versions

COLUMNS = "year int, place string, v double"
ROWS = [(1, "a", 1.0), (1, "a", 1.0), (1, "b", None), (2, "a", 2.0), (3, None, 5.0)]


def sums(given):
    return given["r"].groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


def build(spark, path, rows, fn=sums, version="1", **more):
    return versions.build_versioned(spark, path, {"r": spark.createDataFrame(rows, COLUMNS), **more}, fn, ["year"], version)


def got(df):
    return sorted((r["year"], r["n"], r["v"]) for r in df.collect())


def test_only_changed_units_are_built(spark):
    path, seen = artifacts.scratch_path(spark, "v"), []

    def watched(given):
        seen.append(sorted(r["year"] for r in given["r"].select("year").distinct().collect()))
        return sums(given)

    assert got(build(spark, path, ROWS, watched)) == [(1, 3, 2.0), (2, 1, 2.0), (3, 1, 5.0)]
    build(spark, path, list(reversed(ROWS)), watched)  # order does not count
    assert seen == [[1, 2, 3]]
    assert got(build(spark, path, [*ROWS[1:], (4, "x", 7.0)], watched)) == [(1, 2, 1.0), (2, 1, 2.0), (3, 1, 5.0), (4, 1, 7.0)]  # a repeated row less, a new unit
    assert got(build(spark, path, ROWS[:4], watched)) == [(1, 3, 2.0), (2, 1, 2.0)]  # units that are gone
    build(spark, path, ROWS[:4], watched, version="2")
    assert seen[1:] == [[1, 4], [1], [1, 2]]
    extra = spark.createDataFrame([(9,)], "w int")
    build(spark, path, ROWS[:4], watched, version="2", side=extra)  # an input of all units
    assert seen[4:] == [[1, 2]]


def test_an_interrupted_build_leaves_the_old_one(spark):
    path = artifacts.scratch_path(spark, "v")
    build(spark, path, ROWS)
    with pytest.raises(Exception, match="cut off"):
        build(spark, path, [(1, "a", 9.0)], lambda given: sums(given).withColumn("n", F.raise_error(F.lit("cut off")).cast("long")))
    assert got(versions.read_versioned(spark, path)) == [(1, 3, 2.0), (2, 1, 2.0), (3, 1, 5.0)]
    assert got(build(spark, path, [(1, "a", 9.0)])) == [(1, 1, 9.0)]


def test_no_input_rows(spark):
    path = artifacts.scratch_path(spark, "v")
    assert versions.read_versioned(spark, path) is None
    assert build(spark, path, []) is None
    assert got(build(spark, path, ROWS[:1])) == [(1, 1, 1.0)]


def test_fingerprints_tell_nulls_and_places(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "null", 1.0)]
    prints = versions.fingerprints(spark.createDataFrame(rows, COLUMNS).withColumn("u", F.col("year")).withColumn("year", F.lit(0)), ["u"]).collect()
    assert len({r["print"] for r in prints}) == 3


def test_units_fail_alone(spark):
    path = artifacts.scratch_path(spark, "l")
    planned = spark.range(20).select(F.col("id").cast("int").alias("u"))
    tried = []

    def process(todo, bad):
        tried.append(sorted(r["u"] for r in todo.collect()))
        rows = todo.where("u <> 7" if bad else "true").select("u", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))
        return rows.withColumn("x", F.when(F.col("u").isin(3, 11), F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("x"))) if bad else rows

    holes = ledger.backfill_units(planned.union(planned), path, ["u"], lambda todo: process(todo, True)).collect()
    assert {(r["u"], r["state"], r["attempts"]) for r in holes} == {(3, "failed", 1), (11, "failed", 1), (7, "empty", 1)}
    assert all("broken" in r["error"] for r in holes if r["state"] == "failed")
    assert len(tried) <= 1 + 2 * 2 * 12
    data = spark.read.parquet(f"{path}/data")
    assert data.count() == 17 * 2
    tried.clear()
    assert ledger.backfill_units(planned, path, ["u"], lambda todo: process(todo, False)).count() == 0
    assert tried == [[3, 7, 11]]
    assert spark.read.parquet(f"{path}/data").groupBy("u").count().where("count <> 2").count() == 0
    assert spark.read.parquet(f"{path}/data").count() == 40
    assert ledger.backfill_units(planned.limit(0), path, ["u"], lambda todo: process(todo, True)).count() == 0


def test_two_way_table_and_spreads(spark):
    from panelspine.operators import describe

    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 4.0), ("b", "x", 6.0), ("b", None, 0.0)], "r string, c string, v double")
    table = {(x["r"], x["c"]): (x["n"], x["mean"]) for x in describe.two_way(df, "r", "c", "v").collect()}
    assert table == {("a", "x"): (2, 2.0), ("a", "y"): (1, 4.0), ("b", "x"): (1, 6.0), ("b", None): (1, 0.0), ("a", "all"): (3, 8 / 3), ("b", "all"): (2, 3.0), ("all", "x"): (3, 10 / 3), ("all", "y"): (1, 4.0), ("all", None): (1, 0.0), ("all", "all"): (5, 2.8)}
    one = describe.spreads(describe.two_way(df.where("c is not null"), "r", "c", "v"), "r", "c").first()
    assert (one["down"], one["across"]) == ((3.0 + 1.0) / 2, (2.0 + 1.0) / 2)
