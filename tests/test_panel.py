"""Hand-built frames with known answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspine.config import PanelConfig
from panelspine.functions import hexgrid, metrics, spine
from panelspine.operators import clean, covariates, grain, ranks, score, spatial, trailing
from panelspine.operators import contracts
from panelspine.sources import artifacts

CFG = PanelConfig(base_year=1992, partial_seasons=(0, 116), last_idx=116, test_start=2010, sentinel="Missing", natural="Natural", human=("Arson", "Other"))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_trailing_skips_gaps_and_itself(spark):
    # Inputs with known results, FIXTURES.md part B, "two_series".
    data = [("A", 2, 1.0), ("A", 10, 2.0), ("A", 14, 3.0), ("B", 2, 10.0), ("B", 6, 20.0), ("B", 10, 30.0)]
    df = spark.createDataFrame(data, "s string, season_idx int, v double")
    got = df.withColumn("p", trailing.trailing_mean("v", ["s"], 3)).withColumn("t4", trailing.exact_step("v", ["s"]))
    assert rows(got, "s", "season_idx", "p", "t4") == sorted([("A", 2, None, None), ("A", 10, 1.0, None), ("A", 14, 1.5, 2.0), ("B", 2, None, None), ("B", 6, 10.0, 10.0), ("B", 10, 15.0, 20.0)], key=str)
    both = got.join(trailing.audit(df, "v", ["s"], 3), ["s", "season_idx"], "left").where("not (p <=> mean)")
    assert both.count() == 0


def test_exclusion(spark):
    # Inputs with known results, FIXTURES.md part B, "exclusion".
    df = spark.createDataFrame([(1, "PR", None), (2, "HI", None), (3, "CA", "IA"), (4, "PR", "IA"), (5, "AK", None), (6, "TX", "X"), (7, "OR", None)], "id int, state string, agency string").withColumn("size", F.lit(1.0))
    assert rows(clean.exclude(df, ["PR", "HI"], "IA"), "id") == [(5,), (6,), (7,)]
    a = clean.exclusion_account(df, ["PR", "HI"], "IA").first()
    assert (a["dropped"], a["by_both"]) == (4, 1)


def test_december_and_boundaries(spark):
    # Inputs with known results, FIXTURES.md part B, "December rule, boundary winters".
    df = spark.createDataFrame([("2005-12-15",), ("2006-01-15",), ("2006-02-28",), ("1992-01-01",), ("2020-12-31",)], "d string").withColumn("d", F.to_date("d"))
    got = {str(r["d"]): r for r in spine.with_spine(df, "d", 1992).collect()}
    assert {(got[d]["season"], got[d]["season_year"], got[d]["season_idx"]) for d in ("2005-12-15", "2006-01-15", "2006-02-28")} == {("DJF", 2006, 56)}
    assert (got["1992-01-01"]["season_idx"], got["2020-12-31"]["season_idx"]) == (0, 116)


def test_mixed_dates(spark):
    # Inputs with known results, FIXTURES.md part B, "mixed dates".
    df = spark.createDataFrame([("2000-02-29",), ("3/15/2001",), ("2001-06-01 00:00:00",)], "d string")
    assert sorted(str(r[0]) for r in spine.require_dates(df, "d").collect()) == ["2000-02-29", "2001-03-15", "2001-06-01"]
    with pytest.raises(ValueError, match="1 values"):
        spine.require_dates(spark.createDataFrame([("not a date",)], "d string"), "d")


def geo(spark):
    # Inputs with known results, FIXTURES.md part B, "geo_fires".
    data = [("R1", "Natural", 100.0), ("R1", "Arson", 40.0), ("R1", "Missing", 25.0), ("R2", "Arson", 30.0), ("R3", "Missing", 500.0)]
    return spark.createDataFrame(data, "place string, category string, size double").select("*", F.lit("JJA").alias("season"), F.lit(10).alias("season_idx"), F.lit(1994).alias("season_year"))


def test_grain(spark):
    g = grain.cell_category(geo(spark), CFG)
    got = {(r["place"], r["category"]): r for r in g.collect()}
    assert got["R1", "Natural"]["share"] == pytest.approx(100 / 140)
    assert got["R1", "Arson"]["share"] == pytest.approx(40 / 140)
    assert got["R1", "Arson"]["missing_frac"] == pytest.approx(25 / 165)
    assert got["R2", "Natural"]["size"] == 0
    assert not any(p == "R3" for p, _ in got)
    assert grain.share_violations(g).count() == 0
    w = {r["place"]: r["missing_rate"] for r in grain.cell_targets(geo(spark), CFG, ["place"])["weights"].collect()}
    assert w["R3"] == 1.0


def test_composition(spark):
    # Inputs with known results, FIXTURES.md part B, "tiny_rsc".
    data = [("R1", "JJA", 10, 1994, "Natural", 100.0), ("R1", "JJA", 10, 1994, "Arson", 40.0), ("R1", "JJA", 10, 1994, "Other", 10.0), ("R1", "JJA", 10, 1994, "Missing", 50.0), ("R2", "JJA", 10, 1994, "Arson", 30.0), ("R1", "DJF", 0, 1992, "Arson", 5.0)]
    df = spark.createDataFrame(data, "place string, season string, season_idx int, season_year int, category string, size double")
    g = grain.cell_category(df, CFG)
    assert tuple(clean.boundary_account(g, CFG, ["place", "season_idx"]).first()) == (3, 2, 1)
    r = grain.composition(g, CFG).where("place = 'R1'").first()
    assert (r["human"], r["natural"], r["unknown"], r["total"]) == (0.25, 0.5, 0.25, 200.0)


def test_scores(spark):
    # Inputs with known results, FIXTURES.md part B, "scoring vectors".
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 0.0, 1.0, True), (1.0, 0.0, 0.0, 1.0, 3.0, True), (None, None, 1.0, 0.0, 9.0, True), (1.0, 0.0, 0.0, 1.0, 1.0, False)], "p0 double, p1 double, a0 double, a1 double, w double, test boolean")
    p, a = [F.col("p0"), F.col("p1")], [F.col("a0"), F.col("a1")]
    r = score.score_masked(df, metrics.tvd(p, a), F.col("w"), F.col("test"), hit=metrics.top1_hit(p, a)).first()
    assert (r["n_cells"], r["plain"], r["weighted"], r["hit"]) == (2, 0.5, 0.75, 0.5)
    empty = score.score_masked(df.where("false"), metrics.tvd(p, a), F.col("w"), F.col("test")).first()
    assert (empty["n_cells"], empty["plain"]) == (0, None)
    with pytest.raises(ValueError):
        score.ladder(spark.createDataFrame([("a", 1.0)], "rung string, m double"), "b", "m")


def test_one_burn(spark):
    # Inputs with known results, FIXTURES.md part B, "one burn".
    grid = spark.createDataFrame([("a",), ("b",)], "cell string")
    spine_ = grain.dense_spine(grid, 0, 5)
    burn = spark.createDataFrame([("a", 2, 0.5)], "cell string, season_idx int, x double")
    p = spine_.join(burn, ["cell", "season_idx"], "left").fillna(0.0)
    p = p.withColumns({"lag4": trailing.trailing_sum("x", ["cell"], 4), "since": trailing.since_last("x", ["cell"], 5)})
    got = {(r["cell"], r["season_idx"]): (r["lag4"], r["since"]) for r in p.collect()}
    assert got["a", 2] == (0.0, 5) and got["a", 3] == (0.5, 1)
    assert sum(k[0] == "b" and v[0] == 0 for k, v in got.items()) == 6


def test_preseason(spark):
    # Inputs with known results, FIXTURES.md part B, "pre-season, partial window".
    one = spark.range(1).select(*[F.transform(spine.preseason_months(F.lit(o), F.lit(2015), n), lambda d: d.cast("string")).alias(f"m{o}_{n}") for o, n in ((2, 3), (0, 3), (2, 1))]).first()
    assert one["m2_3"] == ["2015-03-01", "2015-04-01", "2015-05-01"]
    assert one["m0_3"] == ["2014-09-01", "2014-10-01", "2014-11-01"]
    assert one["m2_1"] == ["2015-05-01"]
    months = spark.createDataFrame([("h", "2015-03-01", 1.0), ("h", "2015-04-01", 2.0), ("h", "2015-05-01", 3.0), ("h", "2015-06-01", 9.0)], "cell string, month string, v double").withColumn("month", F.to_date("month"))
    got = covariates.preseason_mean(months, "cell", "v", 3, 94, 95, 1992, emit_null=False).collect()
    assert [(r["season_idx"], r["v"]) for r in got] == [(94, 2.0)]


def test_polygons(spark):
    # Inputs with known results, FIXTURES.md part B, "toy layers".
    def box(x0, x1, y0, y1):
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]

    layer = artifacts.polygon_layer(spark, [(1, "West", "P", box(0.0, 1.0, 0.0, 1.0)), (2, "East", "P", box(1.0, 2.0, 0.0, 1.0)), (3, "Over", "P", box(0.0, 2.0, 0.0, 1.0))])
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 9.0, 9.0), (4, 0.0, 0.5), (5, None, None)], "id int, x double, y double")
    got = dict(rows(spatial.join_layer(pts, layer, 0.25), "id", "place"))
    assert got == {1: "West", 2: "East", 3: None, 4: None, 5: None}


def test_points_in_many_polygons_match_brute_force(spark):
    """Triangles that overlap and cross tiles, and points on a lattice that some edges touch."""
    rng = np.random.default_rng(6)
    shapes = [(k, [tuple(map(float, p)) for p in rng.integers(-20, 20, (3, 2))]) for k in range(25)]
    dots = [(i, float(x) / 2, float(y) / 2) for i, (x, y) in enumerate(rng.integers(-50, 50, (300, 2)))]

    def holds(ring, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and (cross > 0) == (y2 > y1):
                odd = not odd
        return odd

    layer = artifacts.polygon_layer(spark, [(k, f"p{k}", None, ring) for k, ring in shapes])
    pts = spark.createDataFrame(dots, "id int, x double, y double")
    got = {(r["id"], r["poly"]) for r in spatial.points_in_polygons(pts, layer, 7.0).collect()}
    assert got == {(i, k) for i, x, y in dots for k, ring in shapes if holds(ring, x, y)}


def test_apportionment_conserves(spark):
    ev = spark.createDataFrame([(1, 10.0, "p", 7), (2, 30.0, "p", 8), (3, 5.0, None, 9)], "event int, size double, perimeter string, point_cell long")
    ov = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 3.0)], "perimeter string, cell long, overlap double")
    got = spatial.apportion(ev, ov)
    assert rows(got, "event", "cell", "share") == sorted([(1, 1, 2.5), (1, 2, 7.5), (2, 1, 7.5), (2, 2, 22.5), (3, 9, 5.0)], key=str)
    r = spatial.conservation(ev, got).first()
    assert (r["events"], r["violations"], r["losing"]) == (3, 0, 0)


def test_ranks(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": np.where(rng.random(2000) < 0.8, 0.0, rng.random(2000)), "b": rng.random(2000)})
    got = ranks.spearman(spark.createDataFrame(pdf), "a", "b").first()["rho"]
    assert got == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()), abs=1e-12)
    const = ranks.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()
    assert (const["n"], const["rho"]) == (2, None)


def test_hex_round_trip(spark):
    pts = spark.range(500).select(((F.col("id") * 7) % 120 - 60.0).alias("lat"), ((F.col("id") * 13) % 300 - 150.0).alias("lon"))
    cell = hexgrid.cell_of(F.col("lat"), F.col("lon"), 50.0)
    lat, lon = hexgrid.centre(F.col("c"), 50.0)
    back = pts.withColumn("c", cell).select("c", lat.alias("lat"), lon.alias("lon"))
    assert back.where(hexgrid.cell_of(F.col("lat"), F.col("lon"), 50.0) != F.col("c")).count() == 0


def test_contracts_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = f"file://{tmp_path}/t"
    artifacts.write_checked(df, path, ["k"])
    with pytest.raises(ValueError):
        artifacts.write_checked(df.union(df), path + "2", ["k"])
    assert artifacts.build_cached(spark, path, lambda: 1 / 0).count() == 2
    assert contracts.fingerprint(df).first() == contracts.fingerprint(df.orderBy(F.col("k").desc())).first()
    with pytest.raises(ValueError, match="keys"):
        contracts.raise_on_violations(contracts.checks([("keys", contracts.key_violations(df.union(df), ["k"]))]))
    planned = spark.createDataFrame([(1,), (2,), (3,)], "unit int")
    out = f"file://{tmp_path}/units"
    holes = artifacts.backfill(planned, out, ["unit"], lambda todo: todo.where("unit < 3").withColumn("v", F.lit(1)))
    assert rows(holes, "unit") == [(3,)]
    assert artifacts.backfill(planned, out, ["unit"], lambda todo: todo.withColumn("v", F.lit(1))).count() == 0
    assert spark.read.parquet(out).count() == 3


def test_queries_match_sql(spark):
    """A few queries over the tables, if they are at hand."""
    import os

    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    import __spark_entry__ as e

    got = e.queries()["tier1_floor"](spark, d).first()
    assert (got["n_cells"], round(got["plain"], 6), round(got["weighted"], 6)) == (250, 0.144844, 0.138515)
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("tier1_floor", "a10_human_shares", "w03_trailing_std"):
        a = sorted(map(tuple, e.queries()[name](spark, d).collect()), key=str)
        b = sorted(con.execute(e.oracle_sql()[name]).fetchall(), key=str)
        assert a == b


def test_no_nested_loops_or_lone_windows(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    import __spark_entry__ as e

    for name in ("tier1_floor", "w15_log_persistence", "j10_point_in_polygon", "j19_leakage_audit"):
        plan = e.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
