"""Learned rungs, routed layers and dense panels on small frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspine.config import PanelConfig
from panelspine.functions.metrics import log_positive
from panelspine.operators import grain, gram, joins, learn, ranks, score, spatial, trailing
from panelspine.sources import artifacts

CFG = PanelConfig(base_year=1992, partial_seasons=(), last_idx=6, test_start=1994, sentinel="Missing", natural="Natural", human=("Arson",))


def shares_frame(spark):
    """Rows whose shares follow one feature closely and whose weights differ."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(150):
        u, v = rng.uniform(0, 1), rng.uniform(-2, 2)
        a, b = 0.2 + 0.5 * u, 0.1 + 0.1 * rng.uniform()
        rows.append((u, v, a, b, 1 - a - b, 1.0 + 9 * (i % 2)))
    return spark.createDataFrame(rows, "u double, v double, a double, b double, c double, w double")


def test_simplex_predictions_are_compositions(spark):
    df = shares_frame(spark)
    got = learn.simplex_predict(df, ["u", "v"], ["a", "b", "c"], F.lit(True), lambda s: learn.ridge(s, 0.01, "w")).toPandas()
    p = got[["pred_a", "pred_b", "pred_c"]].to_numpy()
    assert (p >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.abs(p - got[["a", "b", "c"]].to_numpy()).mean() < 0.1
    flat = learn.simplex_predict(df, ["u", "v"], ["a", "b", "c"], F.lit(True), lambda s: learn.ridge(s, 0.01)).toPandas()
    assert not np.allclose(p, flat[["pred_a", "pred_b", "pred_c"]].to_numpy())


def test_rows_without_any_share_fail(spark):
    df = shares_frame(spark).withColumns({s: -F.col(s) for s in "abc"})
    with pytest.raises(Exception, match="all predicted shares"):
        learn.simplex_predict(df, ["u"], ["a", "b"], F.lit(True), lambda s: learn.ridge(s, 0.01)).collect()


def test_ridge_matches_the_normal_equations(spark):
    """Coefficients of standardized features for a weight on the squared ones, with row weights."""
    df = shares_frame(spark)
    ready = learn.standardized(df, ["u", "v"], F.lit(True))
    pdf, alpha = ready.toPandas(), 7.0
    x, y, w = pdf[["u", "v"]].to_numpy(), pdf["a"].to_numpy(), pdf["w"].to_numpy()
    assert np.allclose(x.mean(axis=0), 0) and np.allclose(x.std(axis=0), 1)
    xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    want = np.linalg.solve((x - xm).T @ ((x - xm) * w[:, None]) + alpha * np.eye(2), (x - xm).T @ (w * (y - ym)))
    got = learn.ridge("a", alpha * learn.ridge_penalty(ready, ["a"], "w")["a"], "w").fit(learn.assembled(ready, ["u", "v"]))
    assert np.allclose(got.coefficients.toArray(), want, atol=1e-6)


def test_ladder_and_shuffle_control(spark):
    """A covariate that tells the target beats the floor and its own shuffles; one that does not, does not."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        f, x, z = rng.normal(size=3)
        rows.append((f"k{i:04d}", i % 4, float(f), float(x), float(z), float(0.3 * f + 2 * x + 0.1 * rng.normal())))
    df = spark.createDataFrame(rows, "key string, year int, floor double, x double, z double, y double")
    make = lambda s: learn.ridge(s, 1e-6)
    got = {r["rung"]: r for r in learn.rank_ladder(df, "y", "floor", {"x": ["x"], "z": ["z"]}, F.col("year") < 3, make).collect()}
    assert set(got) == {"floor", "x", "z"} and got["floor"]["delta"] == 0 and {r["n_test"] for r in got.values()} == {100}
    assert got["x"]["delta"] > 0.5 > abs(got["z"]["delta"]) + 0.3
    one = learn.shuffle_control(df, "y", "floor", ["x"], F.col("year") < 3, "key", make, times=4).first()
    assert one["n_test"] == 100 and one["delta"] > 0.5 and one["null_max"] < 0.3 and one["separation"] > 5


def test_ridges_from_sums_equal_closed_forms(spark):
    """Each penalty and subset of features as numpy solves it; a constant feature has no part; weights count."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) * [1, 20, 0.3] + [5, -100, 0]
    y = x @ [0.5, -0.02, 2.0] + rng.normal(size=300)
    w = rng.uniform(0.1, 4, 300)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "k": 7.0, "y": y, "z": -y, "w": w})
    df = spark.createDataFrame(pdf).repartition(5).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 7.0, 1.0, 1.0, 1.0)], "a double, b double, c double, k double, y double, z double, w double"))
    g = gram.gram_of(df, ["a", "b", "c", "k"], ["y", "z"], "w")
    for penalty in (1e-6, 1.0, 300.0):
        for chosen in (["a", "b", "c", "k"], ["a", "c"]):
            cols = ["abc".index(c) for c in chosen if c != "k"]
            s = x[:, cols] / x[:, cols].std(axis=0)
            mean = w @ s / w.sum()
            b = np.linalg.solve((s - mean).T @ ((s - mean) * w[:, None]) + penalty * np.eye(len(cols)), (s - mean).T @ (w * (y - w @ y / w.sum())))
            want = w @ y / w.sum() + (s - mean) @ b
            model = gram.ridge(g, "y", penalty, chosen)
            got = np.array([r["p"] for r in df.where("a is not null").orderBy("y").select(model.predict().alias("p")).collect()])
            assert np.allclose(got, want[np.argsort(y)], atol=1e-8)
            assert np.isclose(gram.ridge(g, "z", penalty, chosen).intercept, -model.intercept)
    with pytest.raises(ValueError, match="no training rows"):
        gram.gram_of(df.where("false"), ["a"], ["y"])


def test_a_sweep_reads_its_training_rows_once(spark):
    rows = [(i % 5, float(i % 7), float(i % 3), (i % 7) / 10, 1 - (i % 7) / 10, 1.0 + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "year int, a double, b double, s double, t double, w double")
    tvd = lambda p, q: (F.abs(p[0] - q[0]) + F.abs(p[1] - q[1])) / 2
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sweep", "")
    out = gram.penalty_sweep(df, ["a", "b"], ["s", "t"], "w", F.col("year") < 3, [1e-9, 1.0, 1e9], tvd)
    jobs = len(tracker.getJobIdsForGroup("sweep"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r["penalty"]: r for r in out.collect()}
    assert jobs <= 2 and {r["n"] for r in got.values()} == {80}  # the aggregate's stages, whatever the penalties
    assert got[1e-9]["score"] < 1e-6 < got[1.0]["score"] < got[1e9]["score"]


def test_permutations_take_each_row_once(spark):
    df = spark.range(1, 1001).select(F.format_string("k%05d", "id").alias("key"), F.col("id").alias("v"))
    got = ranks.permuted(df, ["v"], "key", 4).collect()
    assert sorted(r["v_permuted"] for r in got) == list(range(1, 1001))
    assert sum(r["v"] == r["v_permuted"] for r in got) < 20 and abs(np.corrcoef([r["v"] for r in got], [r["v_permuted"] for r in got])[0, 1]) < 0.2


def test_shuffled_ranks_are_permutations_that_look_random(spark):
    """For each n each rank comes out once; the null's deviation is that of true shuffles."""
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 16, 17, 100, 1025)], "n long")
    dealt = sizes.select("n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("r")).select("n", ranks.shuffled_rank(F.col("r"), F.col("n"), F.lit(3)).alias("to"))
    got = {r["n"]: sorted(r["to"]) for r in dealt.groupBy("n").agg(F.collect_list("to").alias("to")).collect()}
    assert all(to == list(range(1, n + 1)) for n, to in got.items())
    n, times = 375, 1500
    rows = spark.range(1, n + 1).crossJoin(spark.range(1, times + 1).toDF("seed")).select("seed", "id", ranks.shuffled_rank(F.col("id"), F.lit(n), F.col("seed")).alias("to"))
    rho = rows.groupBy("seed").agg(F.corr("id", "to").alias("rho")).toPandas()["rho"]
    true = [np.corrcoef(np.arange(n), x)[0, 1] for x in (np.random.default_rng(s).permutation(n) for s in range(times))]
    assert abs(rho.std() / np.std(true) - 1) < 0.1 and abs(rho.mean()) < 0.01
    assert rows.where("id = to").count() == pytest.approx(times, rel=0.15)  # one fixed place each


def test_ranks_of_hot_values_and_groups(spark):
    """With most rows on one value in one group: ranks, quantiles and shares against pandas."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.7, "big", rng.choice(list("xyz"), 3000)), "v": np.where(rng.random(3000) < 0.6, -4.0, rng.normal(size=3000).round(2)), "k": np.arange(3000)})
    pdf.loc[rng.choice(3000, 40, replace=False), "g"] = None
    df = spark.createDataFrame(pdf)
    got = ranks.first_ranks(df, "v", "k", ["g"]).toPandas().sort_values("k")
    want = pdf.sort_values(["v", "k"]).groupby("g", dropna=False).cumcount().sort_index() + 1
    assert (got["rank"].to_numpy() == want.to_numpy()).all()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = ranks.placed(df, ["g"], ["v", "k"], t=F.count(F.lit(1))).groupBy("__r").count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges.max() < 3000 / 2 and len(ranges) > 2  # the hot value of the hot group is in several ranges
    q = {r["g"]: r["q"] for r in ranks.quantiles(df, "v", [0.1, 0.5, 0.9], ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(q[g], np.quantile(part["v"], [0.1, 0.5, 0.9]))
    assert ranks.quantiles(df.where("false"), "v", [0.5]).first()["q"] == [None]
    cum = ranks.cumulative_share(df.withColumn("v", F.col("v") + 5), "v", "k").toPandas().sort_values("rank")
    s = (pdf.assign(v=pdf["v"] + 5).sort_values(["v", "k"], ascending=[False, True])["v"]).to_numpy()
    assert np.allclose(cum["cum"], s.cumsum() / s.sum())


def test_two_parents_and_double_matches_fail(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    one, two = artifacts.polygon_layer(spark, [(1, "W", "P", ring)]), artifacts.polygon_layer(spark, [(1, "W", "Q", ring)])
    pts = spark.createDataFrame([(1, "a", 0.5, 0.5), (2, "b", 0.5, 0.5)], "id int, state string, x double, y double")
    with pytest.raises(ValueError, match="two parents"):
        spatial.join_routed(pts, [("state = 'a'", one), ("state = 'b'", two)], 0.5)
    with pytest.raises(ValueError, match="two layers"):
        spatial.join_routed(pts, [("state = 'a'", one), ("state <> 'b'", one)], 0.5)
    assert spatial.join_routed(pts, [("state = 'a'", one), ("state = 'b'", one)], 0.5).count() == 2


def test_one_to_one_join_fails_on_repeats(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(ValueError, match="right"):
        joins.join_one_to_one(a, b, ["k"])


def test_dense_panel(spark):
    # Inputs with known results, FIXTURES.md part B, "ignitions".
    ev = spark.createDataFrame([("a", 5, "Natural"), ("a", 6, "Arson"), ("b", 6, "Natural")], "cell string, season_idx int, category string")
    grid = spark.createDataFrame([("a", "P", 20.0), ("b", "P", 10.0)], "cell string, place string, area double")
    p = grain.dense_panel(ev, grid, CFG, F.lit(1), "starts_").where("season_idx >= 5").withColumn("log_area", log_positive(F.col("area")))
    got = {(r["cell"], r["season_idx"]): r for r in p.collect()}
    assert len(got) == 4 and got["b", 5]["starts_natural"] == 0 and got["a", 6]["starts_human"] == 1
    assert got["a", 5]["log_area"] - got["b", 5]["log_area"] == pytest.approx(math.log(2))


def test_conditional_mean_and_anomaly(spark):
    # Inputs with known results, FIXTURES.md part B, "burn-conditional, anomaly".
    df = spark.createDataFrame([("a", i, v, 1991 + i) for i, v in enumerate([0.0, 100.0, 0.0, 1000.0])], "cell string, season_idx int, acres double, season_year int")
    got = df.withColumn("log", F.when(F.col("acres") > 0, F.log10("acres"))).withColumn("p", trailing.trailing_mean("log", ["cell"], 3)).orderBy("season_idx").collect()
    assert [r["p"] for r in got] == [None, None, 2.0, 2.0]
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 3.0, 100.0])], "cell string, t int, pdsi double")
    last = x.withColumn("d", F.col("pdsi") - trailing.train_mean("pdsi", ["cell"], F.col("t") < 3)).orderBy("t").collect()[-1]
    assert last["d"] == 98.0


def test_buckets_and_quantiles(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(53)], "id int, v double")
    got = ranks.first_ranks(df, "v", "id").withColumn("b", ranks.equal_count_bucket(F.col("rank"), F.col("n"), 4)).toPandas().sort_values("rank")
    want = pd.qcut(pd.Series(range(1, 54)), 4, labels=False) + 1
    assert got["b"].tolist() == want.tolist() and got["rank"].tolist() == list(range(1, 54))
    w = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)], "v double, w double")
    q = {r["q"]: r["value"] for r in score.weighted_quantiles(w, [], "v", "w", [0.01, 0.5, 0.99]).collect()}
    assert q[0.01] == 1.0 and q[0.99] == 3.0 and q[0.5] == pytest.approx(2.0 + (0.5 - 0.375) / (0.75 - 0.375))
