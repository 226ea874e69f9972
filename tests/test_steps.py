"""Steps whose cost or result must not depend on how rows are laid out or added up."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from panelspine.operators import grain, learn, ranks, spatial


def test_pooled_apportionment_is_the_sum_of_parts(spark):
    events = spark.createDataFrame([(1, 10.0, "p", 7), (2, 30.0, "p", 8), (3, 5.0, None, 9), (4, 6.0, "q", 1), (5, 8.0, "z", 1), (6, 9.0, "z", None)], "event long, size double, perimeter string, point_cell long")
    overlap = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 3.0), ("q", 2, 2.0), ("q", 5, 0.0), ("r", 3, 1.0)], "perimeter string, cell long, overlap double")
    parts = spatial.apportion(events, overlap)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(spatial.apportioned_by_cell(events, overlap), parts.groupBy("cell", "source").agg(F.sum("share"), F.countDistinct("event").alias("events")).select("cell", "source", "sum(share)", "events"))
    assert same(spatial.apportioned_by_source(events, overlap), parts.groupBy("source").agg(F.count(F.lit(1)), F.sum("share")))
    assert same(spatial.apportioned_by_event(events, overlap), parts.groupBy("event").agg(F.sum("share")))
    # 100,000 events of one perimeter with 100,000 cells would be 10 ** 10 parts
    many = spark.range(100_000).select(F.col("id").alias("event"), F.lit(1.0).alias("size"), F.lit("p").alias("perimeter"), F.lit(0).cast("long").alias("point_cell"))
    cells = spark.range(100_000).select(F.lit("p").alias("perimeter"), F.col("id").alias("cell"), F.lit(1.0).alias("overlap"))
    assert spatial.apportioned_by_source(many, cells).collect() == [("perimeter", 10**10, 100_000.0)]
    assert spatial.apportioned_by_cell(many, cells).where("events != 100000 or abs(share - 1) > 1e-6").count() == 0


def test_coordinates_are_those_of_double_division(spark):
    from panelspine.plans.spatial_queries import LON, double

    got = [r["x"] for r in spark.range(3600).select(double(LON.format(k="id")).alias("x")).collect()]
    assert got == [(k * 37 % 3600) / 10.0 - 180 for k in range(3600)]


def test_quartile_of_a_value_that_is_worked_out_anew(spark):
    # each reading of v differs in the last digits, as sums in another order do
    df = spark.range(9).withColumn("v", F.col("id") + F.rand() * 1e-12)
    for _ in range(3):
        got = ranks.quartile_bucket(df, "v").select("id", "bucket").collect()
        assert [r["bucket"] for r in sorted(got)] == [1, 1, 1, 2, 2, 3, 3, 4, 4]


def test_sums_that_tie_are_ranked_by_key(spark, tmp_path):
    from panelspine.plans import all_queries  # noqa: F401  (registers the queries)
    from panelspine.plans.registry import QUERIES

    sizes = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1], 3: [0.2, 0.3, 0.1], 4: [0.6]}
    orders = [(10 * c + i, c, v, datetime(1996, 1, 1), "2-HIGH", "F") for c, vs in sizes.items() for i, v in enumerate(vs)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string, o_orderstatus string"),
        "customer": ([(c, 0, 1.0, "BUILDING") for c in sizes], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["w10_cumulative_share"](spark, str(tmp_path)).collect()
    assert sorted((r["rank"], r["cell"]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_a_short_table_is_spread_before_it_is_multiplied(spark):
    places = spark.range(1000).coalesce(1).withColumnRenamed("id", "cell")
    assert grain.spread_rows(places, 27).rdd.getNumPartitions() == 1
    assert grain.spread_rows(places, 27, 5000).rdd.getNumPartitions() == 6
    assert grain.dense_spine(places, 0, 3).count() == 4000


def test_lines_of_orders_are_dealt_before_they_are_summed(spark, tmp_path, monkeypatch):
    import duckdb

    from panelspine.plans import all_queries  # noqa: F401  (registers the queries)
    from panelspine.plans import bindings
    from panelspine.plans.registry import QUERIES, SQL

    monkeypatch.setattr(bindings, "LINES_OF_A_TASK", 100, raising=False)
    # order 3 and supplier 2 are there twice, supplier 4 is not, and some keys and quantities are absent
    orders = [(o, o % 3, datetime(1996, 1 + o % 12, 1)) for o in [*range(500), 3]]
    lines = [(None if i % 97 == 0 else i % 500, None if i % 89 == 0 else i % 7 % 5, None if i % 5 == 0 else float(i % 50)) for i in range(2000)]
    tables = {
        "orders": ([(o, c, 1.0, d, "2-HIGH", "F") for o, c, d in orders], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string"),
        "customer": ([(c, 0, 1.0, "BUILDING") for c in range(2)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "lineitem": (lines, "l_orderkey long, l_suppkey long, l_quantity double"),
        "supplier": ([(0, 0, 900.0), (1, 0, -5.0), (2, 0, 300.0), (2, 0, 400.0), (3, 0, None)], "s_suppkey long, s_nationkey int, s_acctbal double"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    of_a_task = bindings.Tables(spark, str(tmp_path)).overlap.where("event is not null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert of_a_task < 300  # of 2000
    for name in ("a14_cell_season_burn", "w11_largest_per_key"):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(con.execute(SQL[name]).fetchall(), key=str)


def test_permutation_is_worked_out_in_batches(spark):
    rows = spark.range(1, 300_001).select(ranks.shuffled_rank(F.col("id"), F.lit(300_000), F.lit(5)).alias("to"))
    assert rows.agg(F.countDistinct("to"), F.min("to"), F.max("to")).first() == (300_000, 1, 300_000)
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()


def test_twin_keeps_marginal_ranks(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("g"), F.col("id").alias("key"), (F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"))
    got = {r["g"]: r for r in ranks.shuffled_twin(rows, "a", "b", "key", ["g"]).collect()}
    dealt = {r["g"]: r["rho"] for r in ranks.spearman(ranks.permuted(rows, ["b"], "key", 11, ["g"]), "a", "b_permuted", ["g"]).collect()}
    real = {r["g"]: r["rho"] for r in ranks.spearman(rows, "a", "b", ["g"]).collect()}
    assert all(got[g]["n"] == 200 and abs(got[g]["rho"] - real[g]) < 1e-12 and abs(got[g]["rho_shuffled"] - dealt[g]) < 1e-12 for g in (0, 1))


def test_ladder_keeps_rungs_without_test_rows(spark):
    rows = spark.range(60).select(F.col("id").alias("key"), (F.col("id") % 9).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("f"), (F.col("id") % 4).cast("double").alias("c"))
    make = lambda y: learn.ridge(y, 1e-6)
    got = learn.rank_ladder(rows, "y", "f", {"c": ["c"]}, F.col("key") < 40, make)
    assert {r["rung"]: r["n_test"] for r in got.collect()} == {"floor": 20, "c": 20}
    none = learn.rank_ladder(rows, "y", "f", {"c": ["c"]}, F.lit(True), make)
    assert {r["rung"]: (r["n_test"], r["rho"]) for r in none.collect()} == {"floor": (0, None), "c": (0, None)}
