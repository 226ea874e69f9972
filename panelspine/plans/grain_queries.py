"""Queries on records and on the place-by-season grain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CELL
from ..functions import metrics as X
from ..functions import spine as S
from ..operators import clean as C
from ..operators import grain as G
from ..operators import joins as J
from ..operators import score as R
from ..operators.ranks import with_quantiles
from .bindings import CFG, CLASS
from .registry import query

STATES = ["HOUSEHOLD", "MACHINERY"]
MASK = "(state IN ('HOUSEHOLD', 'MACHINERY') OR agency = 'P')"
MISS = "category = '4-NOT SPECIFIED'"

# scans
query("s01_scan_minus_column", lambda t: t.table("customer").drop("c_name"), "SELECT * EXCLUDE (c_name) FROM customer")
query("s02_projected_scan", lambda t: t.table("orders").select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders")
query(
    "s03_hash_sample",
    lambda t: t.table("orders").select("o_orderkey", F.right((F.col("o_orderkey") * 2654435761 + 7).cast("string"), F.lit(8)).alias("h")).orderBy("h", "o_orderkey").limit(100),
    "SELECT o_orderkey, right((o_orderkey * 2654435761 + 7)::VARCHAR, 8) AS h FROM orders ORDER BY h, o_orderkey LIMIT 100",
)
query(
    "s04_pruned_read",
    lambda t: t.table("lineitem").select("l_orderkey", "l_quantity").where("l_quantity >= 49"),
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49",
)
query(
    "s11_boxed_cube_scan",
    lambda t: t.monthly.where("month between '1997-03-01' and '1997-05-01' and cell between 10 and 40").select("place", "cell", "month", "v1"),
    "SELECT place, cell, month::VARCHAR AS month, v1 FROM monthly WHERE month BETWEEN '1997-03-01' AND '1997-05-01' AND cell BETWEEN 10 AND 40",
)

# filters and projections
query("p01_exclusion", lambda t: C.exclude(t.records, STATES, "P").select("id", "state", "agency"), f"SELECT id, state, agency FROM records WHERE NOT {MASK}")
query(
    "p02_exclusion_account",
    lambda t: C.exclusion_account(t.records, STATES, "P"),
    f"SELECT count(*) FILTER (state IN ('HOUSEHOLD', 'MACHINERY')) AS by_state, count(*) FILTER (agency = 'P') AS by_agency, count(*) FILTER (state IN ('HOUSEHOLD', 'MACHINERY') AND agency = 'P') AS by_both, count(*) FILTER ({MASK}) AS dropped, sum(CASE WHEN {MASK} THEN size ELSE 0 END) AS size_dropped, count(*) AS rows FROM records",
    "size_dropped",
)
query(
    "p03_missing_flag",
    lambda t: t.records.select("id", C.missing_flag(CFG).alias("missing"), F.col("category").startswith("4-NOT").alias("prefix")),
    f"SELECT id, {MISS} AS missing, starts_with(category, '4-NOT') AS prefix FROM records",
)
query(
    "p04_coarse_class",
    lambda t: t.records.groupBy(C.coarse_class(CFG).alias("class")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT {CLASS} AS class, count(*) AS n FROM records GROUP BY ALL",
)
query(
    "p04_collapse_tail",
    lambda t: C.collapse_tail(t.records.where(~C.missing_flag(CFG)), "category", 2).groupBy("category").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT CASE WHEN r <= 2 THEN category ELSE 'Other' END AS category, sum(n)::BIGINT AS n FROM (SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS r FROM records WHERE NOT {MISS} GROUP BY category) GROUP BY 1",
)
query(
    "p05_boundary_account",
    lambda t: C.boundary_account(t.grain, CFG, CELL),
    "SELECT count(*) AS before, count(*) FILTER (season_idx NOT IN (0, 26)) AS after, count(*) FILTER (season_idx IN (0, 26)) AS dropped FROM (SELECT DISTINCT place, season_idx FROM grain)",
)
query("p07_population_total", lambda t: t.tier1.select("place", "season_idx", "total"), "SELECT place, season_idx, total FROM tier1", "total")
query("p07_population_human", lambda t: t.human.select("place", "season_idx", "human_size"), "SELECT place, season_idx, human_size FROM human", "human_size")
query(
    "p08_support_gate",
    lambda t: C.gate(t.records, ["place", "season_year"], 80),
    "SELECT place, season_year, count(*) AS n FROM records GROUP BY ALL HAVING count(*) >= 80",
)
query(
    "p09_prefix_filter",
    lambda t: t.records.where(F.col("place").startswith("NATION_1")).groupBy("place").agg(F.count(F.lit(1)).alias("n")),
    "SELECT place, count(*) AS n FROM records WHERE starts_with(place, 'NATION_1') GROUP BY ALL",
)
query(
    "p10_known_coordinates",
    lambda t: t.pixels.withColumn("lat", F.when(F.col("cell") % 7 > 0, F.col("cell") % 60)).na.drop(subset=["lat"]).groupBy("lat").agg(F.count(F.lit(1)).alias("n")),
    "SELECT (cell % 60)::BIGINT AS lat, count(*) AS n FROM pixels WHERE cell % 7 > 0 GROUP BY ALL",
)
query(
    "p11_known_cells",
    lambda t: J.restrict(t.overlap, t.supplier_grid.where("area > 0"), "cell").groupBy("cell").agg(F.count(F.lit(1)).alias("n")),
    "SELECT cell, count(*) AS n FROM overlap WHERE cell IN (SELECT cell FROM supplier_grid WHERE area > 0) GROUP BY ALL",
)
query(
    "p12_logs",
    lambda t: t.acres.select("cell", "season_idx", X.log10_floored(F.col("size_natural")).alias("log_natural"), X.log_positive(F.col("area")).alias("log_area")),
    "SELECT cell, season_idx, CASE WHEN size_natural > 0 THEN log10(greatest(size_natural, 1e-4)) ELSE -4.0 END AS log_natural, CASE WHEN area > 0 THEN ln(area) END AS log_area FROM acres",
    "log_natural log_area",
)
query(
    "p13_clamped_ratio",
    lambda t: t.acres.select("cell", "season_idx", F.when(F.col("area") > 0, F.least(F.col("size_total") / F.col("area"), F.lit(1.0))).alias("frac")).where("frac > 0"),
    "SELECT cell, season_idx, least(size_total / area, 1.0) AS frac FROM acres WHERE area > 0 AND size_total > 0",
    "frac",
)
query(
    "p14_occurrence",
    lambda t: t.acres.select("cell", "season_idx", (F.col("size_human") > 0).cast("int").alias("any_human")),
    "SELECT cell, season_idx, (size_human > 0)::INT AS any_human FROM acres",
)
query(
    "p15_mean_of_positive",
    lambda t: t.acres.groupBy("season_idx").agg(F.avg(F.when(F.col("size_natural") > 0, F.col("size_natural"))).alias("mean_size")),
    "SELECT season_idx, avg(size_natural) FILTER (size_natural > 0) AS mean_size FROM acres GROUP BY ALL",
    "mean_size",
)
query(
    "p16_one_hot",
    lambda t: C.one_hot(t.tier1.select("place", "season_idx", "season"), "season", ("DJF", "MAM", "JJA", "SON"), "is_").drop("season"),
    "SELECT place, season_idx, (season = 'DJF')::INT AS is_DJF, (season = 'MAM')::INT AS is_MAM, (season = 'JJA')::INT AS is_JJA, (season = 'SON')::INT AS is_SON FROM tier1",
)
query(
    "p17_strip_doubt",
    lambda t: t.table("region").select("r_regionkey", C.strip_doubt(F.concat("r_name", F.lit(" (?) "))).alias("name")),
    r"SELECT r_regionkey, trim(regexp_replace(r_name || ' (?) ', '\s*\(\?\)\s*$', '')) AS name FROM region",
)
query(
    "p18_normal_keys",
    lambda t: t.records.withColumn("k", C.normal_key(F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), (F.col("id") % 500).cast("string"), F.lit(" "))))).groupBy("k").agg(F.count(F.lit(1)).alias("n")),
    "SELECT coalesce(CASE WHEN id % 3 = 0 THEN (id % 500)::VARCHAR END, '') AS k, count(*) AS n FROM records GROUP BY ALL",
)
query(
    "p19_renamed",
    lambda t: t.supplier_grid.withColumnsRenamed({"cell": "hex", "area": "land"}).select("hex", "land", "place"),
    "SELECT cell AS hex, area AS land, place FROM supplier_grid",
)
query(
    "p20_long_form",
    lambda t: C.long_form(t.tier1.select("place", "season_idx", *[F.col(c).alias(f"a_{c}") for c in ("human", "natural", "unknown")], *[(F.lit(1.0) / 3).alias(f"p_{c}") for c in ("human", "natural", "unknown")]), ["place", "season_idx"], ["human", "natural", "unknown"], "p_", "a_"),
    "SELECT place, season_idx, class, 1.0::DOUBLE / 3 AS predicted, actual FROM (UNPIVOT (SELECT place, season_idx, human, \"natural\", unknown FROM tier1) ON human, \"natural\", unknown INTO NAME class VALUE actual)",
    "predicted actual",
)

# spine
query(
    "q01_mixed_dates",
    lambda t: t.raw.select("id", S.parse_date(F.when(F.col("id") % 3 == 0, F.date_format("date", "yyyy-MM-dd")).when(F.col("id") % 3 == 1, F.date_format("date", "M/d/yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss"))).alias("date")),
    "SELECT id, date::VARCHAR AS date FROM raw",
)
query("q02_season_spine", lambda t: t.records.select("id", "season", "season_year", "season_idx"), "SELECT id, season, season_year, season_idx FROM records")
query(
    "q03_index_inverse",
    lambda t: t.records.select("season_idx").distinct().select("season_idx", S.year_of_index(F.col("season_idx"), 1995).alias("year"), S.ord_of_index(F.col("season_idx")).alias("ord")),
    "SELECT DISTINCT season_idx, (1995 + season_idx // 4)::INT AS year, (season_idx % 4)::INT AS ord FROM records",
)
query(
    "q04_season_of_doy",
    lambda t: t.records.groupBy(S.season_of_doy(F.dayofyear("date")).alias("season")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN dayofyear(date) < 60 OR dayofyear(date) >= 335 THEN 'DJF' WHEN dayofyear(date) < 152 THEN 'MAM' WHEN dayofyear(date) < 244 THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n FROM records GROUP BY ALL",
)
query(
    "q05_month_and_quarter_of_doy",
    lambda t: t.records.select(F.dayofyear("date").alias("doy")).distinct().select("doy", S.month_of_doy(F.col("doy")).alias("month"), S.quarter_of_doy(F.col("doy")).alias("quarter")),
    "SELECT DISTINCT dayofyear(date)::INT AS doy, least(12, (dayofyear(date) - 1) // 30 + 1)::INT AS month, (CASE WHEN dayofyear(date) <= 79 THEN 1 WHEN dayofyear(date) <= 171 THEN 2 WHEN dayofyear(date) <= 264 THEN 3 ELSE 4 END)::INT AS quarter FROM records",
)


def _ord():
    return S.ord_of_index(F.col("season_idx"))


query(
    "q06_season_start",
    lambda t: t.records.select("season_idx", "season_year").distinct().select("season_idx", S.season_start(_ord(), F.col("season_year")).alias("start")),
    "SELECT DISTINCT season_idx, (CASE WHEN season_idx % 4 = 0 THEN make_date(season_year - 1, 12, 1) ELSE make_date(season_year, (season_idx % 4) * 3, 1) END)::DATE::VARCHAR AS start FROM records",
)
_START = "CASE WHEN season_idx % 4 = 0 THEN make_date(season_year - 1, 12, 1) ELSE make_date(season_year, (season_idx % 4) * 3, 1) END"
query(
    "q07_preseason_months",
    lambda t: t.records.select("season_idx", "season_year").distinct().select("season_idx", F.explode(S.preseason_months(_ord(), F.col("season_year"), 3)).alias("month")),
    f"SELECT season_idx, ({_START} - to_months(k))::DATE::VARCHAR AS month FROM (SELECT DISTINCT season_idx, season_year FROM records), (SELECT unnest([1, 2, 3]) AS k)",
)
query(
    "q08_partial_seasons",
    lambda t: t.records.select("season_idx").distinct().select("season_idx", S.is_partial(F.col("season_idx"), CFG.partial_seasons).alias("partial")),
    "SELECT DISTINCT season_idx, season_idx IN (0, 26) AS partial FROM records",
)
query(
    "q09_math",
    lambda t: t.records.select("id", F.log10("size").alias("lg"), F.sqrt("size").alias("rt"), F.cos(F.radians(F.col("id") % 90)).alias("cs"), X.ratio(F.col("size"), F.col("id") % 5).alias("rto")),
    "SELECT id, log10(size) AS lg, sqrt(size) AS rt, cos(radians(id % 90)) AS cs, size / nullif(id % 5, 0) AS rto FROM records",
    "lg rt cs rto",
)
query(
    "q10_strings",
    lambda t: t.records.select("id", F.upper(F.trim("state")).alias("u"), F.split("category", "-")[1].alias("label")),
    "SELECT id, upper(trim(state)) AS u, split_part(category, '-', 2) AS label FROM records",
)
query(
    "q11_years_since",
    lambda t: t.records.select("season_idx").distinct().select("season_idx", F.bround(F.col("season_idx") / 4).cast("int").alias("years"), F.when(F.col("season_idx") <= 4, "recent").when(F.col("season_idx") <= 12, "middle").otherwise("old").alias("band")),
    "SELECT DISTINCT season_idx, round_even(season_idx / 4, 0)::INT AS years, CASE WHEN season_idx <= 4 THEN 'recent' WHEN season_idx <= 12 THEN 'middle' ELSE 'old' END AS band FROM records",
)
query(
    "q13_area_units",
    lambda t: t.grid.select("cell", (F.col("area") * 0.0040468564224).alias("km2")),
    "SELECT cell, area * 0.0040468564224 AS km2 FROM grid",
    "km2",
)

# joins
query(
    "j01_one_to_one",
    lambda t: J.join_one_to_one(t.raw.select("id", "cell", "size"), t.table("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), ["id"]),
    "SELECT id, cell, size, o_orderstatus FROM raw LEFT JOIN orders ON id = o_orderkey",
)
query(
    "j02_event_overlap",
    lambda t: t.raw.select("id", "size").join(t.overlap, t.raw.id == t.overlap.event).select("id", "cell", "size", "overlap"),
    "SELECT id, o.cell, size, overlap FROM raw JOIN overlap o ON id = event",
)
query(
    "j03_small_dimension",
    lambda t: t.overlap.join(t.supplier_grid, "cell", "left").groupBy("place").agg(F.sum("overlap").alias("overlap"), F.count(F.lit(1)).alias("n")),
    "SELECT place, sum(overlap) AS overlap, count(*) AS n FROM overlap LEFT JOIN supplier_grid USING (cell) GROUP BY ALL",
    "overlap",
)
query(
    "j04_covariates",
    lambda t: J.join_covariates(t.tier1.select("place", "season_idx", "human"), [t.monthly.groupBy("place", ((F.year("month") - 1995) * 4).alias("season_idx")).agg(F.avg("v1").alias("v1")), t.human.select("place", "season_idx", "h0")], ["place", "season_idx"]),
    "SELECT t.place, t.season_idx, t.human, m.v1, h.h0 FROM tier1 t LEFT JOIN (SELECT place, (year(month) - 1995) * 4 AS season_idx, avg(v1) AS v1 FROM monthly GROUP BY ALL) m USING (place, season_idx) LEFT JOIN human h USING (place, season_idx)",
    "human v1 h0",
)
query(
    "j05_full_merge",
    lambda t: J.merge_all([t.monthly.where(f"month(month) <= {m}").groupBy("place", "month").agg(F.avg(v).alias(v)) for m, v in ((6, "v1"), (9, "v2"), (12, "v3"))], ["place", "month"]),
    "SELECT place, month::VARCHAR AS month, avg(v1) FILTER (month(month) <= 6) AS v1, avg(v2) FILTER (month(month) <= 9) AS v2, avg(v3) AS v3 FROM monthly GROUP BY ALL",
    "v1 v2 v3",
)
query(
    "j06_dense_vocabulary",
    lambda t: t.sparse_grain.select("place", "season_idx", "category", "n"),
    "SELECT place, season_idx, category, n FROM sparse_grain",
)
query(
    "j07_dense_spine",
    lambda t: G.dense_spine(t.grid.select("cell"), 0, 26).join(t.records.groupBy("cell", "season_idx").agg(F.count(F.lit(1)).alias("n")), ["cell", "season_idx"], "left").fillna(0, ["n"]),
    "SELECT cell, season_idx, starts_total AS n FROM starts",
)
query(
    "j08_semi_join",
    lambda t: t.raw.join(t.overlap.select(F.col("event").alias("id")), "id", "left_semi").agg(F.count(F.lit(1)).alias("n")),
    "SELECT count(*) AS n FROM raw WHERE id IN (SELECT event FROM overlap)",
)
query(
    "j09_reconcile",
    lambda t: J.reconcile(t.raw, t.overlap.where("cell < 30").select(F.col("event").alias("id")), ["id"]),
    "SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only FROM (SELECT DISTINCT id, true AS a FROM raw) FULL JOIN (SELECT DISTINCT event AS id, true AS b FROM overlap WHERE cell < 30) USING (id)",
)

# aggregates of the grain
query(
    "a01_cell_category",
    lambda t: t.grain.select("place", "season_idx", "category", "size", "n", "cell_size", "share", "missing_size", "missing_n", "missing_frac"),
    "SELECT place, season_idx, category, size, n, cell_size, share, missing_size, missing_n, missing_frac FROM grain",
    "size cell_size share missing_size missing_frac",
)
query(
    "a01_cell_category_sparse",
    lambda t: t.sparse_grain.select("place", "season_idx", "category", "size", "share", "missing_frac"),
    "SELECT place, season_idx, category, size, share, missing_frac FROM sparse_grain",
    "size share missing_frac",
)
query(
    "a02_total_on_rows",
    lambda t: t.grain.select("place", "season_idx", "category", "cell_size"),
    "SELECT place, season_idx, category, sum(size) OVER (PARTITION BY place, season_idx) AS cell_size FROM grain",
    "cell_size",
)
query(
    "a03_missing_weight",
    lambda t: G.per_cell(t.grain, ["missing_size", "missing_n", "missing_frac"], ["place", "season_idx"]),
    "SELECT place, season_idx, max(missing_size) AS missing_size, max(missing_n) AS missing_n, max(missing_frac) AS missing_frac FROM grain GROUP BY ALL",
    "missing_size missing_frac",
)
query(
    "a04_share_violations",
    lambda t: G.share_violations(t.grain).agg(F.count(F.lit(1)).alias("violations")),
    "SELECT count(*) AS violations FROM (SELECT sum(share) AS s FROM grain WHERE cell_size > 0 GROUP BY place, season_idx) WHERE abs(s - 1) > 1e-9",
)
query(
    "a05_series_support",
    lambda t: G.series_support(t.sparse_grain, ["place", "season"], (4, 6)),
    "SELECT place, season, count(*) AS seasons, sum(size) AS size, count(*) >= 4 AS at_least_4, count(*) >= 6 AS at_least_6 FROM (SELECT place, season, season_idx, sum(size) AS size FROM sparse_grain GROUP BY ALL) GROUP BY ALL",
    "size",
)
query(
    "a06_target_weights",
    lambda t: G.cell_targets(t.records, CFG, ["parent", "season_year"])["weights"],
    f"SELECT parent, season_year, count(*) AS n, sum(size) AS size, avg(({MISS})::INT) AS missing_rate, sum(CASE WHEN {MISS} THEN size ELSE 0 END) / sum(size) AS missing_size_rate FROM records GROUP BY ALL",
    "size missing_rate missing_size_rate",
)
query(
    "a06_target_count_shares",
    lambda t: G.cell_targets(t.records, CFG, ["place", "season_year"], 60)["count_shares"],
    f"SELECT place, season_year, category, share FROM (SELECT place, season_year, category, count(*) / sum(count(*)) OVER w AS share, sum(count(*)) OVER w AS n FROM records WHERE NOT {MISS} GROUP BY place, season_year, category WINDOW w AS (PARTITION BY place, season_year)) WHERE n >= 60",
    "share",
)
query(
    "a06_target_size_shares",
    lambda t: G.cell_targets(t.records, CFG, ["place", "season_year"], 60)["size_shares"],
    f"SELECT place, season_year, category, share FROM (SELECT place, season_year, category, sum(size) / sum(sum(size)) OVER w AS share, sum(count(*)) OVER w AS n FROM records WHERE NOT {MISS} GROUP BY place, season_year, category WINDOW w AS (PARTITION BY place, season_year)) WHERE n >= 60",
    "share",
)
query(
    "a07_by_class",
    lambda t: G.by_class(t.grain, CFG).select("place", "season_idx", "natural", "human"),
    f"SELECT place, season_idx, sum(CASE WHEN {CLASS} = 'Natural' THEN size ELSE 0 END) AS \"natural\", sum(CASE WHEN {CLASS} = 'Human' THEN size ELSE 0 END) AS human FROM grain GROUP BY ALL",
    "natural human",
)
query(
    "a08_constant_in_cell",
    lambda t: G.varying_cells(t.grain, ["missing_size", "cell_size"]).agg(F.count(F.lit(1)).alias("violations")),
    "SELECT count(*) AS violations FROM (SELECT 1 FROM grain GROUP BY place, season_idx HAVING count(DISTINCT missing_size) > 1 OR count(DISTINCT cell_size) > 1)",
)
query(
    "a09_tier1_composition",
    lambda t: t.tier1.select(*CELL, "human", "natural", "unknown", "total", "log_total", "n", "log_mean_size"),
    "SELECT * FROM tier1",
    "human natural unknown total log_total log_mean_size",
)
query("a10_human_shares", lambda t: t.human, "SELECT * FROM human", "h0 h1 h2 human_size")
query(
    "a11_natural_starts",
    lambda t: G.natural_starts(t.sparse_grain, CFG).select("place", "season_idx", "natural_size", "natural_n"),
    "SELECT place, season_idx, size AS natural_size, n AS natural_n FROM sparse_grain WHERE category = '1-URGENT' AND season_idx NOT IN (0, 26)",
    "natural_size",
)
query(
    "a12_attribution_quality",
    lambda t: G.attribution_quality(t.grain, CFG).select("place", "season_idx", "missing_frac", "natural_share"),
    f"SELECT place, season_idx, max(missing_frac) AS missing_frac, sum(CASE WHEN {CLASS} = 'Natural' THEN size ELSE 0 END) / nullif(sum(size), 0) AS natural_share FROM grain WHERE season_idx NOT IN (0, 26) GROUP BY ALL HAVING max(missing_frac) IS NOT NULL",
    "missing_frac natural_share",
)
query(
    "a13_class_snapshot",
    lambda t: G.class_snapshot(t.grain, CFG),
    f"SELECT class, size, size / 1e6 AS millions, size / sum(size) OVER () AS share FROM (SELECT {CLASS} AS class, sum(size) AS size FROM records r WHERE season_idx NOT IN (0, 26) AND EXISTS (SELECT 1 FROM grain g WHERE g.place = r.place AND g.season_idx = r.season_idx) GROUP BY ALL)",
    "size millions share",
)

# set operations, sorts
query(
    "t01_ordered_output",
    lambda t: t.tier1.select("place", "season_idx", "total").orderBy("place", "season_idx"),
    "SELECT place, season_idx, total FROM tier1 ORDER BY ALL",
    "total",
)
query(
    "t02_largest",
    lambda t: t.records.orderBy(F.col("size").desc(), "id").limit(20).select("id", "size"),
    "SELECT id, size FROM records ORDER BY size DESC, id LIMIT 20",
)
query(
    "t03_argmax_row",
    lambda t: t.records.groupBy("place").agg(F.max_by("id", F.struct("size", -F.col("id"))).alias("id")),
    "SELECT place, arg_max(id, (size, -id)) AS id FROM records GROUP BY ALL",
)
query(
    "t07_nearest_median",
    lambda t: with_quantiles(t.records.where("place = 'NATION_3'").select("id", "size"), "size", [0.5]).select("id", F.abs(F.col("size") - F.col("q")[0]).alias("d")).orderBy("d", "id").limit(1),
    "SELECT id, abs(size - (SELECT median(size) FROM records WHERE place = 'NATION_3')) AS d FROM records WHERE place = 'NATION_3' ORDER BY d, id LIMIT 1",
    "d",
)
query(
    "u01_union_all",
    lambda t: t.records.where("agency = 'F'").select("id").unionByName(t.records.where("agency = 'O'").select("id")),
    "SELECT id FROM records WHERE agency = 'F' UNION ALL SELECT id FROM records WHERE agency = 'O'",
)
query(
    "u02_difference",
    lambda t: t.raw.select("id").join(t.overlap.select(F.col("event").alias("id")), "id", "left_anti"),
    "SELECT id FROM raw EXCEPT SELECT event FROM overlap",
)
query(
    "u03_key_sets",
    lambda t: J.reconcile(t.grain.select("category"), t.records.select("category"), ["category"]),
    "SELECT 4::BIGINT AS both, 0::BIGINT AS left_only, count(DISTINCT category) - 4 AS right_only FROM records",
)
query("u04_distinct", lambda t: t.records.select("place", "parent").distinct(), "SELECT DISTINCT place, parent FROM records")
query(
    "u05_intersection",
    lambda t: t.raw.select("id").intersect(t.overlap.where("overlap > 40").select(F.col("event").alias("id"))),
    "SELECT id FROM raw INTERSECT SELECT event FROM overlap WHERE overlap > 40",
)
query(
    "j20_place_pairs",
    lambda t: t.tier1.where("season_year < 1999").groupBy("place").agg(F.avg("natural").alias("train")).join(t.tier1.where("season_year >= 1999").groupBy("place").agg(F.avg("natural").alias("test")), "place"),
    'SELECT place, avg("natural") FILTER (season_year < 1999) AS train, avg("natural") FILTER (season_year >= 1999) AS test FROM tier1 GROUP BY ALL',
    "train test",
)
query(
    "m03_forward_split",
    lambda t: t.tier1.groupBy((F.col("season_year") < CFG.test_start).alias("train")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT season_year < 1999 AS train, count(*) AS n FROM tier1 GROUP BY ALL",
)
query(
    "m01_global_prior",
    lambda t: R.global_prior(t.tier1, ["human", "natural", "unknown"], F.col("season_year") < CFG.test_start, "total").select("prior_human", "prior_natural", "prior_unknown").distinct(),
    'SELECT sum(human * total) / sum(total) AS prior_human, sum("natural" * total) / sum(total) AS prior_natural, sum(unknown * total) / sum(total) AS prior_unknown FROM tier1 WHERE season_year < 1999',
    "prior_human prior_natural prior_unknown",
)
