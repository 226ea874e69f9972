"""Queries that describe records, grains and panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as X
from ..operators import clean as C
from ..operators import contracts as V
from ..operators import covariates as Z
from ..operators import describe as D
from ..operators import grain as G
from ..operators import ranks as K
from ..operators import score as R
from ..operators import trailing as T
from ..operators.grain import composition
from ..operators.roster import roster, roster_sql
from .bindings import CFG, CLASS
from .grain_queries import MISS
from .panel_queries import BUCKET, CELLS, HEX, LAST, dealt_sql, hex_panel, rho_sql, start_forecast, tier1_forecast
from .registry import query


def flag():
    return C.missing_flag(CFG)


def n_rows():
    return F.count(F.lit(1))


def kind():
    return C.coarse_class(CFG)


# coverage and covariates
query(
    "a17_coverage",
    lambda t: t.overlap.join(t.supplier_grid.where("area > 0").select("cell", F.lit(1).alias("on")), "cell", "left").agg(n_rows().alias("rows_in"), F.count("on").alias("on_grid"), F.count_if(F.col("on").isNull()).alias("off_grid"), (100 * F.count("on") / n_rows()).alias("percent"), F.countDistinct(F.when(F.col("on") == 1, F.col("cell"))).alias("cells")),
    "SELECT count(*) AS rows_in, count(*) FILTER (area > 0) AS on_grid, count(*) FILTER (area <= 0) AS off_grid, 100.0 * count(*) FILTER (area > 0) / count(*) AS percent, count(DISTINCT cell) FILTER (area > 0) AS cells FROM overlap JOIN supplier_grid USING (cell)",
    "percent",
)
query(
    "a20_grid_monthly_mean",
    lambda t: Z.monthly_mean(t.monthly, ["place", "month"], ["v1", "v2"]),
    "SELECT place, month::VARCHAR AS month, avg(v1) AS v1, avg(v2) AS v2 FROM monthly GROUP BY ALL",
    "v1 v2",
)
query(
    "a21_weighted_monthly_mean",
    lambda t: Z.monthly_weighted_mean(t.monthly.withColumn("v1", F.when(F.col("v1") > 0.01, F.col("v1"))), ["place", "month"], "v1", F.col("cell") % 60),
    "SELECT place, month::VARCHAR AS month, sum(v1 * cos(radians(cell % 60))) FILTER (v1 > 0.01) / sum(cos(radians(cell % 60))) FILTER (v1 > 0.01) AS v1 FROM monthly GROUP BY ALL",
    "v1",
)
query(
    "a22_repeated_months",
    lambda t: Z.monthly_mean(t.monthly, ["cell", "month"], ["v3"]),
    "SELECT cell, month::VARCHAR AS month, avg(v3) AS v3 FROM monthly GROUP BY ALL",
    "v3",
)
_PRE = """SELECT p.place, s.season_idx, CASE WHEN count(m.v) = 3 THEN avg(m.v) END AS v1 FROM (SELECT DISTINCT place FROM monthly) p, (SELECT unnest(range(1, 26))::INT AS season_idx) s, (SELECT unnest([1, 2, 3]) AS k) k
  LEFT JOIN (SELECT place, month, avg(v1) AS v FROM monthly GROUP BY ALL) m ON m.place = p.place AND m.month = (CASE WHEN season_idx % 4 = 0 THEN make_date(1995 + season_idx // 4 - 1, 12, 1) ELSE make_date(1995 + season_idx // 4, (season_idx % 4) * 3, 1) END - to_months(k.k))::DATE GROUP BY ALL"""


def _preseason(t, emit_null=True):
    return Z.preseason_mean(Z.monthly_mean(t.monthly, ["place", "month"], ["v1"]), "place", "v1", 3, 1, 25, 1995, emit_null)


query("a23_preseason_mean", _preseason, _PRE, "v1")
query("a23_preseason_full_windows", lambda t: _preseason(t, False), f"SELECT * FROM ({_PRE}) WHERE v1 IS NOT NULL", "v1")
_PIX = "SELECT cell, sum(value) FILTER (kind = 'view') * 0.0001 / nullif(count(*) FILTER (kind = 'view'), 0) AS \"view\", sum(value) FILTER (kind = 'click') * 0.0001 / nullif(count(*) FILTER (kind = '{d}'), 0) AS click, (count(*) FILTER (kind = 'view'))::INT AS n_px FROM pixels GROUP BY ALL"
query("a24_pixel_mean", lambda t: Z.pixel_mean(t.pixels, t.pixels.select("cell").distinct(), ["view", "click"], 1e-4), _PIX.format(d="click"), "view click")
query(
    "a24_pixel_mean_legacy",
    lambda t: Z.pixel_mean(t.pixels, t.pixels.select("cell").distinct(), ["view", "click"], 1e-4, legacy=True),
    _PIX.format(d="view"),
    "view click",
)
query(
    "s12_windowed_pixels",
    lambda t: t.pixels.where("day between '2024-01-05' and '2024-01-15' and cell between 20 and 60 and kind in ('view', 'click')").groupBy("cell", "kind").agg(n_rows().alias("n")),
    "SELECT cell, kind, count(*) AS n FROM pixels WHERE day BETWEEN '2024-01-05' AND '2024-01-15' AND cell BETWEEN 20 AND 60 AND kind IN ('view', 'click') GROUP BY ALL",
)

# missing labels
for _key in ("agency", "state", "season_year", "season", "place"):
    query(f"a26_missing_by_{_key}", lambda t, k=_key: D.rates(t.records, [k], flag(), 100), f"SELECT {_key}, count(*) AS n, avg(({MISS})::INT) AS rate FROM records GROUP BY ALL HAVING count(*) >= 100", "rate")
query(
    "a26_missing_spread",
    lambda t: D.spread(D.rates(t.records, ["place"], flag(), 100), "rate"),
    f"SELECT max(rate) - min(rate) AS spread FROM (SELECT avg(({MISS})::INT) AS rate FROM records GROUP BY place HAVING count(*) >= 100)",
    "spread",
)
query(
    "a27_completeness",
    lambda t: D.completeness(t.raw.select("id", "category", F.when(F.col("area") > 0, F.col("area")).alias("area"))),
    "SELECT unnest(['id', 'category', 'area']) AS \"column\", unnest([avg((id IS NOT NULL)::INT), avg((category IS NOT NULL)::INT), avg((area > 0)::INT)]) AS known FROM raw",
    "known",
)
query(
    "a28_count_and_size_rates",
    lambda t: t.records.agg(F.avg(flag().cast("double")).alias("by_count"), (F.sum(F.when(flag(), F.col("size")).otherwise(0.0)) / F.sum("size")).alias("by_size")),
    f"SELECT avg(({MISS})::INT) AS by_count, sum(CASE WHEN {MISS} THEN size ELSE 0 END) / sum(size) AS by_size FROM records",
    "by_count by_size",
)
query(
    "a29_rate_by_size_bin",
    lambda t: D.rates(t.records.withColumn("bin", C.half_decade(F.col("size"))).where("bin is not null"), ["bin"], flag(), 5).withColumn("centre", F.pow(F.lit(10.0), (F.col("bin") - 0.5) / 2 - 2)),
    f"SELECT ceil((log10(size) + 2) * 2)::INT AS bin, count(*) AS n, avg(({MISS})::INT) AS rate, pow(10, (ceil((log10(size) + 2) * 2) - 0.5) / 2 - 2) AS centre FROM records WHERE size > 0.01 AND size <= 1e6 GROUP BY ALL HAVING count(*) >= 5",
    "rate centre",
)
query(
    "a29_rate_at_thresholds",
    lambda t: t.records.withColumn("at_least", F.explode(F.array(*map(F.lit, (1e4, 1e5, 3e5))))).where("size >= at_least").groupBy("at_least").agg(n_rows().alias("n"), F.avg(flag().cast("double")).alias("rate")),
    f"SELECT at_least, count(*) AS n, avg(({MISS})::INT) AS rate FROM records, (SELECT unnest([1e4, 1e5, 3e5])::DOUBLE AS at_least) WHERE size >= at_least GROUP BY ALL",
    "rate",
)
query(
    "a29_mix_by_size_bin",
    lambda t: D.shares(t.records.withColumns({"bin": C.half_decade(F.col("size")), "class": kind()}), ["bin"], "class", n_rows()),
    f"SELECT bin, class, count(*) AS value, count(*) / sum(count(*)) OVER (PARTITION BY bin) AS share FROM (SELECT CASE WHEN size > 0.01 AND size <= 1e6 THEN ceil((log10(size) + 2) * 2)::INT END AS bin, {CLASS} AS class FROM records) GROUP BY bin, class",
    "share",
)


def eras(t):
    early, late = F.col("season_year") < 1998, F.col("season_year") >= 1999
    miss = flag().cast("double")
    e = t.records.groupBy("place").agg(F.count_if(early).alias("n0"), F.count_if(late).alias("n1"), F.avg(F.when(early, miss)).alias("r0"), F.avg(F.when(late, miss)).alias("r1"), F.avg((kind() == "Natural").cast("double")).alias("natural_share"))
    return e.where("n0 >= 100 and n1 >= 100").withColumn("delta", F.col("r1") - F.col("r0"))


ERAS = f"SELECT place, avg(({MISS})::INT) FILTER (season_year >= 1999) - avg(({MISS})::INT) FILTER (season_year < 1998) AS delta, avg((category = '1-URGENT')::INT) AS natural_share FROM records GROUP BY place HAVING count(*) FILTER (season_year < 1998) >= 100 AND count(*) FILTER (season_year >= 1999) >= 100"
query("a30_era_delta", lambda t: eras(t).select("place", "delta", "natural_share"), ERAS, "delta natural_share")
query(
    "a30_era_correlation",
    lambda t: eras(t).agg(K.guarded_corr("delta", "natural_share").alias("r")),
    f"SELECT corr(delta, natural_share) AS r FROM ({ERAS})",
    "r",
)
_CROSS = "SELECT season, category, count(*) AS value, count(*) / sum(count(*)) OVER (PARTITION BY season) AS share FROM records GROUP BY season, category"
query("a31_crosstab", lambda t: D.shares(t.records, ["season"], "category", n_rows()), _CROSS, "share")
query(
    "a31_swing",
    lambda t: D.shares(t.records, ["season"], "category", n_rows()).groupBy("category").agg((F.max("share") - F.min("share")).alias("swing")).orderBy(F.col("swing").desc(), "category"),
    f"SELECT category, max(share) - min(share) AS swing FROM ({_CROSS}) GROUP BY ALL",
    "swing",
)


def _lead_sql(value: str) -> str:
    return f"SELECT place, category AS leader, v / s AS share FROM (SELECT place, category, {value} AS v, sum({value}) OVER (PARTITION BY place) AS s, row_number() OVER (PARTITION BY place ORDER BY {value} DESC, category) AS r FROM records WHERE NOT {MISS} GROUP BY place, category) WHERE r = 1"


def lead(t, value):
    return D.leaders(t.records.where(~flag()), ["place"], "category", value)


query("a32_leader_by_count", lambda t: lead(t, n_rows()), _lead_sql("count(*)"), "share")
query("a32_leader_by_size", lambda t: lead(t, F.sum("size")), _lead_sql("sum(size)"), "share")
query(
    "a33_leader_disagreement",
    lambda t: lead(t, n_rows()).select("place", F.col("leader").alias("a")).join(lead(t, F.sum("size")).select("place", F.col("leader").alias("b")), "place").agg(n_rows().alias("places"), F.count_if(F.col("a") != F.col("b")).alias("differ")),
    f"SELECT count(*) AS places, count(*) FILTER (a.leader <> b.leader) AS differ FROM ({_lead_sql('count(*)')}) a JOIN ({_lead_sql('sum(size)')}) b USING (place)",
)
query(
    "a34_above_threshold",
    lambda t: K.with_quantiles(t.records.select("size"), "size", [0.99]).agg((F.sum(F.when(F.col("size") >= F.col("q")[0], F.col("size"))) / F.sum("size")).alias("share")),
    "SELECT sum(size) FILTER (size >= (SELECT quantile_cont(size, 0.99) FROM records)) / sum(size) AS share FROM records",
    "share",
)
query(
    "a35_concentration",
    lambda t: D.concentration(t.acres, ["place", "season_idx"], "size_total").groupBy((F.col("season_idx") % 4).alias("ord")).agg(F.avg("hhi").alias("hhi"), F.avg("top").alias("top")),
    "SELECT season_idx % 4 AS ord, avg(hhi) AS hhi, avg(top) AS top FROM (SELECT place, season_idx, sum(size_total * size_total) / nullif(sum(size_total) ** 2, 0) AS hhi, max(size_total) / nullif(sum(size_total), 0) AS top FROM acres GROUP BY ALL) GROUP BY ALL",
    "hhi top",
)
query(
    "a36_summary",
    lambda t: D.summary(t.records, "size"),
    "SELECT count(size) AS n, avg(size) AS mean, stddev_samp(size) AS std, min(size) AS low, " + ", ".join(f"quantile_cont(size, {q}) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", max(size) AS high FROM records",
    "mean std low p10 p25 p50 p75 p90 high",
)
query(
    "a37_category_by_year",
    lambda t: D.shares(C.collapse_tail(t.records.where(~flag()), "category", 2), ["season_year"], "category", F.sum("size")),
    f"SELECT season_year, c AS category, sum(size) AS value, sum(size) / sum(sum(size)) OVER (PARTITION BY season_year) AS share FROM (SELECT season_year, size, CASE WHEN category IN (SELECT category FROM records WHERE NOT {MISS} GROUP BY category ORDER BY count(*) DESC, category LIMIT 2) THEN category ELSE 'Other' END AS c FROM records WHERE NOT {MISS}) GROUP BY season_year, c",
    "value share",
)
_YEARLY = f"SELECT season_year, avg(({MISS})::INT) AS by_count, sum(CASE WHEN {MISS} THEN size ELSE 0 END) / sum(size) AS by_size FROM records GROUP BY ALL"


def yearly(t):
    return t.records.groupBy("season_year").agg(F.avg(flag().cast("double")).alias("by_count"), (F.sum(F.when(flag(), F.col("size")).otherwise(0.0)) / F.sum("size")).alias("by_size"))


query("a38_missing_by_year", yearly, _YEARLY, "by_count by_size")
query(
    "a38_first_and_last_years",
    lambda t: yearly(t).agg(F.avg(F.when(F.col("season_year") <= 1996, F.col("by_count"))).alias("first"), F.avg(F.when(F.col("season_year") >= 2000, F.col("by_count"))).alias("last")),
    f"SELECT avg(by_count) FILTER (season_year <= 1996) AS first, avg(by_count) FILTER (season_year >= 2000) AS last FROM ({_YEARLY})",
    "first last",
)
query(
    "a39_shares_above",
    lambda t: t.records.groupBy("season_year").agg(n_rows().alias("n"), *[F.avg((F.col("size") >= v).cast("double")).alias(f"over_{k}") for k, v in (("100k", 1e5), ("300k", 3e5))]),
    "SELECT season_year, count(*) AS n, avg((size >= 1e5)::INT) AS over_100k, avg((size >= 3e5)::INT) AS over_300k FROM records GROUP BY ALL",
    "over_100k over_300k",
)
_YC = "SELECT category, season_year, count(*)::DOUBLE AS n, sum(size) AS size FROM records GROUP BY ALL"


def year_category(t):
    return t.records.groupBy("category", "season_year").agg(n_rows().cast("double").alias("n"), F.sum("size").alias("size"))


query(
    "a40_trends",
    lambda t: D.trend(year_category(t), ["category"], "season_year", "n"),
    f"SELECT category, regr_slope(n, season_year) AS slope, regr_intercept(n, season_year) AS intercept FROM ({_YC}) GROUP BY ALL",
    "slope intercept",
)
query(
    "a40_detrended_correlation",
    lambda t: D.detrended_correlation(year_category(t), ["category"], "season_year", "n", "size"),
    f"SELECT category, corr(ra, rb) AS r FROM (SELECT category, n - regr_intercept(n, season_year) OVER w - regr_slope(n, season_year) OVER w * season_year AS ra, size - regr_intercept(size, season_year) OVER w - regr_slope(size, season_year) OVER w * season_year AS rb FROM ({_YC}) WINDOW w AS (PARTITION BY category)) GROUP BY ALL",
    "r",
)
_WITHIN = "SELECT place, category, corr(n, mean_size) AS r, sum(n) AS w FROM (SELECT place, category, season_year, count(*)::DOUBLE AS n, avg(size) AS mean_size FROM records GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 6 AND stddev_pop(n) > 0 AND stddev_pop(mean_size) > 0"


def within(t):
    cells = t.records.groupBy("place", "category", "season_year").agg(n_rows().cast("double").alias("n"), F.avg("size").alias("mean_size"))
    return cells.groupBy("place", "category").agg(n_rows().alias("years"), K.guarded_corr("n", "mean_size").alias("r"), F.sum("n").alias("w")).where("years >= 6 and r is not null").drop("years")


query(
    "a41_within_cell_correlation",
    lambda t: within(t).agg(X.weighted_mean(F.col("r"), F.col("w")).alias("r")),
    f"SELECT sum(r * w) / sum(w) AS r FROM ({_WITHIN})",
    "r",
)
query(
    "a41_leave_one_out",
    lambda t: within(t).groupBy("category").agg(F.sum(F.col("r") * F.col("w")).alias("rw"), F.sum("w").alias("w")).select("category", ((F.sum("rw").over(Window.partitionBy(F.lit(1))) - F.col("rw")) / (F.sum("w").over(Window.partitionBy(F.lit(1))) - F.col("w"))).alias("r")),
    f"SELECT category, (sum(sum(r * w)) OVER () - sum(r * w)) / (sum(sum(w)) OVER () - sum(w)) AS r FROM ({_WITHIN}) GROUP BY category",
    "r",
)
query(
    "a42_dispersion",
    lambda t: D.dispersion(t.starts, ["season_idx"], "starts_total"),
    "SELECT season_idx, avg(starts_total) AS mean, var_samp(starts_total) AS variance, var_samp(starts_total) / nullif(avg(starts_total), 0) AS ratio, avg((starts_total = 0)::INT) AS zeros, exp(-avg(starts_total)) AS poisson_zeros, max(starts_total) AS high FROM starts GROUP BY ALL",
    "mean variance ratio zeros poisson_zeros",
)
_LAG = "SELECT cell, season_idx, starts_total AS y, coalesce(sum(starts_total) OVER (PARTITION BY cell ORDER BY season_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS lag4, coalesce(season_idx - max(CASE WHEN starts_total > 0 THEN season_idx END) OVER (PARTITION BY cell ORDER BY season_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 26) AS since FROM starts"


def lagged(t):
    return t.starts.select("cell", "season_idx", F.col("starts_total").alias("y"), T.trailing_sum("starts_total", ["cell"], 4).alias("lag4"), T.since_last("starts_total", ["cell"], 26).alias("since"))


query(
    "a43_ratio_of_means",
    lambda t: lagged(t).agg(X.ratio(F.avg(F.when(F.col("lag4") > 0, F.col("y"))), F.avg(F.when(F.col("lag4") == 0, F.col("y")))).alias("ratio")),
    f"SELECT avg(y) FILTER (lag4 > 0) / avg(y) FILTER (lag4 = 0) AS ratio FROM ({_LAG})",
    "ratio",
)
query(
    "a44_decay",
    lambda t: lagged(t).groupBy(F.when(F.col("since") <= 4, "1").when(F.col("since") <= 12, "2-3").when(F.col("since") < 26, "4+").otherwise("never").alias("years")).agg(n_rows().alias("n"), F.avg("y").alias("mean")),
    f"SELECT CASE WHEN since <= 4 THEN '1' WHEN since <= 12 THEN '2-3' WHEN since < 26 THEN '4+' ELSE 'never' END AS years, count(*) AS n, avg(y) AS mean FROM ({_LAG}) GROUP BY ALL",
    "mean",
)
query(
    "a45_seasonality",
    lambda t: D.shares(t.records, [], "season", F.sum("size")).drop("value"),
    "SELECT season, sum(size) / sum(sum(size)) OVER () AS share FROM records GROUP BY season",
    "share",
)
_WEEK = f"SELECT k.kind, w.week, coalesce(n, 0) / 6.0 AS per_year FROM (SELECT DISTINCT {CLASS} AS kind FROM records) k CROSS JOIN (SELECT unnest(range(0, 52))::INT AS week) w LEFT JOIN (SELECT {CLASS} AS kind, (least(dayofyear(date) - 1, 363) // 7)::INT AS week, count(*) AS n FROM records GROUP BY ALL) s ON s.kind = k.kind AND s.week = w.week"
query("a46_week_curves", lambda t: D.week_curves(t.records, kind(), 6), _WEEK, "per_year")
query(
    "a46_peak_week",
    lambda t: D.week_curves(t.records, kind(), 6).groupBy("kind").agg(F.max_by("week", F.struct("per_year", -F.col("week"))).alias("peak")),
    f"SELECT kind, arg_max(week, (per_year, -week)) AS peak FROM ({_WEEK}) GROUP BY ALL",
)
query(
    "a73_peak_detail",
    lambda t: _peak(t),
    f"""WITH y AS (SELECT year(date) AS y, (least(dayofyear(date) - 1, 363) // 7)::INT AS week, count(*) AS n FROM raw GROUP BY ALL), p AS (SELECT arg_max(week, (n, -week)) AS week FROM (SELECT week, sum(n) AS n FROM y WHERE week BETWEEN 20 AND 40 GROUP BY ALL))
  SELECT week, avg(n) AS mean, median(n) AS mid, max(n) AS high FROM y JOIN p USING (week) GROUP BY ALL""".replace("WITH y", "SELECT * FROM (WITH y") + ")",
    "mean mid",
)


def _peak(t):
    y = t.raw.groupBy(F.year("date").alias("y"), F.floor(F.least(F.dayofyear("date") - 1, F.lit(363)) / 7).cast("int").alias("week")).agg(n_rows().alias("n"))
    peak = y.where("week between 20 and 40").groupBy("week").agg(F.sum("n").alias("n")).agg(F.max_by("week", F.struct("n", -F.col("week"))).alias("week"))
    return y.join(F.broadcast(peak), "week").groupBy("week").agg(F.avg("n").alias("mean"), F.median("n").alias("mid"), F.max("n").alias("high"))


_DOM = 'SELECT place, sum("natural" * total) / sum(total * (1 - unknown)) AS natural_share, sum(unknown * total) / sum(total) AS unknown_share FROM tier1 GROUP BY ALL'


def dominance(t):
    return t.tier1.groupBy("place").agg(X.ratio(F.sum(F.col("natural") * F.col("total")), F.sum(F.col("total") * (1 - F.col("unknown")))).alias("natural_share"), X.ratio(F.sum(F.col("unknown") * F.col("total")), F.sum("total")).alias("unknown_share"))


query("a47_dominance", dominance, _DOM, "natural_share unknown_share")
_VOL = 'SELECT place, stddev_samp(s) AS volatility, abs(avg(s) - 0.5) AS commitment, count(*) AS years FROM (SELECT place, season_year, sum("natural" * total) / sum(total * (1 - unknown)) AS s FROM tier1 GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 4'


def volatility(t):
    y = t.tier1.groupBy("place", "season_year").agg(X.ratio(F.sum(F.col("natural") * F.col("total")), F.sum(F.col("total") * (1 - F.col("unknown")))).alias("s"))
    return y.groupBy("place").agg(F.stddev_samp("s").alias("volatility"), F.abs(F.avg("s") - 0.5).alias("commitment"), n_rows().alias("years")).where("years >= 4")


query("a48_volatility", volatility, _VOL, "volatility commitment")
query(
    "a48_volatility_correlation",
    lambda t: volatility(t).agg(K.guarded_corr("volatility", "commitment").alias("r")),
    f"SELECT corr(volatility, commitment) AS r FROM ({_VOL})",
    "r",
)
query(
    "a74_bands",
    lambda t: dominance(t).agg(F.count_if(F.col("natural_share") < 0.2).alias("low"), F.count_if(F.col("natural_share").between(0.2, 0.8)).alias("mid"), F.count_if(F.col("natural_share") > 0.8).alias("high"), F.median("natural_share").alias("median")),
    f"SELECT count(*) FILTER (natural_share < 0.2) AS low, count(*) FILTER (natural_share BETWEEN 0.2 AND 0.8) AS mid, count(*) FILTER (natural_share > 0.8) AS high, median(natural_share) AS median FROM ({_DOM})",
    "median",
)
_LAND = "SELECT place, sum(size) AS source, sum(size * on_) AS landed FROM (SELECT place, size, (EXISTS (SELECT 1 FROM overlap o WHERE o.event = r.id))::INT AS on_ FROM records r) GROUP BY ALL"
query(
    "a49_reconciliation",
    lambda t: t.records.join(t.overlap.select(F.col("event").alias("id"), F.lit(1.0).alias("on")).distinct(), "id", "left").groupBy("place").agg(F.sum("size").alias("source"), F.sum(F.col("size") * F.coalesce("on", F.lit(0.0))).alias("landed")).withColumn("percent", 100 * F.col("landed") / F.col("source")),
    f"SELECT *, 100 * landed / source AS percent FROM ({_LAND})",
    "source landed percent",
)
query(
    "a50_event_spread",
    lambda t: t.overlap.groupBy("event").agg(n_rows().alias("cells"), F.sum("overlap").alias("s"), F.max("overlap").alias("m")).agg(F.avg("cells").alias("cells"), F.avg((F.col("cells") > 1).cast("double")).alias("multi"), ((F.sum("s") - F.sum("m")) / F.sum("s")).alias("outside")),
    "SELECT avg(cells) AS cells, avg((cells > 1)::INT) AS multi, (sum(s) - sum(m)) / sum(s) AS outside FROM (SELECT count(*) AS cells, sum(overlap) AS s, max(overlap) AS m FROM overlap GROUP BY event)",
    "cells multi outside",
)
query(
    "a51_ratio_per_place",
    lambda t: K.average_ranks(_ratio(t), "per").join(_ratio(t), "per").select("place", "per", (F.col("rank") / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).alias("pct")),  # a row per place
    "SELECT place, per, (rank() OVER (ORDER BY per) + (count(*) OVER (PARTITION BY per) - 1) / 2.0) / count(*) OVER () AS pct FROM (SELECT place, sum(size) / count(*) AS per FROM records GROUP BY place HAVING count(*) >= 30)",
    "per pct",
)


def _ratio(t):
    return t.records.groupBy("place").agg(F.round(F.sum("size") / n_rows(), 6).alias("per"), n_rows().alias("n")).where("n >= 30").select("place", "per")


query(
    "a52_volatility_profile",
    lambda t: t.records.groupBy("place", "season_year").agg(F.sum("size").alias("s")).groupBy("place").agg(F.sum("s").alias("total"), F.avg("s").alias("mean"), F.max("s").alias("high"), (F.stddev_samp("s") / F.avg("s")).alias("cv"), F.stddev_samp(F.log10("s")).alias("log_sd"), (F.sum(F.col("s") * F.col("s")) / (F.sum("s") * F.sum("s"))).alias("hhi"), (F.max("s") / F.sum("s")).alias("top")),
    "SELECT place, sum(s) AS total, avg(s) AS mean, max(s) AS high, stddev_samp(s) / avg(s) AS cv, stddev_samp(log10(s)) AS log_sd, sum(s * s) / sum(s) ** 2 AS hhi, max(s) / sum(s) AS top FROM (SELECT place, season_year, sum(size) AS s FROM records GROUP BY ALL) GROUP BY ALL",
    "total mean high cv log_sd hhi top",
)
_COV = "UNPIVOT (SELECT place, human, log_total, n::DOUBLE AS n FROM tier1) ON log_total, n INTO NAME covariate VALUE v"
query(
    "a53_place_rank_correlations",
    lambda t: K.spearman(t.tier1.select("place", "human", F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in ("log_total", "n")])).alias("r")).select("place", "human", "r.*"), "human", "v", ["place", "covariate"]).groupBy("covariate").agg(F.count_if(F.col("rho") > 0).alias("positive"), F.max(F.abs("rho")).alias("best")),
    f"SELECT covariate, count(*) FILTER (rho > 0) AS positive, max(abs(rho)) AS best FROM ({rho_sql(_COV, 'human', 'v', 'place, covariate')}) GROUP BY ALL",
    "best",
)
_TRI = f"SELECT *, avg(unknown) {LAST.format(k=7)} AS p FROM tier1"


def triage(t):
    return t.tier1.withColumn("p", T.trailing_mean("unknown", ["place", "season"], 7)).where("season_year >= 1999 and p is not null")


query(
    "a55_triage",
    lambda t: triage(t).groupBy("place", "season").agg(F.sum(F.col("p") * F.col("total")).alias("expected"), F.avg("p").alias("mean_predicted"), F.avg("unknown").alias("mean_actual")).orderBy(F.col("expected").desc(), "place", "season").limit(20),
    f"SELECT place, season, sum(p * total) AS expected, avg(p) AS mean_predicted, avg(unknown) AS mean_actual FROM ({_TRI}) WHERE season_year >= 1999 AND p IS NOT NULL GROUP BY ALL ORDER BY expected DESC, place, season LIMIT 20",
    "expected mean_predicted mean_actual",
)
query(
    "a56_gate",
    lambda t: t.starts.join(t.acres.select("cell", "season_idx", "size_natural"), ["cell", "season_idx"]).agg(F.avg(F.when(F.col("starts_human") == 0, (F.col("size_natural") >= 2e5).cast("double"))).alias("without"), F.avg(F.when(F.col("starts_human") > 0, (F.col("size_natural") >= 2e5).cast("double"))).alias("with")),
    'SELECT avg((size_natural >= 2e5)::INT) FILTER (starts_human = 0) AS without, avg((size_natural >= 2e5)::INT) FILTER (starts_human > 0) AS "with" FROM starts JOIN (SELECT cell, season_idx, size_natural FROM acres) USING (cell, season_idx)',
    "without with",
)
query(
    "a57_dial",
    lambda t: t.starts.where("starts_total > 0").join(t.acres.select("cell", "season_idx", "size_total"), ["cell", "season_idx"]).groupBy(F.when(F.col("starts_total") == 1, "1").when(F.col("starts_total") == 2, "2").otherwise("3+").alias("starts")).agg(n_rows().alias("n"), F.avg((F.col("size_total") >= 4e5).cast("double")).alias("big"), (F.count_if(F.col("size_total") >= 4e5) / F.sum("starts_total")).alias("per_start")),
    "SELECT CASE WHEN starts_total = 1 THEN '1' WHEN starts_total = 2 THEN '2' ELSE '3+' END AS starts, count(*) AS n, avg((size_total >= 4e5)::INT) AS big, count(*) FILTER (size_total >= 4e5) / sum(starts_total) AS per_start FROM starts JOIN (SELECT cell, season_idx, size_total FROM acres) USING (cell, season_idx) WHERE starts_total > 0 GROUP BY ALL",
    "big per_start",
)
_PM = "SELECT cell, day, avg(value) AS v FROM pixels WHERE kind = 'view' GROUP BY ALL"
query(
    "a59_variance_split",
    lambda t: t.pixels.where("kind = 'view'").groupBy("cell", "day").agg(F.avg("value").alias("v")).groupBy("cell").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).agg(F.stddev_samp("m").alias("between"), F.avg("s").alias("within"), n_rows().alias("cells")).withColumn("ratio", F.col("between") / F.col("within")),
    f'SELECT stddev_samp(m) AS "between", avg(s) AS "within", count(*) AS cells, stddev_samp(m) / avg(s) AS ratio FROM (SELECT cell, avg(v) AS m, stddev_samp(v) AS s FROM ({_PM}) GROUP BY cell)',
    "between within ratio",
)
query(
    "a60_split_half",
    lambda t: K.spearman(t.tier1.groupBy("place").agg(F.avg(F.when(F.col("season_year") < 1998, F.col("human"))).alias("a"), F.avg(F.when(F.col("season_year") >= 1998, F.col("human"))).alias("b")), "a", "b"),
    rho_sql("SELECT avg(human) FILTER (season_year < 1998) AS a, avg(human) FILTER (season_year >= 1998) AS b FROM tier1 GROUP BY place", "a", "b"),
    "rho",
)
query(
    "a61_solo_event",
    lambda t: D.solo_event(t.raw.where("id % 3 = 0").select("id", "size", (F.col("id") % 4001).alias("perimeter")), 1000.0),
    "WITH s AS (SELECT id, size FROM (SELECT id, size, count(*) OVER (PARTITION BY id % 4001) AS n FROM raw WHERE id % 3 = 0) WHERE n = 1 AND size >= 1000) SELECT id, size FROM s ORDER BY abs(size - (SELECT median(size) FROM s)), id LIMIT 1".replace("WITH s AS", "SELECT * FROM (WITH s AS") + ")",
)
query(
    "a66_place_ordering",
    lambda t: t.records.groupBy("place").agg(F.avg("size").alias("mean"), F.stddev_samp("size").alias("std"), n_rows().alias("n")).orderBy(F.col("mean").desc()),
    "SELECT place, avg(size) AS mean, stddev_samp(size) AS std, count(*) AS n FROM records GROUP BY ALL",
    "mean std",
)
query("a67_yearly_counts", lambda t: t.records.groupBy("season_year").agg(n_rows().alias("n")), "SELECT season_year, count(*) AS n FROM records GROUP BY ALL")
query(
    "a67_top_states_share",
    lambda t: t.records.groupBy("state").agg(n_rows().alias("n")).withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc(), "state"))).agg((F.sum(F.when(F.col("r") <= 3, F.col("n"))) / F.sum("n")).alias("share")),
    "SELECT sum(n) FILTER (r <= 3) / sum(n) AS share FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, state) AS r FROM records GROUP BY state)",
    "share",
)
query(
    "a68_source_profile",
    lambda t: t.table("events").where("event_type = 'click'").groupBy("props").agg(n_rows().alias("n")).orderBy(F.col("n").desc(), "props").limit(10),
    "SELECT props, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL ORDER BY n DESC, props LIMIT 10",
)
query(
    "a69_overall_composition",
    lambda t: t.human.agg(*[(F.sum(F.col(c) * F.col("human_size")) / F.sum("human_size")).alias(c) for c in ("h0", "h1", "h2")]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("share")) for c in ("h0", "h1", "h2")])).alias("r")).select("r.*"),
    "UNPIVOT (SELECT sum(h0 * human_size) / sum(human_size) AS h0, sum(h1 * human_size) / sum(human_size) AS h1, sum(h2 * human_size) / sum(human_size) AS h2 FROM human) ON h0, h1, h2 INTO NAME category VALUE share",
    "share",
)
query(
    "a70_grid_summary",
    lambda t: t.supplier_grid.groupBy("place").agg(n_rows().alias("cells"), F.sum("area").alias("land")),
    "SELECT place, count(*) AS cells, sum(area) AS land FROM supplier_grid GROUP BY ALL",
    "land",
)
query(
    "a71_panel_profile",
    lambda t: t.starts.agg(*[F.struct(F.sum(c).alias("total"), F.avg((F.col(c) > 0).cast("double")).alias("nonzero")).alias(c) for c in ("starts_natural", "starts_human", "starts_unknown")]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.total").alias("total"), F.col(f"{c}.nonzero").alias("nonzero")) for c in ("starts_natural", "starts_human", "starts_unknown")])).alias("r")).select("r.*"),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", sum({c})::BIGINT AS total, avg(({c} > 0)::INT) AS nonzero FROM starts" for c in ("starts_natural", "starts_human", "starts_unknown")),
    "nonzero",
)
query(
    "a75_matched_rate",
    lambda t: t.raw.join(t.overlap.select(F.col("event").alias("id"), F.lit(1).alias("on")).distinct(), "id", "left").groupBy("state").agg(n_rows().alias("n"), F.avg(F.col("on").isNotNull().cast("double")).alias("matched")),
    "SELECT state, count(*) AS n, avg((id IN (SELECT event FROM overlap))::INT) AS matched FROM raw GROUP BY ALL",
    "matched",
)
query(
    "a76_covariate_coverage",
    lambda t: D.completeness(_preseason(t).select("v1")),
    f"SELECT 'v1' AS \"column\", avg((v1 IS NOT NULL)::INT) AS known FROM ({_PRE})",
    "known",
)
query(
    "a77_place_season_by_year",
    lambda t: t.spark.range(1995, 2002).select(F.col("id").cast("int").alias("season_year")).join(t.tier1.where("place = 'NATION_3' and season = 'JJA'").select("season_year", "human", "natural", "unknown"), "season_year", "left").fillna(0.0, ["human", "natural", "unknown"]),
    "SELECT y.season_year, coalesce(human, 0) AS human, coalesce(\"natural\", 0) AS \"natural\", coalesce(unknown, 0) AS unknown FROM (SELECT unnest(range(1995, 2002))::INT AS season_year) y LEFT JOIN (SELECT * FROM tier1 WHERE place = 'NATION_3' AND season = 'JJA') USING (season_year)",
    "human natural unknown",
)
query("a63_fingerprint", lambda t: V.fingerprint(t.records))
_SUMMED = ("id", "size", "cell", "area", "season_year", "season_idx")
_COUNTED = ("date", "category", "place", "parent", "state", "agency", "season")
query(
    "a63_fingerprint_counts",
    lambda t: V.fingerprint(t.records).drop("content"),
    f"SELECT count(*) AS rows, {len(_SUMMED + _COUNTED)} AS columns, " + ", ".join([*(f"sum({c}::DECIMAL(38, 6))::DOUBLE AS sum_{c}" for c in _SUMMED), *(f"count(DISTINCT {c}) AS distinct_{c}" for c in _COUNTED)]) + " FROM records",
    " ".join(f"sum_{c}" for c in _SUMMED),
)


def contract(t):
    """All records, so the two checks of the exclusion find what P1 would drop."""
    return roster(t.records, t.grain, t.tier1, t.starts, CFG)


query("a65_validation_roster", contract, roster_sql(CFG))
query(
    "a65_roster_after_exclusion",
    lambda t: roster(t.kept, t.kept_grain, composition(t.kept_grain, CFG, with_counts=True), t.starts, CFG),
    roster_sql(CFG, "kept", "kept_grain", "kept_tier1"),
)
query(
    "a64_structure",
    lambda t: t.starts.agg(n_rows().alias("rows"), F.countDistinct("cell", "season_idx").alias("keys"), F.min("season_idx").alias("lo"), F.max("season_idx").alias("hi")),
    "SELECT count(*) AS rows, count(DISTINCT (cell, season_idx)) AS keys, min(season_idx) AS lo, max(season_idx) AS hi FROM starts",
)

# predictors and their comparison
_P7 = f"SELECT *, avg(log_total) {LAST.format(k=6)} AS p_log FROM (SELECT *, avg(human) {LAST.format(k=7)} AS ph, avg(\"natural\") {LAST.format(k=7)} AS pn, avg(unknown) {LAST.format(k=7)} AS pu FROM tier1)"
query(
    "m04_profile",
    lambda t: tier1_forecast(t).withColumn("p_log", T.trailing_mean("log_total", ["place", "season"], 6)).where("season_year >= 1999 and p_log is not null").select("place", "season_idx", *[(F.col(f"p_{c}") * F.pow(F.lit(10.0), F.col("p_log"))).alias(c) for c in ("human", "natural", "unknown")]),
    f'SELECT place, season_idx, ph * pow(10, p_log) AS human, pn * pow(10, p_log) AS "natural", pu * pow(10, p_log) AS unknown FROM ({_P7}) WHERE season_year >= 1999 AND p_log IS NOT NULL',
    "human natural unknown",
)


def three_predictors(t):
    f = R.global_prior(tier1_forecast(t), ["human", "natural", "unknown"], F.col("season_year") < CFG.test_start)
    kinds = {"history": [F.col(f"p_{c}") for c in ("human", "natural", "unknown")], "prior": [F.col(f"prior_{c}") for c in ("human", "natural", "unknown")], "even": [F.lit(1.0) / 3] * 3}
    rows = f.where("season_year >= 1999 and p_human is not null").select("place", "season_idx", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("predictor"), X.tvd(p, [F.col(c) for c in ("human", "natural", "unknown")]).alias("tvd")) for k, p in kinds.items()])).alias("r"))
    return rows.select("place", "season_idx", "total", "r.*")


_PRIOR = 'SELECT avg(human) AS gh, avg("natural") AS gn, avg(unknown) AS gu FROM tier1 WHERE season_year < 1999'
_THREE = f"""SELECT predictor, tvd, total FROM (SELECT total, 0.5 * (abs(ph - human) + abs(pn - "natural") + abs(pu - unknown)) AS history, 0.5 * (abs(gh - human) + abs(gn - "natural") + abs(gu - unknown)) AS prior,
  0.5 * (abs(1 / 3 - human) + abs(1 / 3 - "natural") + abs(1 / 3 - unknown)) AS even FROM ({_P7}), ({_PRIOR}) WHERE season_year >= 1999 AND ph IS NOT NULL) UNPIVOT (tvd FOR predictor IN (history, prior, even))"""
query(
    "m05_three_predictors",
    lambda t: three_predictors(t).groupBy("predictor").agg(n_rows().alias("n"), F.avg("tvd").alias("plain"), X.weighted_mean(F.col("tvd"), F.col("total")).alias("weighted")),
    f"SELECT predictor, count(*) AS n, avg(tvd) AS plain, sum(tvd * total) / sum(total) AS weighted FROM ({_THREE}) GROUP BY ALL",
    "plain weighted",
)
_POINTS = f"SELECT predictor, v, (sum(w) OVER (PARTITION BY predictor ORDER BY v) - w / 2) / sum(w) OVER (PARTITION BY predictor) AS pos FROM (SELECT predictor, round(tvd, 12) AS v, sum(total) AS w FROM ({_THREE}) GROUP BY ALL)"
query(
    "m05_error_quantiles",
    lambda t: R.weighted_quantiles(three_predictors(t).withColumn("tvd", F.round("tvd", 12)), ["predictor"], "tvd", "total", [0.25, 0.5, 0.75]),
    f"""SELECT predictor, q, CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL THEN lo.v ELSE lo.v + (hi.v - lo.v) * (q - lo.pos) / (hi.pos - lo.pos) END AS value
    FROM (SELECT predictor, q, max({{'pos': pos, 'v': v}}) FILTER (pos < q) AS lo, min({{'pos': pos, 'v': v}}) FILTER (pos >= q) AS hi
      FROM ({_POINTS}), (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q) GROUP BY ALL)""",
    "value",
)
_H7 = "SELECT *, " + ", ".join(f"avg(h{i}) {LAST.format(k=7)} AS p{i}" for i in range(3)) + f", stddev_samp(h0) {LAST.format(k=7)} AS sd FROM human"


def human_forecast(t):
    return t.human.withColumns({f"p{i}": T.trailing_mean(f"h{i}", ["place", "season"], 7) for i in range(3)} | {"sd": T.trailing_std("h0", ["place", "season"], 7)})


_HARG = "CASE WHEN {a}0 >= {a}1 AND {a}0 >= {a}2 THEN 1 WHEN {a}1 >= {a}2 THEN 2 ELSE 3 END"
query(
    "m06_human_top1",
    lambda t: human_forecast(t).where("season_year >= 1999 and p0 is not null").select("human_size", X.top1_hit([F.col(f"p{i}") for i in range(3)], [F.col(f"h{i}") for i in range(3)]).alias("hit")).agg(n_rows().alias("n"), F.avg("hit").alias("plain"), X.weighted_mean(F.col("hit"), F.col("human_size")).alias("weighted")),
    f"SELECT count(*) AS n, avg(hit) AS plain, sum(hit * human_size) / sum(human_size) AS weighted FROM (SELECT human_size, ({_HARG.format(a='p')} = {_HARG.format(a='h')})::INT AS hit FROM ({_H7}) WHERE season_year >= 1999 AND p0 IS NOT NULL)",
    "plain weighted",
)
query(
    "m07_feature_table",
    lambda t: t.tier1.select("place", "season_idx", T.trailing_mean("log_total", ["place", "season"], 7).alias("f_level"), T.trailing_std("log_total", ["place", "season"], 7).alias("f_level_sd"), T.trailing_mean("human", ["place", "season"], 7).alias("f_human"), T.trailing_mean("log_mean_size", ["place", "season"], 7).alias("f_size"), T.depth(["place", "season"]).alias("f_depth"), "human", "log_total"),
    f"SELECT place, season_idx, avg(log_total) {LAST.format(k=7)} AS f_level, stddev_samp(log_total) {LAST.format(k=7)} AS f_level_sd, avg(human) {LAST.format(k=7)} AS f_human, avg(log_mean_size) {LAST.format(k=7)} AS f_size, (row_number() OVER (PARTITION BY place, season ORDER BY season_idx) - 1)::INT AS f_depth, human, log_total FROM tier1",
    "f_level f_level_sd f_human f_size human log_total",
)
_CONF = f"SELECT season, sd, abs(ph - human) AS err, total FROM (SELECT *, avg(human) {LAST.format(k=7)} AS ph, stddev_samp(human) {LAST.format(k=7)} AS sd FROM tier1) WHERE season_year >= 1999 AND sd IS NOT NULL"


def confidence(t):
    return t.tier1.withColumns({"ph": T.trailing_mean("human", ["place", "season"], 7), "sd": T.trailing_std("human", ["place", "season"], 7)}).where("season_year >= 1999 and sd is not null").withColumn("err", F.abs(F.col("ph") - F.col("human")))


query("m15_confidence_signal", lambda t: K.spearman(confidence(t), "sd", "err"), rho_sql(_CONF, "sd", "err"), "rho")
query(
    "m15_confidence_within_season",
    lambda t: K.spearman(confidence(t), "sd", "err", ["season"]).where("n >= 20"),
    f"SELECT * FROM ({rho_sql(_CONF, 'sd', 'err', 'season')}) WHERE n >= 20",
    "rho",
)


def _confidence_buckets(t):
    rows = K.quartile_bucket(confidence(t).select("sd", "err", "total"), "sd")
    sums = rows.groupBy("bucket").agg(n_rows().alias("n"), F.avg("err").alias("mean"), X.weighted_mean(F.col("err"), F.col("total")).alias("weighted"), F.max("err").alias("worst"))
    return sums.join(K.quantiles(rows, "err", [0.1], ["bucket"]).select("bucket", F.col("q")[0].alias("p10")), "bucket")


query(
    "m16_confidence_buckets",
    _confidence_buckets,
    f"SELECT CASE WHEN sd <= a[1] THEN 1 WHEN sd <= a[2] THEN 2 WHEN sd <= a[3] THEN 3 ELSE 4 END AS bucket, count(*) AS n, avg(err) AS mean, sum(err * total) / sum(total) AS weighted, quantile_cont(err, 0.1) AS p10, max(err) AS worst FROM ({_CONF}), (SELECT quantile_cont(sd, [0.25, 0.5, 0.75]) AS a FROM ({_CONF})) GROUP BY ALL",
    "mean weighted p10 worst",
)
_CAL = f"SELECT p, log_total AS y, {BUCKET.format(q=20)} AS stratum FROM (SELECT persist_total AS p, log_total, row_number() OVER (ORDER BY persist_total, cell::VARCHAR || ':' || season_idx::VARCHAR) AS r, count(*) OVER () AS n FROM ({HEX}) WHERE persist_total IS NOT NULL AND season_idx >= 16)"
query(
    "m17_calibration",
    lambda t: K.first_ranks(hex_panel(t).where("persist_total is not null and season_idx >= 16").select(F.concat_ws(":", "cell", "season_idx").alias("key"), F.col("persist_total").alias("p"), F.col("log_total").alias("y")), "p", "key").withColumn("stratum", K.equal_count_bucket(F.col("rank"), F.col("n"), 20)).groupBy("stratum").agg(n_rows().alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("actual"), F.avg((F.col("y") <= -4).cast("double")).alias("zeros")),
    f"SELECT stratum, count(*) AS n, avg(p) AS predicted, avg(y) AS actual, avg((y <= -4)::INT) AS zeros FROM ({_CAL}) GROUP BY ALL",
    "predicted actual zeros",
)
query(
    "m21_uniform_and_persistence",
    lambda t: start_forecast(t).where("p is not null and season_idx >= 16").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("persistence"), F.avg(F.abs(F.lit(t.starts.where("season_idx < 16").agg(F.avg("starts_total")).first()[0]) - F.col("y"))).alias("uniform")),
    f"SELECT avg(abs(p - y)) AS persistence, avg(abs((SELECT avg(starts_total) FROM starts WHERE season_idx < 16) - y)) AS uniform FROM (SELECT season_idx, starts_total AS y, avg(starts_total) {CELLS.format(k=3)} AS p FROM starts) WHERE p IS NOT NULL AND season_idx >= 16",
    "persistence uniform",
)
query(
    "m24_predictor_agreement",
    lambda t: R.global_prior(tier1_forecast(t), ["human", "natural", "unknown"], F.col("season_year") < CFG.test_start).where("season_year >= 1999 and p_human is not null").agg(F.avg(X.tvd([F.col(f"p_{c}") for c in ("human", "natural", "unknown")], [F.col(f"prior_{c}") for c in ("human", "natural", "unknown")])).alias("distance")),
    f"SELECT avg(0.5 * (abs(ph - gh) + abs(pn - gn) + abs(pu - gu))) AS distance FROM ({_P7}), ({_PRIOR}) WHERE season_year >= 1999 AND ph IS NOT NULL",
    "distance",
)
_KEYED = _CONF.replace("SELECT season,", "SELECT place || ':' || season_idx::VARCHAR AS key,")
_MID = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_DEALT = f"SELECT {_MID('sd')} AS ra, {_MID('err')} AS rb, row_number() OVER (ORDER BY key) AS r, count(*) OVER () AS n FROM ({_KEYED})"
_SEEDS = "(SELECT unnest(range(1, 201)) AS seed)"
query(
    "m15_confidence_shuffles",
    lambda t: K.shuffled_scores(confidence(t).withColumn("key", F.concat_ws(":", "place", "season_idx")), "sd", "err", "key", 200),
    f"""SELECT n, rho, null_mean, null_std, (rho - null_mean) / null_std AS deviations
    FROM (SELECT count(*) AS n, corr(ra, rb) AS rho FROM ({_DEALT})), (SELECT avg(c) AS null_mean, stddev_samp(c) AS null_std FROM (
      SELECT corr(a.ra, b.rb) AS c FROM (SELECT ra, r, seed FROM ({_DEALT}), {_SEEDS}) a
      JOIN {dealt_sql(f"SELECT rb, r, n, seed FROM ({_DEALT}), {_SEEDS}", 'seed')} b ON a.seed = b.seed AND a.r = b.dealt GROUP BY a.seed))""",
    "rho null_mean null_std deviations",
)
