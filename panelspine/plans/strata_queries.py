"""Two-way tables over rank strata, and the second halves of descriptive reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as X
from ..operators import clean as C
from ..operators import covariates as Z
from ..operators import describe as D
from ..operators import ranks as K
from ..operators import score as R
from ..operators import trailing as T
from .bindings import CFG, CLASS
from .describe_queries import _DOM, _LAG, _P7, _PRIOR, _TRI, _VOL, _WEEK, _lead_sql, dominance, flag, kind, lagged, lead, n_rows, volatility
from .grain_queries import MISS
from .panel_queries import BUCKET, rho_sql, tier1_forecast
from .registry import query

# time since an event against propensity
_AGE = "CASE WHEN since <= 6 THEN '0-1' WHEN since <= 14 THEN '2-3' ELSE '4+' END"
_PROPENSITY = f"""SELECT *, {_AGE} AS age FROM (SELECT *, avg(y) OVER (PARTITION BY cell ORDER BY season_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM ({_LAG})) WHERE season_idx >= 16"""


def _banded_sql(where: str, q: int) -> str:
    return f"SELECT *, {BUCKET.format(q=q)}::VARCHAR AS band FROM (SELECT *, row_number() OVER (ORDER BY past, id) AS r, count(*) OVER () AS n FROM (SELECT *, cell * 100 + season_idx AS id FROM ({_PROPENSITY})) WHERE {where})"


def _banded(t, where: str, q: int):
    """Rows of the test years by rank of their own past mean, ties by series and
    season (most past means are equal, so values alone cannot cut them)."""
    rows = lagged(t).withColumn("past", T.trailing_mean("y", ["cell"], None)).where("season_idx >= 16").withColumns({"id": F.col("cell") * 100 + F.col("season_idx"), "age": F.expr(_AGE)})
    return K.first_ranks(rows.where(where), "past", "id").withColumn("band", K.equal_count_bucket(F.col("rank"), F.col("n"), q).cast("string"))


query(
    "a43_ratio_by_band",
    lambda t: _banded(t, "true", 5).groupBy("band").agg(F.avg(F.when(F.col("lag4") > 0, F.col("y"))).alias("with"), F.avg(F.when(F.col("lag4") == 0, F.col("y"))).alias("without"), F.count_if(F.col("lag4") > 0).alias("n_with"), n_rows().alias("n")).withColumn("ratio", X.ratio(F.col("with"), F.col("without"))),
    f'SELECT band, avg(y) FILTER (lag4 > 0) AS "with", avg(y) FILTER (lag4 = 0) AS without, count(*) FILTER (lag4 > 0) AS n_with, count(*) AS n, avg(y) FILTER (lag4 > 0) / nullif(avg(y) FILTER (lag4 = 0), 0) AS ratio FROM ({_banded_sql("true", 5)}) GROUP BY ALL',
    "with without ratio",
)
_ONE_SEASON = "season_idx % 4 = 2 AND since < 26"
_GRID = f"SELECT CASE WHEN grouping(age) = 1 THEN 'all' ELSE age END AS age, CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, count(*) AS n, avg(y) AS mean FROM ({_banded_sql(_ONE_SEASON, 4)}) GROUP BY CUBE (age, band)"


def _grid(t):
    """One season only: steps since an event fall on other seasons in turn, whose levels would pass for decay."""
    return D.two_way(_banded(t, _ONE_SEASON, 4), "age", "band", "y")


query("a44_time_by_propensity", _grid, _GRID, "mean")
query(
    "a44_spread",
    lambda t: D.spreads(_grid(t), "age", "band"),
    f"""SELECT (SELECT avg(s) FROM (SELECT max(mean) / nullif(min(mean), 0) AS s FROM g WHERE age <> 'all' AND band <> 'all' GROUP BY band)) AS down,
      (SELECT avg(s) FROM (SELECT max(mean) / nullif(min(mean), 0) AS s FROM g WHERE age <> 'all' AND band <> 'all' GROUP BY age)) AS across FROM (SELECT 1)""".replace("FROM g ", f"FROM ({_GRID}) "),
    "down across",
)
query(
    "a44_years_against_never",
    lambda t: _against_never(t),
    f"""SELECT yrs, n, mean, mean / nullif((SELECT avg(y) FROM ({_PROPENSITY}) WHERE season_idx % 4 = 2 AND since >= 26), 0) AS vs_never
      FROM (SELECT ((since + 2) // 4)::INT AS yrs, count(*) AS n, avg(y) AS mean FROM ({_PROPENSITY}) WHERE {_ONE_SEASON} GROUP BY ALL HAVING count(*) >= 20)""",
    "mean vs_never",
)


def _against_never(t):
    rows = lagged(t).where("season_idx >= 16 and season_idx % 4 = 2")
    years = rows.groupBy(F.when(F.col("since") < 26, F.floor((F.col("since") + 2) / 4).cast("int")).alias("yrs")).agg(n_rows().alias("n"), F.avg("y").alias("mean"))
    base = F.max(F.when(F.col("yrs").isNull(), F.col("mean"))).over(Window.partitionBy(F.lit(1)))  # a row per year
    return years.withColumn("vs_never", X.ratio(F.col("mean"), base)).where("yrs is not null and n >= 20")


# reports
query(
    "a29_mix_shift",
    lambda t: D.shares(t.records.withColumns({"tail": F.when(F.col("size") >= 300000, "tail").otherwise("small"), "class": kind()}), ["tail"], "class", n_rows()).groupBy("class").agg(F.max(F.when(F.col("tail") == "small", F.col("share"))).alias("small"), F.max(F.when(F.col("tail") == "tail", F.col("share"))).alias("tail")).withColumn("shift", F.col("tail") - F.col("small")),
    f"SELECT class, small, tail, tail - small AS shift FROM (SELECT class, max(s) FILTER (NOT big) AS small, max(s) FILTER (big) AS tail FROM (SELECT big, class, count(*) / sum(count(*)) OVER (PARTITION BY big) AS s FROM (SELECT size >= 300000 AS big, {CLASS} AS class FROM records) GROUP BY big, class) GROUP BY class)",
    "small tail shift",
)
query(
    "a33_leader_examples",
    lambda t: lead(t, n_rows()).select("place", F.col("leader").alias("by_count"), F.col("share").alias("count_share")).join(lead(t, F.sum("size")).select("place", F.col("leader").alias("by_size"), F.col("share").alias("size_share")), "place").where("by_count <> by_size").withColumn("gap", F.col("size_share") - F.col("count_share")),
    f"SELECT a.place, a.leader AS by_count, a.share AS count_share, b.leader AS by_size, b.share AS size_share, b.share - a.share AS gap FROM ({_lead_sql('count(*)')}) a JOIN ({_lead_sql('sum(size)')}) b USING (place) WHERE a.leader <> b.leader",
    "count_share size_share gap",
)
query(
    "a37_human_by_year",
    lambda t: D.shares(t.records.where(kind() == "Human"), ["season_year"], "category", F.sum("size")).drop("value"),
    f"SELECT season_year, category, sum(size) / sum(sum(size)) OVER (PARTITION BY season_year) AS share FROM records WHERE {CLASS} = 'Human' GROUP BY season_year, category",
    "share",
)
query(
    "a45_counts_and_sizes",
    lambda t: D.shares(t.records.withColumn("class", kind()), ["class"], "season", n_rows()).select("class", "season", F.col("value").alias("n"), F.col("share").alias("by_count")).join(D.shares(t.records.withColumn("class", kind()), ["class"], "season", F.sum("size")).select("class", "season", F.col("share").alias("by_size")), ["class", "season"]).withColumn("summer", F.col("season") == "JJA"),
    f"SELECT {CLASS} AS class, season, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY {CLASS}) AS by_count, sum(size) / sum(sum(size)) OVER (PARTITION BY {CLASS}) AS by_size, season = 'JJA' AS summer FROM records GROUP BY {CLASS}, season",
    "by_count by_size",
)


def _peaks(t):
    """Each class's peak week, and how many weeks it lies after the natural one's."""
    peaks = D.week_curves(t.records, kind(), 6).groupBy("kind").agg(F.max_by("week", F.struct("per_year", -F.col("week"))).alias("peak"))
    of = F.max(F.when(F.col("kind") == "Natural", F.col("peak"))).over(Window.partitionBy(F.lit(1)))  # a row per class
    return peaks.withColumn("offset", F.col("peak") - of)


_PEAKS = f"SELECT kind, arg_max(week, (per_year, -week)) AS peak FROM ({_WEEK}) GROUP BY ALL"
query("a46_peak_offset", _peaks, f"SELECT kind, peak, peak - (SELECT peak FROM ({_PEAKS}) WHERE kind = 'Natural') AS \"offset\" FROM ({_PEAKS})")
query(
    "a55_triage_errors",
    lambda t: R.global_prior(t.tier1.withColumn("p", T.trailing_mean("unknown", ["place", "season"], 7)), ["unknown"], F.col("season_year") < CFG.test_start).where("season_year >= 1999 and p is not null").agg(F.avg(F.abs(F.col("p") - F.col("unknown"))).alias("mae"), F.avg(F.abs(F.col("prior_unknown") - F.col("unknown"))).alias("mae_global"), n_rows().alias("n")),
    f"SELECT avg(abs(p - unknown)) AS mae, avg(abs(g - unknown)) AS mae_global, count(*) AS n FROM ({_TRI}), (SELECT avg(unknown) AS g FROM tier1 WHERE season_year < 1999) WHERE season_year >= 1999 AND p IS NOT NULL",
    "mae mae_global",
)
query(
    "a57_big_from_few",
    lambda t: t.starts.where("starts_total > 0").join(t.acres.select("cell", "season_idx", "size_total"), ["cell", "season_idx"]).where("size_total >= 4e5").agg(n_rows().alias("big"), F.avg((F.col("starts_total") == 1).cast("double")).alias("from_one"), F.avg((F.col("starts_total") <= 2).cast("double")).alias("from_two")),
    "SELECT count(*) AS big, avg((starts_total = 1)::INT) AS from_one, avg((starts_total <= 2)::INT) AS from_two FROM starts JOIN (SELECT cell, season_idx, size_total FROM acres) USING (cell, season_idx) WHERE starts_total > 0 AND size_total >= 4e5",
    "from_one from_two",
)


def _layers(t):
    return t.tier1.groupBy("place").agg(F.avg("human").alias("human"), F.avg("unknown").alias("unknown"), F.avg("log_total").alias("size"))


_LAYERS = "SELECT place, avg(human) AS human, avg(unknown) AS unknown, avg(log_total) AS size FROM tier1 GROUP BY ALL"
query(
    "a60_cross_layer",
    lambda t: K.spearman(_layers(t), "human", "size").withColumn("layers", F.lit("human size")).unionByName(K.spearman(_layers(t), "human", "unknown").withColumn("layers", F.lit("human unknown"))),
    f"SELECT *, 'human size' AS layers FROM ({rho_sql(_LAYERS, 'human', 'size')}) UNION ALL SELECT *, 'human unknown' FROM ({rho_sql(_LAYERS, 'human', 'unknown')})",
    "rho",
)
query(
    "a74_volatility_bands",
    lambda t: volatility(t).join(t.tier1.groupBy("place").agg(F.sum("total").alias("total")), "place").withColumn("large", F.col("total") >= 5e7).groupBy("large").agg(n_rows().alias("places"), F.count_if(F.col("volatility") < 0.1).alias("steady"), F.count_if(F.col("volatility") > 0.3).alias("volatile")),
    f"SELECT total >= 5e7 AS large, count(*) AS places, count(*) FILTER (volatility < 0.1) AS steady, count(*) FILTER (volatility > 0.3) AS volatile FROM ({_VOL}) JOIN (SELECT place, sum(total) AS total FROM tier1 GROUP BY ALL) USING (place) GROUP BY ALL",
)
query(
    "a75_matched_by_layer",
    lambda t: t.raw.join(t.overlap.select(F.col("event").alias("id"), F.lit(1).alias("on")).distinct(), "id", "left").groupBy(F.col("parent").alias("layer")).agg(n_rows().alias("n"), F.avg(F.col("on").isNotNull().cast("double")).alias("matched"), X.ratio(F.sum(F.when(F.col("on").isNotNull(), F.col("size")).otherwise(0.0)), F.sum("size")).alias("matched_size"), F.count_if(F.col("on").isNull()).alias("unmatched")),
    "SELECT parent AS layer, count(*) AS n, avg(m::INT) AS matched, sum(CASE WHEN m THEN size ELSE 0 END) / nullif(sum(size), 0) AS matched_size, count(*) FILTER (NOT m) AS unmatched FROM (SELECT *, id IN (SELECT event FROM overlap) AS m FROM raw) GROUP BY ALL",
    "matched matched_size",
)
_MONTHLY = "SELECT place, month, avg(CASE WHEN v1 > 0.01 THEN v1 END) AS v1, avg(CASE WHEN v2 > 0.01 THEN v2 END) AS v2, avg(v3) AS v3 FROM monthly GROUP BY ALL"
query(
    "a76_coverage_and_means",
    lambda t: _coverage(t),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(({c} IS NOT NULL)::INT) AS known, avg({c}) AS mean FROM ({_MONTHLY})" for c in ("v1", "v2", "v3")),
    "known mean",
)


def _coverage(t):
    some = t.monthly.withColumns({c: F.when(F.col(c) > 0.01, F.col(c)) for c in ("v1", "v2")})
    cols = ["v1", "v2", "v3"]
    rows = Z.monthly_mean(some, ["place", "month"], cols)
    one = rows.agg(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNotNull().cast("double")).alias("known"), F.avg(c).alias("mean")).alias(c) for c in cols])
    return one.select(F.explode(F.array(*cols)).alias("r")).select("r.*")


def _top(a: str, b: str, c: str) -> str:
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 1 WHEN {b} >= {c} THEN 2 ELSE 3 END"


query(
    "m24_same_top_class",
    lambda t: R.global_prior(tier1_forecast(t), ["human", "natural", "unknown"], F.col("season_year") < CFG.test_start).where("season_year >= 1999 and p_human is not null").agg(n_rows().alias("n"), F.avg((F.expr(_top("p_human", "p_natural", "p_unknown")) == F.expr(_top("prior_human", "prior_natural", "prior_unknown"))).cast("double")).alias("same_top")),
    f"SELECT count(*) AS n, avg(({_top('ph', 'pn', 'pu')} = {_top('gh', 'gn', 'gu')})::INT) AS same_top FROM ({_P7}), ({_PRIOR}) WHERE season_year >= 1999 AND ph IS NOT NULL",
    "same_top",
)
