"""Cause profiles by place and season, fingerprints, and confidence over all classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as X
from ..operators import ranks as K
from ..operators import trailing as T
from .describe_queries import _P7, n_rows
from .panel_queries import HEX, LAST, PREDICT, _predictability, hex_panel, rho_sql, tier1_forecast
from .registry import query
from .strata_queries import _top

SERIES = ["place", "season"]
CLASSES = ("human", "natural", "unknown")


def profiles(t):
    """Rows of the test years with predicted and actual size of each class: the
    share's trailing mean times ten to the trailing mean of the log level."""
    rows = tier1_forecast(t).withColumn("p_log", T.trailing_mean("log_total", SERIES, 6)).where("season_year >= 1999 and p_log is not null and p_human is not null")
    sizes = {f"size_{c}": F.col(f"p_{c}") * F.pow(F.lit(10.0), F.col("p_log")) for c in CLASSES} | {f"actual_{c}": F.col(c) * F.col("total") for c in CLASSES}
    return rows.withColumns(sizes)


_PROFILES = f"""SELECT *, ph * pow(10, p_log) AS size_human, pn * pow(10, p_log) AS size_natural, pu * pow(10, p_log) AS size_unknown,
  human * total AS actual_human, "natural" * total AS actual_natural, unknown * total AS actual_unknown FROM ({_P7}) WHERE season_year >= 1999 AND p_log IS NOT NULL AND ph IS NOT NULL"""


def _ranked(t):
    """The classes of each profile by predicted size; ties by the order of CLASSES.
    The three are sorted inside their row."""
    classes = F.array(*[F.struct((-F.col(f"size_{c}")).alias("less"), F.lit(i).alias("i"), F.lit(c).alias("class"), F.col(f"actual_{c}").alias("actual")) for i, c in enumerate(CLASSES)])
    rows = profiles(t).select("place", "season_idx", F.posexplode(F.array_sort(classes)).alias("at", "r"))
    return rows.select("place", "season_idx", F.col("r.class").alias("class"), (F.col("at") + 1).alias("rank"), (-F.col("r.less")).alias("predicted"), F.col("r.actual").alias("actual"))


query(
    "m04_ranked_profile",
    _ranked,
    f"""SELECT place, season_idx, class, (row_number() OVER (PARTITION BY place, season_idx ORDER BY predicted DESC, i))::INT AS rank, predicted, actual FROM (
      {' UNION ALL '.join(f"SELECT place, season_idx, '{c}' AS class, {i} AS i, size_{c} AS predicted, actual_{c} AS actual FROM ({_PROFILES})" for i, c in enumerate(CLASSES))})""",
    "predicted actual",
)
_TOPS = (_top("size_human", "size_natural", "size_unknown"), _top("actual_human", "actual_natural", "actual_unknown"))
query(
    "m04_top_agreement",
    lambda t: profiles(t).withColumn("hit", (F.expr(_TOPS[0]) == F.expr(_TOPS[1])).cast("double")).agg(n_rows().alias("n"), F.avg("hit").alias("top1"), X.ratio(F.sum(F.col("hit") * F.col("total")), F.sum("total")).alias("top1_weighted")),
    f"SELECT count(*) AS n, avg(hit) AS top1, sum(hit * total) / nullif(sum(total), 0) AS top1_weighted FROM (SELECT *, ({_TOPS[0]} = {_TOPS[1]})::INT AS hit FROM ({_PROFILES}))",
    "top1 top1_weighted",
)


def fingerprints(t):
    """Eight features of strictly earlier history and five targets. Rows without
    history have null features and depth 0."""
    rows = t.tier1.withColumn("mean_size", F.col("total") / F.col("n"))
    mean = lambda c: T.trailing_mean(c, SERIES, 7)
    features = {"f_level": mean("log_total"), "f_level_sd": T.trailing_std("log_total", SERIES, 7)} | {f"f_{c}": mean(c) for c in CLASSES}
    # greatest() would pass over a null mean
    for name, column, least in (("f_size", "mean_size", 1e-6), ("f_events", "n", 1.0)):
        features[name] = F.when(mean(column).isNotNull(), F.log10(F.greatest(mean(column), F.lit(least))))
    rows = rows.withColumns(features | {"f_depth": T.depth(SERIES)})
    return rows.select("place", "season", "season_idx", *features, "f_depth", *CLASSES, "log_total", "total")


_W7 = LAST.format(k=7)
query(
    "m07_fingerprints",
    fingerprints,
    f"""SELECT place, season, season_idx, avg(log_total) {_W7} AS f_level, stddev_samp(log_total) {_W7} AS f_level_sd, avg(human) {_W7} AS f_human, avg("natural") {_W7} AS f_natural, avg(unknown) {_W7} AS f_unknown,
      log10(CASE WHEN avg(total / n) {_W7} IS NOT NULL THEN greatest(avg(total / n) {_W7}, 1e-6) END) AS f_size, log10(CASE WHEN avg(n) {_W7} IS NOT NULL THEN greatest(avg(n) {_W7}, 1) END) AS f_events,
      (row_number() OVER (PARTITION BY place, season ORDER BY season_idx) - 1)::INT AS f_depth, human, "natural", unknown, log_total, total FROM tier1""",
    "f_level f_level_sd f_human f_natural f_unknown f_size f_events human natural unknown log_total total",
)


def all_class_confidence(t):
    """dispersion: the mean over classes of the spread of their earlier shares;
    tvd: the forecast's distance from the outcome."""
    rows = tier1_forecast(t).withColumns({f"sd_{c}": T.trailing_std(c, SERIES, 7) for c in CLASSES}).where("season_year >= 1999 and sd_human is not null")
    apart = X.tvd([F.col(f"p_{c}") for c in CLASSES], [F.col(c) for c in CLASSES])
    # rounded, as equal sums in another order would not tie
    return rows.select("place", "season", "season_year", F.round(sum(F.col(f"sd_{c}") for c in CLASSES) / 3, 9).alias("dispersion"), F.round(apart, 9).alias("tvd"))


_SDS = f"""SELECT place, season, season_year, round((sd_h + sd_n + sd_u) / 3, 9) AS dispersion, round((abs(ph - human) + abs(pn - "natural") + abs(pu - unknown)) / 2, 9) AS tvd FROM (
  SELECT *, stddev_samp(human) {_W7} AS sd_h, stddev_samp("natural") {_W7} AS sd_n, stddev_samp(unknown) {_W7} AS sd_u FROM ({_P7})) WHERE season_year >= 1999 AND sd_h IS NOT NULL"""
query("m15_all_classes", lambda t: K.spearman(all_class_confidence(t), "dispersion", "tvd"), rho_sql(_SDS, "dispersion", "tvd"), "rho")
query(
    "m15_all_classes_by_place",
    lambda t: K.spearman(all_class_confidence(t), "dispersion", "tvd", ["place"]).where("n >= 8"),
    f"SELECT * FROM ({rho_sql(_SDS, 'dispersion', 'tvd', 'place')}) WHERE n >= 8",
    "rho",
)
query(
    "m16_confidence_by_place_season",
    lambda t: all_class_confidence(t).groupBy("place", "season").agg(n_rows().alias("n"), F.avg("dispersion").alias("dispersion"), F.avg(1 - F.col("tvd")).alias("accuracy")),
    f"SELECT place, season, count(*) AS n, avg(dispersion) AS dispersion, avg(1 - tvd) AS accuracy FROM ({_SDS}) GROUP BY ALL",
    "dispersion accuracy",
)


def steady_but_wrong(t, least: float = 0.7):
    """Rows of the steadiest quarter whose forecast is nevertheless less accurate than least."""
    rows = all_class_confidence(t)
    cut = K.quantiles(rows, "dispersion", [0.25]).select(F.round(F.col("q")[0], 9).alias("cut"))
    return rows.join(F.broadcast(cut), F.col("dispersion") <= F.col("cut")).where(F.round(1 - F.col("tvd"), 9) < least).select("place", "season", "season_year", "dispersion", (1 - F.col("tvd")).alias("accuracy"))


query(
    "m16_steady_but_wrong",
    steady_but_wrong,
    f"SELECT place, season, season_year, dispersion, 1 - tvd AS accuracy FROM ({_SDS}) WHERE dispersion <= (SELECT round(quantile_cont(dispersion, 0.25), 9) FROM ({_SDS})) AND round(1 - tvd, 9) < 0.7",
    "dispersion accuracy",
)
query(
    "a72_rank_scores",
    lambda t: K.spearman(_burned(t), "persist_total", "log_total").withColumn("baseline", F.lit("plain")).unionByName(K.spearman(_burned(t), "cond_total", "log_total").withColumn("baseline", F.lit("conditional"))),
    " UNION ALL ".join(f"SELECT *, '{name}' AS baseline FROM ({rho_sql(f'SELECT * FROM ({HEX}) WHERE size_total > 0 AND cond_total IS NOT NULL AND season_idx >= 16', column, 'log_total')})" for column, name in (("persist_total", "plain"), ("cond_total", "conditional"))),
    "rho",
)


def _burned(t):
    return hex_panel(t).where("size_total > 0 and cond_total is not null and season_idx >= 16")


def branch_wins(t):
    """Of the years in which both branches have a score, those in which each one's is higher."""
    rho = lambda c: F.round(F.max(F.when(F.col("branch") == c, F.col("rho"))), 9)
    years = _predictability(t).groupBy("ord", "season_year").agg(rho("natural").alias("natural"), rho("human").alias("human")).where("natural is not null and human is not null")
    return years.groupBy("ord").agg(n_rows().alias("years"), F.count_if(F.col("natural") > F.col("human")).alias("natural_wins"), F.count_if(F.col("human") > F.col("natural")).alias("human_wins"))


query(
    "m25_branch_wins",
    branch_wins,
    f"""SELECT ord, count(*) AS years, count(*) FILTER (nat > hum) AS natural_wins, count(*) FILTER (hum > nat) AS human_wins FROM (
      SELECT ord, season_year, round(max(rho) FILTER (branch = 'natural'), 9) AS nat, round(max(rho) FILTER (branch = 'human'), 9) AS hum FROM ({PREDICT}) WHERE n >= 50 GROUP BY ALL) WHERE nat IS NOT NULL AND hum IS NOT NULL GROUP BY ALL""",
)
