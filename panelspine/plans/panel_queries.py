"""Queries on trailing forecasts, dense panels, ranks and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CELL, SERIES
from ..functions import metrics as X
from ..operators import clean as C
from ..operators import ranks as K
from ..operators import score as R
from ..operators import spatial as P
from ..operators import trailing as T
from .bindings import CFG, CLASS
from .registry import query

TIER = ["human", "natural", "unknown"]
LAST = "OVER (PARTITION BY place, season ORDER BY season_idx ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
CELLS = "OVER (PARTITION BY cell, season_idx % 4 ORDER BY season_idx ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
ROWS = "OVER (PARTITION BY cell ORDER BY season_idx ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
Q = {"human": "human", "natural": '"natural"', "unknown": "unknown"}


def _test():
    return F.col("season_year") >= CFG.test_start


def _p():
    return [F.col(f"p_{c}") for c in TIER]


def _a():
    return [F.col(c) for c in TIER]


def tier1_forecast(t, k=7, ks=None):
    """tier1 with p_class, the trailing mean of each share over k rows."""
    return t.tier1.withColumns({f"p_{c}": T.trailing_mean(c, SERIES, k) for c in TIER})


def _pred_sql(k) -> str:
    w = LAST.format(k=k)
    return "SELECT *, " + ", ".join(f"avg({Q[c]}) {w} AS p_{c}" for c in TIER) + " FROM tier1"


TVD = '0.5 * (abs(p_human - human) + abs(p_natural - "natural") + abs(p_unknown - unknown))'
SCORE = "count(*) AS n_cells, avg(m) AS plain, sum(m * w) / sum(w) AS weighted"

query(
    "tier1_floor",
    lambda t: R.score_masked(tier1_forecast(t), X.tvd(_p(), _a()), F.col("total"), _test()),
    f"SELECT {SCORE} FROM (SELECT {TVD} AS m, total AS w FROM ({_pred_sql(7)}) WHERE season_year >= 1999) WHERE m IS NOT NULL",
    "plain weighted",
)
SPARSE = "place season_idx category share"
query(
    "w01_trailing_mean_k7",
    lambda t: tier1_forecast(t).select("place", "season_idx", *[f"p_{c}" for c in TIER]),
    f"SELECT place, season_idx, p_human, p_natural, p_unknown FROM ({_pred_sql(7)})",
    "p_human p_natural p_unknown",
)
query(
    "w01_trailing_mean_sparse",
    lambda t: t.sparse_grain.where("category = '2-HIGH'").select("place", "season_idx", T.trailing_mean("share", SERIES, 3).alias("p")),
    f"SELECT place, season_idx, avg(share) {LAST.format(k=3)} AS p FROM sparse_grain WHERE category = '2-HIGH'",
    "p",
)
query(
    "w02_expanding_mean",
    lambda t: t.tier1.select("place", "season_idx", T.trailing_mean("human", SERIES, None).alias("p")),
    f"SELECT place, season_idx, avg(human) {LAST.format(k='UNBOUNDED')} AS p FROM tier1",
    "p",
)
query(
    "w03_trailing_std",
    lambda t: t.tier1.select("place", "season_idx", T.trailing_std("human", SERIES, 7).alias("s")),
    f"SELECT place, season_idx, stddev_samp(human) {LAST.format(k=7)} AS s FROM tier1",
    "s",
)
query(
    "w04_exact_step",
    lambda t: t.sparse_grain.where("category = '2-HIGH'").select("place", "season_idx", T.exact_step("share", SERIES).alias("p")),
    "SELECT place, season_idx, CASE WHEN season_idx - lag(season_idx) OVER w = 4 THEN lag(share) OVER w END AS p FROM sparse_grain WHERE category = '2-HIGH' WINDOW w AS (PARTITION BY place, season ORDER BY season_idx)",
    "p",
)
query(
    "w05_history_depth",
    lambda t: t.sparse_grain.where("category = '2-HIGH'").select("place", "season_idx", T.depth(SERIES).alias("d")),
    "SELECT place, season_idx, (row_number() OVER (PARTITION BY place, season ORDER BY season_idx) - 1)::INT AS d FROM sparse_grain WHERE category = '2-HIGH'",
)


def burned(t):
    """The dense panel with the share of a cell's area that its events take, at most 1."""
    return t.acres.withColumn("frac", F.when(F.col("area") > 0, F.least(F.col("size_total") / (F.col("area") * 1000), F.lit(1.0))).otherwise(0.0))


BURNED = "SELECT *, CASE WHEN area > 0 THEN least(size_total / (area * 1000), 1.0) ELSE 0.0 END AS frac FROM acres"
query(
    "w06_lagged_sums",
    lambda t: burned(t).select("cell", "season_idx", *[T.trailing_sum("frac", ["cell"], k).alias(f"lag{k}") for k in (4, 12, 20)]).select("*", *[(F.col(f"lag{k}") > 0).cast("int").alias(f"any{k}") for k in (4, 12, 20)]),
    "SELECT cell, season_idx, lag4, lag12, lag20, (lag4 > 0)::INT AS any4, (lag12 > 0)::INT AS any12, (lag20 > 0)::INT AS any20 FROM (SELECT cell, season_idx, " + ", ".join(f"coalesce(sum(frac) {ROWS.format(k=k)}, 0.0) AS lag{k}" for k in (4, 12, 20)) + f" FROM ({BURNED}))",
    "lag4 lag12 lag20",
)
query(
    "w07_since_last",
    lambda t: t.acres.select("cell", "season_idx", T.since_last("size_total", ["cell"], CFG.last_idx).alias("since")),
    f"SELECT cell, season_idx, coalesce(season_idx - max(CASE WHEN size_total > 0 THEN season_idx END) {ROWS.format(k='UNBOUNDED')}, 26)::INT AS since FROM acres",
)
BUCKET = "greatest(1, ((r - 1) * {q} + n - 2) // (n - 1))::INT"
query(
    "w08_equal_count_deciles",
    lambda t: K.first_ranks(t.records.select("id", "size"), "size", "id").select("id", K.equal_count_bucket(F.col("rank"), F.col("n"), 10).alias("decile")),
    f"SELECT id, {BUCKET.format(q=10)} AS decile FROM (SELECT id, row_number() OVER (ORDER BY size, id) AS r, count(*) OVER () AS n FROM records)",
)
query(
    "w09_value_quartiles",
    lambda t: K.quartile_bucket(t.tier1.select("place", "season_idx", "human"), "human", "quartile").drop("human"),
    "SELECT place, season_idx, (CASE WHEN human <= a[1] THEN 1 WHEN human <= a[2] THEN 2 WHEN human <= a[3] THEN 3 ELSE 4 END)::INT AS quartile FROM tier1, (SELECT quantile_cont(human, [0.25, 0.5, 0.75]) AS a FROM tier1)",
)
query(
    "w10_cumulative_share",
    lambda t: K.cumulative_share(t.grid.join(t.records.groupBy("cell").agg(F.round(F.sum("size"), 6).alias("size")), "cell").select("cell", "size"), "size", "cell").select("cell", "rank", "cum"),  # rounded: sums that tie are equal, in whatever order they were added
    "SELECT cell, row_number() OVER w AS rank, sum(size) OVER w / sum(size) OVER () AS cum FROM (SELECT cell, sum(size) AS size FROM records GROUP BY ALL) WINDOW w AS (ORDER BY size DESC, cell ROWS UNBOUNDED PRECEDING)",
    "cum",
)
query(
    "w11_largest_per_key",
    lambda t: t.overlap.groupBy("event").agg(F.max_by("cell", F.struct("overlap", -F.col("cell"))).alias("cell")),
    "SELECT event, arg_max(cell, (overlap, -cell)) AS cell FROM overlap GROUP BY ALL",
)
query(
    "w12_centred",
    lambda t: t.tier1.select("place", "season_idx", (F.col("human") - F.avg("human").over(Window.partitionBy("place"))).alias("centred")),
    "SELECT place, season_idx, human - avg(human) OVER (PARTITION BY place) AS centred FROM tier1",
    "centred",
)
query(
    "w13_duplicate_keys",
    lambda t: T.duplicate_keys(t.tier1, ["place", "season_idx"]).agg(F.count(F.lit(1)).alias("violations")),
    "SELECT count(*) AS violations FROM (SELECT 1 FROM tier1 GROUP BY place, season_idx HAVING count(*) > 1)",
)
_SERIES = ["cell", "ord"]


def hex_panel(t):
    """The dense size panel with season of year, log sizes and persistences."""
    p = t.acres.withColumns({"ord": F.col("season_idx") % 4, "season_year": (F.lit(1995) + F.floor(F.col("season_idx") / 4)).cast("int"), **{f"log_{c}": X.log10_floored(F.col(f"size_{c}")) for c in ("natural", "human", "total")}})
    p = p.withColumns({f"burn_{c}": F.when(F.col(f"size_{c}") > 0, F.col(f"log_{c}")) for c in ("natural", "human", "total")})
    return p.withColumns({f"persist_{c}": T.trailing_mean(f"log_{c}", _SERIES, 3) for c in ("natural", "human", "total")} | {f"cond_{c}": T.trailing_mean(f"burn_{c}", _SERIES, 3) for c in ("natural", "human", "total")})


_LOG = "CASE WHEN size_{c} > 0 THEN log10(greatest(size_{c}, 1e-4)) ELSE -4.0 END"
HEX = (
    "SELECT *, "
    + ", ".join(f"avg(log_{c}) OVER w AS persist_{c}, avg(CASE WHEN size_{c} > 0 THEN log_{c} END) OVER w AS cond_{c}" for c in ("natural", "human", "total"))
    + " FROM (SELECT *, season_idx % 4 AS ord, (1995 + season_idx // 4)::INT AS season_year, "
    + ", ".join(f"{_LOG.format(c=c)} AS log_{c}" for c in ("natural", "human", "total"))
    + " FROM acres) WINDOW w AS (PARTITION BY cell, ord ORDER BY season_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
)
query(
    "w14_burn_conditional",
    lambda t: hex_panel(t).select("cell", "season_idx", "cond_natural", "cond_total"),
    f"SELECT cell, season_idx, cond_natural, cond_total FROM ({HEX})",
    "cond_natural cond_total",
)
query(
    "w15_log_persistence",
    lambda t: hex_panel(t).select("cell", "season_idx", "persist_human", "persist_total"),
    f"SELECT cell, season_idx, persist_human, persist_total FROM ({HEX})",
    "persist_human persist_total",
)

# dense panels
query(
    "a14_cell_season_burn",
    lambda t: P.burn_by_season(t.overlap, t.records.select(F.col("id").alias("event"), "season_idx"), t.supplier_grid, t.line_tasks),
    "SELECT cell, season_idx, sum(overlap) AS acres, count(DISTINCT event) AS events, max(area) AS area, CASE WHEN max(area) > 0 THEN least(sum(overlap) / max(area), 1.0) END AS frac FROM overlap o JOIN (SELECT id, season_idx FROM records) r ON id = event LEFT JOIN (SELECT cell, area FROM supplier_grid) g USING (cell) GROUP BY ALL",
    "acres frac",
)
query(
    "a15_start_panel",
    lambda t: t.starts.withColumn("log_area", X.log_positive(F.col("area"))),
    "SELECT *, CASE WHEN area > 0 THEN ln(area) END AS log_area FROM starts",
    "log_area",
)
query(
    "a16_size_panel",
    lambda t: t.acres.select("cell", "season_idx", "size_natural", "size_human", "size_unknown", "size_total"),
    "SELECT cell, season_idx, size_natural, size_human, size_unknown, size_total FROM acres",
    "size_natural size_human size_unknown size_total",
)
query(
    "a25_train_anomaly",
    lambda t: t.tier1.select("place", "season_idx", (F.col("log_total") - T.train_mean("log_total", ["place"], ~_test())).alias("anomaly")),
    "SELECT place, season_idx, log_total - avg(log_total) FILTER (season_year < 1999) OVER (PARTITION BY place) AS anomaly FROM tier1",
    "anomaly",
)
query(
    "j18_aligned_predictions",
    lambda t: t.tier1.select(*CELL, "human").join(tier1_forecast(t).select("place", "season", "season_idx", "p_human"), ["place", "season", "season_idx"]).select("place", "season_idx", "human", "p_human"),
    f"SELECT place, season_idx, human, p_human FROM ({_pred_sql(7)})",
    "human p_human",
)
query(
    "j19_leakage_audit",
    lambda t: T.audit(t.tier1, "human", SERIES, 7, 300),
    f"""SELECT place, season, season_idx, p_human AS mean FROM ({_pred_sql(7)}) WHERE p_human IS NOT NULL AND (place, season, season_idx) IN
    (SELECT (place, season, season_idx) FROM (SELECT * FROM tier1 ORDER BY md5(place || ':' || season || ':' || season_idx::VARCHAR), place, season, season_idx LIMIT 300))""",
    "mean",
)

# measures
query(
    "x01_tvd",
    lambda t: tier1_forecast(t).select("place", "season_idx", X.tvd(_p(), _a()).alias("tvd")),
    f"SELECT place, season_idx, {TVD} AS tvd FROM ({_pred_sql(7)})",
    "tvd",
)
query(
    "x02_level_errors",
    lambda t: t.tier1.select("season_year", X.absolute_error(T.trailing_mean("log_total", SERIES, 6), F.col("log_total")).alias("e")).where(_test() & F.col("e").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.pow(F.lit(10.0), F.avg("e")).alias("times_off")),
    f"SELECT count(*) AS n, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, pow(10, avg(e)) AS times_off FROM (SELECT season_year, abs(avg(log_total) {LAST.format(k=6)} - log_total) AS e FROM tier1) WHERE season_year >= 1999 AND e IS NOT NULL",
    "mae rmse times_off",
)
_ARG = "CASE WHEN {h} >= {n} AND {h} >= {u} THEN 1 WHEN {n} >= {u} THEN 2 ELSE 3 END"
_HIT = f"({_ARG.format(h='p_human', n='p_natural', u='p_unknown')} = {_ARG.format(h='human', n=chr(34) + 'natural' + chr(34), u='unknown')})::INT::DOUBLE"
query(
    "x03_top1_hit",
    lambda t: tier1_forecast(t).select("place", "season_idx", X.top1_hit(_p(), _a()).alias("hit")),
    f"SELECT place, season_idx, CASE WHEN p_human IS NOT NULL THEN {_HIT} END AS hit FROM ({_pred_sql(7)})",
)
query(
    "x04_score_masked",
    lambda t: R.score_masked(tier1_forecast(t), X.tvd(_p(), _a()), F.col("total"), _test(), hit=X.top1_hit(_p(), _a())),
    f"SELECT {SCORE}, avg(hit) AS hit FROM (SELECT {TVD} AS m, total AS w, {_HIT} AS hit FROM ({_pred_sql(7)}) WHERE season_year >= 1999) WHERE m IS NOT NULL",
    "plain weighted hit",
)


def _sweep(t):
    return R.sweep(t.tier1, lambda k: [T.trailing_mean(c, SERIES, k) for c in TIER], lambda p: X.tvd(p, _a()), [1, 2, 3, 4, None], F.col("total"), _test())


SWEEP = " UNION ALL ".join(f"SELECT '{name}' AS label, {SCORE} FROM (SELECT {TVD} AS m, total AS w FROM ({_pred_sql(k)}) WHERE season_year >= 1999) WHERE m IS NOT NULL" for name, k in (("k=1", 1), ("k=2", 2), ("k=3", 3), ("k=4", 4), ("expanding", "UNBOUNDED")))
query("m02_window_sweep", _sweep, SWEEP, "plain weighted")
query(
    "m02_best_window",
    lambda t: _sweep(t).agg(F.min_by("label", F.struct("weighted", "label")).alias("best")),
    f"SELECT arg_min(label, (weighted, label)) AS best FROM ({SWEEP})",
)
query(
    "x05_ladder",
    lambda t: R.ladder(_sweep(t).withColumnRenamed("label", "rung"), "k=1", "weighted"),
    f"SELECT label AS rung, n_cells, plain, weighted, weighted - (SELECT weighted FROM ({SWEEP}) WHERE label = 'k=1') AS delta FROM ({SWEEP})",
    "plain weighted delta",
)
query(
    "x06_weighted_quantiles",
    lambda t: R.weighted_quantiles(t.tier1, ["season"], "human", "total", [0.1, 0.5, 0.9]),
    """SELECT season, q, CASE WHEN lo IS NULL THEN v0 WHEN hi IS NULL THEN v1 ELSE v_lo + (v_hi - v_lo) * (q - lo) / (hi - lo) END AS value FROM (
      SELECT season, q, max(pos) FILTER (pos < q) AS lo, min(pos) FILTER (pos >= q) AS hi, arg_max(v, pos) FILTER (pos < q) AS v_lo, arg_min(v, pos) FILTER (pos >= q) AS v_hi, arg_min(v, pos) AS v0, arg_max(v, pos) AS v1
      FROM (SELECT season, v, (sum(w) OVER (PARTITION BY season ORDER BY v ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY season) AS pos
        FROM (SELECT season, human AS v, sum(total) AS w FROM tier1 GROUP BY ALL)) , (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q) GROUP BY ALL)""",
    "q value",
)
_ST = "SELECT cell, season_idx, starts_total AS y, avg(starts_total) " + CELLS.format(k=3) + " AS p FROM starts"


def start_forecast(t):
    s = t.starts.withColumn("ord", F.col("season_idx") % 4)
    return s.withColumn("p", T.trailing_mean("starts_total", _SERIES, 3)).withColumnRenamed("starts_total", "y")


query(
    "x07_poisson_deviance",
    lambda t: start_forecast(t).agg(F.avg(X.poisson_deviance(F.col("y").cast("double"), F.col("p"))).alias("deviance")),
    f"SELECT avg(2 * (CASE WHEN y > 0 THEN y * ln(y / greatest(p, 1e-6)) ELSE 0 END - (y - greatest(p, 1e-6)))) AS deviance FROM ({_ST}) WHERE p IS NOT NULL",
    "deviance",
)
query(
    "x08_mae",
    lambda t: start_forecast(t).agg(F.avg(X.absolute_error(F.col("p"), F.col("y"))).alias("mae")),
    f"SELECT avg(abs(p - y)) AS mae FROM ({_ST})",
    "mae",
)
query(
    "x09_overlap",
    lambda t: tier1_forecast(t).select("place", "season_idx", X.overlap(_p(), _a()).alias("overlap")),
    f'SELECT place, season_idx, CASE WHEN p_human IS NOT NULL THEN least(p_human, human) + least(p_natural, "natural") + least(p_unknown, unknown) END AS overlap FROM ({_pred_sql(7)})',
    "overlap",
)
query(
    "x10_verdicts",
    lambda t: R.ladder(_sweep(t).withColumnRenamed("label", "rung"), "k=1", "weighted").select("rung", X.verdict(F.col("delta")).alias("verdict")),
    f"SELECT label AS rung, CASE WHEN d < -0.005 THEN 'better' WHEN d > 0.005 THEN 'worse' ELSE 'level' END AS verdict FROM (SELECT label, weighted - (SELECT weighted FROM ({SWEEP}) WHERE label = 'k=1') AS d FROM ({SWEEP}))",
)

# rank statistics
AVG_RANK = "rank() OVER ({p} ORDER BY {c}) + (count(*) OVER ({p} {sep} {c}) - 1) / 2.0"


def rho_sql(source: str, a: str, b: str, by: str = "") -> str:
    """Spearman correlation of a and b in source, by the columns by."""
    p = f"PARTITION BY {by}" if by else ""
    rank = lambda c: f"(rank() OVER ({p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{c}) - 1) / 2.0)::DOUBLE"
    inner = f"SELECT {by + ', ' if by else ''}{rank('a')} AS ra, {rank('b')} AS rb FROM (SELECT {by + ', ' if by else ''}{a} AS a, {b} AS b FROM ({source})) WHERE a IS NOT NULL AND b IS NOT NULL"
    return f"SELECT {by + ', ' if by else ''}count(*) AS n, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM ({inner})" + (f" GROUP BY {by}" if by else "")


query("m11_spearman", lambda t: K.spearman(start_forecast(t), "y", "p"), rho_sql(_ST, "y", "p"), "rho")
query("m11_spearman_by_season", lambda t: K.spearman(start_forecast(t), "y", "p", ["season_idx"]), rho_sql(_ST, "y", "p", "season_idx"), "rho")
query(
    "m22_baseline_scores",
    lambda t: _branches(hex_panel(t)).transform(lambda d: K.spearman(d.where("season_idx >= 16"), "y", "p", ["branch"])),
    rho_sql(" UNION ALL ".join(f"SELECT '{c}' AS branch, season_idx, log_{c} AS y, persist_{c} AS p FROM ({HEX}) WHERE season_idx >= 16" for c in ("natural", "human", "total")), "y", "p", "branch"),
    "rho",
)


def _branches(p):
    return p.select("cell", "season_idx", "season_year", "ord", F.explode(F.array(*[F.struct(F.lit(c).alias("branch"), F.col(f"log_{c}").alias("y"), F.col(f"persist_{c}").alias("p")) for c in ("natural", "human", "total")])).alias("r")).select("cell", "season_idx", "season_year", "ord", "r.*")


BRANCHES = " UNION ALL ".join(f"SELECT '{c}' AS branch, cell, season_idx, season_year, ord, log_{c} AS y, persist_{c} AS p FROM ({HEX})" for c in ("natural", "human", "total"))
PREDICT = rho_sql(f"SELECT * FROM ({BRANCHES}) WHERE season_idx BETWEEN 16 AND 25", "y", "p", "branch, ord, season_year")


def _predictability(t):
    rows = _branches(hex_panel(t)).where("season_idx between 16 and 25")
    return K.spearman(rows, "y", "p", ["branch", "ord", "season_year"]).where("n >= 50")


query("m18_season_predictability", _predictability, f"SELECT * FROM ({PREDICT}) WHERE n >= 50", "rho")
query(
    "m25_predictability_spread",
    lambda t: _predictability(t).groupBy("branch", "ord").agg(F.median("rho").alias("mid"), F.min("rho").alias("low"), F.max("rho").alias("high")),
    f"SELECT branch, ord, median(rho) AS mid, min(rho) AS low, max(rho) AS high FROM ({PREDICT}) WHERE n >= 50 GROUP BY ALL",
    "mid low high",
)
query(
    "m13_hurdle_frames",
    lambda t: hex_panel(t).where("ord = 2").agg(F.count(F.lit(1)).alias("occurrence"), F.count_if((F.col("size_total") > 0) & F.col("cond_total").isNotNull()).alias("magnitude")),
    f"SELECT count(*) AS occurrence, count(*) FILTER (size_total > 0 AND cond_total IS NOT NULL) AS magnitude FROM ({HEX}) WHERE ord = 2",
)
_MAG = f"SELECT ord, log_total AS y, cond_total AS p FROM ({HEX}) WHERE size_total > 0 AND cond_total IS NOT NULL AND season_idx >= 16"
query(
    "m23_magnitude_scores",
    lambda t: K.spearman(hex_panel(t).where("size_total > 0 and cond_total is not null and season_idx >= 16"), "log_total", "cond_total", ["ord"]),
    rho_sql(_MAG, "y", "p", "ord"),
    "rho",
)
query(
    "m23_occurrence_scores",
    lambda t: K.spearman(hex_panel(t).where("season_idx >= 16").withColumn("any", (F.col("size_total") > 0).cast("int")), "any", "persist_total", ["ord"]),
    rho_sql(f"SELECT ord, (size_total > 0)::INT AS y, persist_total AS p FROM ({HEX}) WHERE season_idx >= 16", "y", "p", "ord"),
    "rho",
)
query(
    "m12_marginal_signal",
    lambda t: K.spearman(t.tier1.where(_test() & (F.col("season") == "JJA")).select("human", F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in ("log_total", "n", "log_mean_size")])).alias("r")).select("human", "r.*"), "human", "v", ["covariate"]),
    rho_sql("UNPIVOT (SELECT human, log_total, n::DOUBLE AS n, log_mean_size FROM tier1 WHERE season_year >= 1999 AND season = 'JJA') ON log_total, n, log_mean_size INTO NAME covariate VALUE v", "human", "v", "covariate"),
    "rho",
)


def _network_sql(x: str, seed: str) -> str:
    """What K.shuffled_rank's network makes of x among n, with bits b of which l are low."""
    keys = ", ".join(f"((({seed})::BIGINT * 2654435 + {i * 40503 + 97}) * 48271 % 1073741789) * 2 + {i % 2}" for i in range(1, K.ROUNDS + 1))
    mixed = lambda v: f"((({v}) * {K.STEP_1} + k) % {K.PRIME_1} * {K.STEP_2} % {K.PRIME_2} // {K.DROPPED})"
    hi, lo = f"xor(x // l, {mixed('x % l')} % h) * l + x % l", f"x // l * l + xor(x % l, {mixed('x // l')} % l)"
    return f"list_reduce([({x})::BIGINT, {keys}], lambda x, k: CASE WHEN k % 2 = 1 THEN {hi} ELSE {lo} END)"


def dealt_sql(source: str, seed: str) -> str:
    """The rows of source (with r, a rank from 1, and n) and dealt, the rank that r is shuffled to."""
    sized = f"SELECT *, (1::BIGINT << (b // 2)::INT) AS l, (1::BIGINT << (b - b // 2)::INT) AS h FROM (SELECT *, greatest(2, length(bin(n - 1))) AS b FROM ({source}))"
    return f"""(WITH RECURSIVE walk AS (SELECT *, {_network_sql('r - 1', seed)} AS at_ FROM ({sized})
      UNION ALL SELECT * REPLACE ({_network_sql('at_', seed)} AS at_) FROM walk WHERE at_ >= n) SELECT * EXCLUDE (at_, b, l, h), at_ + 1 AS dealt FROM walk WHERE at_ < n)"""


def twin_sql(source: str, by: str) -> str:
    """K.shuffled_twin of y and p of source (with key), by the columns by."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY key) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM ({source}) WHERE y IS NOT NULL AND p IS NOT NULL"
    dealt = f"SELECT a.* EXCLUDE (p, r, n), b.p FROM ({ranked}) a JOIN {dealt_sql(ranked, '11')} b ON a.r = b.dealt AND {' AND '.join(f'a.{c} = b.{c}' for c in by.split(', '))}"
    return f"SELECT x.*, y.rho AS rho_shuffled FROM ({rho_sql(source, 'y', 'p', by)}) x JOIN ({rho_sql(dealt, 'y', 'p', by)}) y USING ({by})"


STARTED = f"SELECT cell::VARCHAR || ':' || season_idx::VARCHAR AS key, season_idx, starts_total AS y, avg(starts_total) {CELLS.format(k=3)} AS p FROM starts"
_RANKED = f"SELECT y, p, row_number() OVER (ORDER BY key) AS r, count(*) OVER () AS n FROM ({STARTED}) WHERE p IS NOT NULL AND season_idx >= 16"
query(
    "m14_shuffled_null",
    lambda t: K.spearman(K.permuted(start_forecast(t).where("p is not null and season_idx >= 16").withColumn("key", F.concat_ws(":", "cell", "season_idx")), ["p"], "key", 11), "y", "p_permuted"),
    rho_sql(f"SELECT a.y, b.p FROM ({_RANKED}) a JOIN {dealt_sql(_RANKED, '11')} b ON a.r = b.dealt", "y", "p"),
    "rho",
)
_KEY = "cell::VARCHAR || ':' || season_idx::VARCHAR"


def keyed(df):
    return df.withColumn("key", F.concat_ws(":", "cell", "season_idx"))


query(
    "m18_predictability_twin",
    lambda t: K.shuffled_twin(keyed(_branches(hex_panel(t)).where("season_idx between 16 and 25")).withColumn("p", F.round("p", 9)), "y", "p", "key", ["branch", "ord", "season_year"]).where("n >= 50"),
    "SELECT * FROM (" + twin_sql(f"SELECT * REPLACE (round(p, 9) AS p), {_KEY} AS key FROM ({BRANCHES}) WHERE season_idx BETWEEN 16 AND 25", "branch, ord, season_year") + ") WHERE n >= 50",
    "rho rho_shuffled",
)
query(
    "m23_magnitude_twin",
    lambda t: K.shuffled_twin(keyed(hex_panel(t)).where("size_total > 0 and cond_total is not null and season_idx >= 16"), "log_total", "cond_total", "key", ["ord"]),
    twin_sql(f"SELECT {_KEY} AS key, * FROM (SELECT cell, season_idx, ord, log_total AS y, cond_total AS p FROM ({HEX}) WHERE size_total > 0 AND cond_total IS NOT NULL AND season_idx >= 16)", "ord"),
    "rho rho_shuffled",
)
query(
    "m23_occurrence_twin",
    lambda t: K.shuffled_twin(keyed(hex_panel(t)).where("season_idx >= 16").withColumns({"any": (F.col("size_total") > 0).cast("int"), "p": F.round("persist_total", 9)}), "any", "p", "key", ["ord"]),
    twin_sql(f"SELECT {_KEY} AS key, ord, (size_total > 0)::INT AS y, round(persist_total, 9) AS p FROM ({HEX}) WHERE season_idx >= 16", "ord"),
    "rho rho_shuffled",
)
_ALL = f"SELECT {_KEY} AS key, persist_total AS p, log_total AS y, row_number() OVER (ORDER BY {_KEY}) AS r, count(*) OVER () AS n FROM ({HEX}) WHERE persist_total IS NOT NULL AND season_idx >= 16"
_BOTH = f"""SELECT key, p, y, 'real' AS variant FROM ({_ALL}) UNION ALL SELECT a.key, a.p, b.y, 'shuffled' FROM ({_ALL}) a JOIN {dealt_sql(_ALL, '11')} b ON a.r = b.dealt"""
query(
    "m17_shuffled_calibration",
    lambda t: K.shuffled_calibration(keyed(hex_panel(t)).where("season_idx >= 16"), "persist_total", "log_total", "key"),
    f"SELECT variant, {BUCKET.format(q=20)} AS stratum, count(*) AS n, avg(p) AS predicted, avg(y) AS actual, avg(abs(p - y)) AS off FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY p, key) AS r, count(*) OVER (PARTITION BY variant) AS n FROM ({_BOTH})) GROUP BY 1, 2",
    "predicted actual off",
)
query(
    "a54_cross_place_correlation",
    lambda t: t.tier1.groupBy("place").agg(F.avg("unknown").alias("u"), F.avg("natural").alias("v")).agg(K.guarded_corr("u", "v").alias("pearson")),
    'SELECT corr(u, v) AS pearson FROM (SELECT place, avg(unknown) AS u, avg("natural") AS v FROM tier1 GROUP BY ALL)',
    "pearson",
)
query(
    "a54_cross_place_rank_correlation",
    lambda t: K.spearman(t.tier1.groupBy("place").agg(F.avg("unknown").alias("u"), F.avg("natural").alias("v")), "u", "v"),
    rho_sql('SELECT place, avg(unknown) AS u, avg("natural") AS v FROM tier1 GROUP BY ALL', "u", "v"),
    "rho",
)
query(
    "a34_concentration",
    lambda t: K.cumulative_share(t.records.select("id", "size"), "size", "id").agg(*[F.max(F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * p)), F.col("cum"))).alias(f"top{int(p * 100)}") for p in (0.01, 0.05, 0.1)]),
    "SELECT " + ", ".join(f"sum(size) FILTER (r <= greatest(1, floor(n * {p}))) / sum(size) AS top{int(p * 100)}" for p in (0.01, 0.05, 0.1)) + " FROM (SELECT size, row_number() OVER (ORDER BY size DESC, id) AS r, count(*) OVER () AS n FROM records)",
    "top1 top5 top10",
)


def deciles(t, surface="cond_total"):
    rows = hex_panel(t).where(f"size_total > 0 and {surface} is not null and season_idx >= 16").select(F.concat_ws(":", "cell", "season_idx").alias("key"), "size_total", "log_total", F.col(surface).alias("p"))
    ranked = K.first_ranks(rows, "size_total", "key").withColumn("decile", K.equal_count_bucket(F.col("rank"), F.col("n"), 10))
    ranked = ranked.select("decile", "size_total", (F.col("p") - F.col("log_total")).alias("d"), F.abs(F.col("p") - F.col("log_total")).alias("off"))
    out = ranked.groupBy("decile").agg(F.count(F.lit(1)).alias("cells"))
    for value, name, shown in (("size_total", "mid_size", F.col("q")[0]), ("off", "times_off", F.pow(F.lit(10.0), F.col("q")[0])), ("d", "direction", F.col("q")[0])):
        out = out.join(K.quantiles(ranked, value, [0.5], ["decile"]).select("decile", shown.alias(name)), "decile")
    return out


query(
    "a58_error_by_decile",
    deciles,
    f"SELECT {BUCKET.format(q=10)} AS decile, count(*) AS cells, median(size_total) AS mid_size, pow(10, median(abs(p - log_total))) AS times_off, median(p - log_total) AS direction FROM (SELECT size_total, log_total, cond_total AS p, row_number() OVER (ORDER BY size_total, cell::VARCHAR || ':' || season_idx::VARCHAR) AS r, count(*) OVER () AS n FROM ({HEX}) WHERE size_total > 0 AND cond_total IS NOT NULL AND season_idx >= 16) GROUP BY 1",
    "mid_size times_off direction",
)
query(
    "a72_two_baselines",
    lambda t: hex_panel(t).where("size_total > 0 and cond_total is not null and season_idx >= 16").agg(F.count(F.lit(1)).alias("n"), F.pow(F.lit(10.0), F.median(F.abs(F.col("persist_total") - F.col("log_total")))).alias("off_log"), F.pow(F.lit(10.0), F.median(F.abs(F.col("cond_total") - F.col("log_total")))).alias("off_cond"), F.avg((F.col("persist_total") <= -4).cast("double")).alias("at_floor")),
    f"SELECT count(*) AS n, pow(10, median(abs(persist_total - log_total))) AS off_log, pow(10, median(abs(cond_total - log_total))) AS off_cond, avg((persist_total <= -4)::INT) AS at_floor FROM ({HEX}) WHERE size_total > 0 AND cond_total IS NOT NULL AND season_idx >= 16",
    "off_log off_cond at_floor",
)
_SITE = f"SELECT cell, size_total, persist_natural + persist_human AS pred, size_total AS actual FROM ({HEX}) WHERE place = 'NATION_3' AND season_year = 2000 AND ord = 2"


def siting(t, place="NATION_3", year=2000, ord_=2):
    return hex_panel(t).where((F.col("place") == place) & (F.col("season_year") == year) & (F.col("ord") == ord_)).select("cell", (F.col("persist_natural") + F.col("persist_human")).alias("pred"), F.col("size_total").alias("actual"))


query(
    "t05_siting_ranking",
    lambda t: siting(t).orderBy(F.col("pred").desc(), "cell").select("cell", "pred"),
    f"SELECT cell, pred FROM ({_SITE}) ORDER BY pred DESC, cell",
    "pred",
)


def capture(t):
    """For each target, the smallest prefix of the ranking that reaches it."""
    s = K.cumulative_share(siting(t), "actual", "cell", "pred").withColumnRenamed("n", "cells")
    s = s.select("*", F.explode(F.array(F.lit(0.3), F.lit(0.6), F.lit(0.9))).alias("target")).where("cum >= target - 1e-12")
    out = s.groupBy("target").agg(F.min("rank").alias("n_cells"), F.first("cells").alias("cells"), F.min("cum").alias("captured"))
    return out.withColumns({"ground": F.col("n_cells") / F.col("cells")}).withColumn("lift", F.col("captured") / F.col("ground"))


query(
    "t06_capture_bands",
    capture,
    f"SELECT target, min(rank) AS n_cells, any_value(cells) AS cells, min(cum) AS captured, min(rank) / any_value(cells) AS ground, min(cum) / (min(rank) / any_value(cells)) AS lift FROM (SELECT row_number() OVER w AS rank, count(*) OVER () AS cells, sum(actual) OVER w / sum(actual) OVER () AS cum FROM ({_SITE}) WINDOW w AS (ORDER BY pred DESC, cell ROWS UNBOUNDED PRECEDING)), (SELECT unnest([0.3, 0.6, 0.9])::DOUBLE AS target) WHERE cum >= target - 1e-12 GROUP BY ALL",
    "target captured ground lift",
)
