"""Descriptive tables of event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import ratio
from .ranks import guarded_corr, with_quantiles


def rates(df: DataFrame, keys: list[str], flag: Column, least: int = 1) -> DataFrame:
    """keys, n, rate of flag, for groups of at least least rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("rate")).where(F.col("n") >= least)


def spread(df: DataFrame, col: str) -> DataFrame:
    return df.agg((F.max(col) - F.min(col)).alias("spread"))


def completeness(df: DataFrame) -> DataFrame:
    """column, known: the share of rows in which each column is not NULL."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("known")) for c in df.columns])).alias("r")).select("r.*")


def shares(df: DataFrame, by: list[str], part: str, value: Column) -> DataFrame:
    """by, part, value and its share of the by group."""
    sums = df.groupBy(*by, part).agg(value.alias("value"))
    return sums.withColumn("share", ratio(F.col("value"), F.sum("value").over(Window.partitionBy(*(by or [F.lit(1)])))))


def leaders(df: DataFrame, by: list[str], part: str, value: Column) -> DataFrame:
    """by, leader and its share of value; ties go to the first by name."""
    s = shares(df, by, part, value)
    w = Window.partitionBy(*by).orderBy(F.col("value").desc(), part)
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").select(*by, F.col(part).alias("leader"), "share")


def summary(df: DataFrame, col: str, qs: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """One row: count, mean, std, min, exact percentiles, max."""
    one = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("low"), F.max(col).alias("high"))
    both = with_quantiles(one, col, list(qs), of=df)
    return both.select("n", "mean", "std", "low", *[F.col("q")[k].alias(f"p{int(q * 100)}") for k, q in enumerate(qs)], "high")


def concentration(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, hhi and top share of value; NULL where it sums to 0."""
    s = F.sum(value)
    return df.groupBy(*by).agg(ratio(F.sum(F.col(value) * F.col(value)), s * s).alias("hhi"), ratio(F.max(value), s).alias("top"))


def trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, slope, intercept of y on x."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def detrended_correlation(df: DataFrame, by: list[str], x: str, a: str, b: str) -> DataFrame:
    """Correlation of a and b after the linear trend in x is taken from both."""
    w = Window.partitionBy(*by)
    residual = lambda y: F.col(y) - F.regr_intercept(y, x).over(w) - F.regr_slope(y, x).over(w) * F.col(x)
    return df.select(*by, residual(a).alias("ra"), residual(b).alias("rb")).groupBy(*by).agg(guarded_corr("ra", "rb").alias("r"))


def dispersion(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """mean, variance, their ratio, the share of zeros beside exp(-mean), max."""
    return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.var_samp(col).alias("variance"), ratio(F.var_samp(col), F.avg(col)).alias("ratio"), F.avg((F.col(col) == 0).cast("double")).alias("zeros"), F.exp(-F.avg(col)).alias("poisson_zeros"), F.max(col).alias("high"))


def week_curves(records: DataFrame, kind: Column, years: int) -> DataFrame:
    """kind, week 0..51 (the 53rd folded in), events per year; weeks are dense."""
    week = F.least((F.dayofyear("date") - 1).cast("int"), F.lit(363))
    sums = records.groupBy(kind.alias("kind"), F.floor(week / 7).cast("int").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    weeks = sums.select("kind").distinct().select("kind", F.explode(F.sequence(F.lit(0), F.lit(51))).alias("week"))
    return weeks.join(sums, ["kind", "week"], "left").select("kind", "week", (F.coalesce("n", F.lit(0)) / years).alias("per_year"))


def solo_event(events: DataFrame, least: float) -> DataFrame:
    """The event that is alone in its perimeter, of at least least, and nearest
    to the median of those; the first id of equals. events: id, size, perimeter."""
    alone = events.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("perimeter"))).where((F.col("n") == 1) & (F.col("size") >= least))
    near = with_quantiles(alone, "size", [0.5])
    return near.orderBy(F.abs(F.col("size") - F.col("q")[0]), "id").limit(1).select("id", "size")


def two_way(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """row, col, n, mean of each cell, and of the margins as 'all': one aggregate by grouping sets."""
    name = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c).cast("string")).alias(f"__{c}")
    got = df.cube(row, col).agg(name(row), name(col), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return got.select(F.col(f"__{row}").alias(row), F.col(f"__{col}").alias(col), "n", "mean")


def spreads(table: DataFrame, row: str, col: str) -> DataFrame:
    """down, across: the largest mean over the smallest within a column, averaged
    over columns, and within a row. Lines with a smallest mean of zero have no ratio."""
    inner = table.where((F.col(row) != "all") & (F.col(col) != "all"))
    lines = F.explode(F.array(F.struct(F.lit("down").alias("way"), F.col(col).alias("line")), F.struct(F.lit("across").alias("way"), F.col(row).alias("line"))))
    each = inner.select("mean", lines.alias("x")).groupBy("x.way", "x.line").agg(ratio(F.max("mean"), F.min("mean")).alias("s"))
    return each.agg(*[F.avg(F.when(F.col("way") == way, F.col("s"))).alias(way) for way in ("down", "across")])
