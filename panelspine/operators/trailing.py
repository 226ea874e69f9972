"""Forecasts of a series from its strictly earlier rows.

A window frame of rows before the current one never sees the row itself, and it
counts occurrences, not years, so gaps in a series are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(series: list[str], k: int | None, idx: str = "season_idx"):
    """The last k rows before this one (all of them for None)."""
    return Window.partitionBy(*series).orderBy(idx).rowsBetween(Window.unboundedPreceding if k is None else -k, -1)


def trailing_mean(col: str, series: list[str], k: int | None, idx: str = "season_idx") -> Column:
    """NULL on the first row; NULL values are left out of the mean."""
    return F.avg(col).over(before(series, k, idx))


def trailing_std(col: str, series: list[str], k: int | None, least: int = 2, idx: str = "season_idx") -> Column:
    """Sample deviation where at least least values are known."""
    w = before(series, k, idx)
    return F.when(F.count(col).over(w) >= least, F.stddev_samp(col).over(w))


def exact_step(col: str, series: list[str], step: int = 4, idx: str = "season_idx") -> Column:
    """The row before, if it is exactly step back."""
    w = Window.partitionBy(*series).orderBy(idx)
    return F.when(F.col(idx) - F.lag(idx).over(w) == step, F.lag(col).over(w))


def depth(series: list[str], idx: str = "season_idx") -> Column:
    """How many rows of the series come before."""
    return (F.row_number().over(Window.partitionBy(*series).orderBy(idx)) - 1).cast("int")


def trailing_sum(col: str, series: list[str], k: int, idx: str = "season_idx") -> Column:
    return F.coalesce(F.sum(col).over(before(series, k, idx)), F.lit(0.0))


def since_last(col: str, series: list[str], most: int, idx: str = "season_idx") -> Column:
    """Steps since the last earlier row with a positive col; most if there is none."""
    last = F.max(F.when(F.col(col) > 0, F.col(idx))).over(before(series, None, idx))
    return F.coalesce(F.col(idx) - last, F.lit(most)).cast("int")


def train_mean(col: str, keys: list[str], train: Column) -> Column:
    return F.avg(F.when(train, F.col(col))).over(Window.partitionBy(*keys))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: a window over them has no fixed order."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def audit(df: DataFrame, col: str, series: list[str], k: int, sample: int | None = None, idx: str = "season_idx") -> DataFrame:
    """keys, mean: trailing_mean worked out by a join of sampled rows with all
    earlier ones. The sample is that of least key hash (None: all rows of a small
    table); rows without an earlier one are left out."""
    chosen = df if sample is None else df.orderBy(F.md5(F.concat_ws(":", *series, idx)), *series, idx).limit(sample)
    a = chosen.select(*series, F.col(idx).alias("at"))
    b = df.select(*series, F.col(idx).alias("earlier"), F.col(col).alias("v"))
    both = a.join(b, series).where("earlier < at")
    rank = F.row_number().over(Window.partitionBy(*series, "at").orderBy(F.col("earlier").desc()))
    return both.withColumn("r", rank).where(F.col("r") <= k).groupBy(*series, F.col("at").alias(idx)).agg(F.avg("v").alias("mean"))
