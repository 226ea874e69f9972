"""Covariates: grids and months to places and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spine import ord_of_index, preseason_months, year_of_index


def monthly_mean(grid: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean of the grid cells of a place and month; also joins repeated rows."""
    return grid.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def monthly_weighted_mean(grid: DataFrame, keys: list[str], col: str, lat: Column) -> DataFrame:
    """Mean by the cosine of latitude; unknown values count in neither sum."""
    w = F.cos(F.radians(lat))
    return grid.groupBy(*keys).agg(F.try_divide(F.sum(F.col(col) * w), F.sum(F.when(F.col(col).isNotNull(), w))).alias(col))


def preseason_mean(monthly: DataFrame, place: str, col: str, lag: int, lo: int, hi: int, base_year: int, emit_null: bool = True) -> DataFrame:
    """Mean of the lag months before each season lo..hi, only of full windows.

    A window with an unknown month gives NULL, or no row without emit_null.
    """
    months = monthly.where(F.col(col).isNotNull()).select(place, "month", col)
    spine = monthly.select(place).distinct().select(place, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("season_idx"))
    idx = F.col("season_idx")
    wanted = spine.select(place, "season_idx", F.explode(preseason_months(ord_of_index(idx), year_of_index(idx, base_year), lag)).alias("month"))
    got = wanted.join(months, [place, "month"], "left").groupBy(place, "season_idx").agg(F.when(F.count(col) == lag, F.avg(col)).alias(col))
    return got if emit_null else got.where(F.col(col).isNotNull())


def pixel_mean(pixels: DataFrame, cells: DataFrame, kinds: list[str], scale: float, legacy: bool = False) -> DataFrame:
    """cell, one scaled mean per kind and n_px (of the first kind); cells
    without pixels stay, with NULL. legacy divides each by the first's count."""
    sums = {k: F.sum(F.when(F.col("kind") == k, F.col("value"))) for k in kinds}
    counts = {k: F.count(F.when(F.col("kind") == k, F.col("value"))) for k in kinds}
    by = pixels.groupBy("cell").agg(*[F.try_divide(sums[k] * scale, counts[kinds[0] if legacy else k]).alias(k) for k in kinds], counts[kinds[0]].cast("int").alias("n_px"))
    return cells.join(by, "cell", "left").fillna(0, ["n_px"])
