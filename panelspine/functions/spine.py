"""Seasons of dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SEASONS

#: Date formats met in source files, in the order they are tried.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "M/d/yyyy H:mm")


def parse_date(s: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date of a string in any of the formats, or NULL."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("date")


def require_dates(df: DataFrame, col: str) -> DataFrame:
    """df with col parsed; fails with the number of values that no format fits."""
    bad = df.where(F.col(col).isNotNull() & parse_date(F.col(col)).isNull()).count()
    if bad:
        raise ValueError(f"{bad} values of {col} are no dates")
    return df.withColumn(col, parse_date(F.col(col)))


def season_ord(d: Column) -> Column:
    return F.floor((F.month(d) % 12) / 3).cast("int")


def season_year(d: Column) -> Column:
    return F.year(d) + (F.month(d) == 12).cast("int")


def season_index(ord_: Column, year: Column, base_year: int) -> Column:
    return ((year - base_year) * 4 + ord_).cast("int")


def season_label(ord_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEASONS)), ord_ + 1)


def ord_of_index(idx: Column) -> Column:
    return F.pmod(idx, F.lit(4)).cast("int")


def year_of_index(idx: Column, base_year: int) -> Column:
    return (base_year + F.floor(idx / 4)).cast("int")


def with_spine(df: DataFrame, date_col: str, base_year: int) -> DataFrame:
    """df with season, season_year and season_idx."""
    d = F.col(date_col)
    o, y = season_ord(d), season_year(d)
    return df.withColumns({"season": season_label(o), "season_year": y, "season_idx": season_index(o, y, base_year)})


def season_of_doy(doy: Column) -> Column:
    return F.when((doy < 60) | (doy >= 335), "DJF").when(doy < 152, "MAM").when(doy < 244, "JJA").otherwise("SON")


def month_of_doy(doy: Column) -> Column:
    """A rough month: 30 days each, the rest in December."""
    return F.least(F.lit(12), F.floor((doy - 1) / 30).cast("int") + 1)


def quarter_of_doy(doy: Column) -> Column:
    """Astronomical quarters by right-closed cuts at 79, 171 and 264."""
    return F.when(doy <= 79, 1).when(doy <= 171, 2).when(doy <= 264, 3).when(doy <= 366, 4)


def season_start(ord_: Column, year: Column) -> Column:
    """First day: winter of a year begins in December of the year before."""
    return F.when(ord_ == 0, F.make_date(year - 1, F.lit(12), F.lit(1))).otherwise(F.make_date(year, ord_ * 3, F.lit(1)))


def preseason_months(ord_: Column, year: Column, lag: int) -> Column:
    """The lag months before the season, the newest last."""
    start = season_start(ord_, year)
    return F.sequence(F.add_months(start, -lag), F.add_months(start, -1), F.expr("interval 1 month"))


def is_partial(idx: Column, partial: tuple[int, ...]) -> Column:
    return idx.isin(*partial)
