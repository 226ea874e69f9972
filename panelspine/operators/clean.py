"""Filters and projections of event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PanelConfig


def exclusion_mask(states: list[str], agency: str) -> Column:
    """Records of these states or this agency; unknown values are kept."""
    return F.coalesce(F.col("state").isin(states) | (F.col("agency") == agency), F.lit(False))


def exclude(records: DataFrame, states: list[str], agency: str) -> DataFrame:
    return records.where(~exclusion_mask(states, agency))


def exclusion_account(records: DataFrame, states: list[str], agency: str) -> DataFrame:
    """One row: rows by state, by agency, by both, by either, and their size."""
    s, a = F.coalesce(F.col("state").isin(states), F.lit(False)), F.coalesce(F.col("agency") == agency, F.lit(False))
    return records.agg(
        F.count_if(s).alias("by_state"),
        F.count_if(a).alias("by_agency"),
        F.count_if(s & a).alias("by_both"),
        F.count_if(s | a).alias("dropped"),
        F.sum(F.when(s | a, F.col("size")).otherwise(0.0)).alias("size_dropped"),
        F.count(F.lit(1)).alias("rows"),
    )


def missing_flag(cfg: PanelConfig, col: str = "category") -> Column:
    return F.col(col) == cfg.sentinel


def coarse_class(cfg: PanelConfig, col: str = "category") -> Column:
    """Natural, Human or Unknown."""
    return F.when(F.col(col) == cfg.sentinel, "Unknown").when(F.col(col) == cfg.natural, "Natural").when(F.col(col).isNotNull(), "Human")


def collapse_tail(records: DataFrame, col: str, keep: int, other: str = "Other") -> DataFrame:
    """col's labels but the keep most frequent ones (ties by name) become other."""
    top = records.groupBy(col).count().orderBy(F.col("count").desc(), col).limit(keep).select(col, F.lit(True).alias("__top"))
    out = records.join(F.broadcast(top), col, "left")
    return out.withColumn(col, F.when(F.col("__top"), F.col(col)).otherwise(other)).drop("__top")


def drop_partial(df: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Rows outside the incomplete boundary seasons."""
    return df.where(~F.col("season_idx").isin(*cfg.partial_seasons))


def boundary_account(df: DataFrame, cfg: PanelConfig, cell: list[str]) -> DataFrame:
    """Cells before and after drop_partial, and how many go."""
    cells = df.select(*cell).distinct()
    kept = ~F.col("season_idx").isin(*cfg.partial_seasons)
    return cells.agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"), F.count_if(~kept).alias("dropped"))


def gate(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys with at least least rows, and their number n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def one_hot(df: DataFrame, col: str, values: tuple[str, ...], prefix: str) -> DataFrame:
    return df.select("*", *[(F.col(col) == v).cast("int").alias(f"{prefix}{v}") for v in values])


def strip_doubt(s: Column) -> Column:
    """A label without the trailing "(?)" that marks a doubtful one."""
    return F.trim(F.regexp_replace(s, r"\s*\(\?\)\s*$", ""))


def normal_key(s: Column) -> Column:
    """A foreign key as trimmed text, '' for NULL."""
    return F.trim(F.coalesce(s.cast("string"), F.lit("")))


def long_form(df: DataFrame, ids: list[str], classes: list[str], pred: str, actual: str) -> DataFrame:
    """One row per class of columns pred+class and actual+class, ranked by actual."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"{pred}{c}").alias("predicted"), F.col(f"{actual}{c}").alias("actual")) for c in classes]))
    return df.select(*ids, rows.alias("r")).select(*ids, "r.*")


def half_decade(size: Column) -> Column:
    """Bins 1..16 between 0.01 and 1e6, closed on the right; NULL outside."""
    b = F.ceil((F.log10(size) + 2) * 2)
    return F.when((size > 0.01) & (size <= 1e6), b).cast("int")
