"""Checks of tables, as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, columns, an order-free content hash, and for each column
    its sum (numbers) or number of distinct values."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("content")]
    for name, kind in df.dtypes:
        if kind in ("double", "float"):  # decimals add up the same in any order
            aggs.append(F.sum(F.col(name).cast("decimal(38,6)")).cast("double").alias(f"sum_{name}"))
        else:
            aggs.append(F.sum(name).alias(f"sum_{name}") if kind in ("int", "bigint") else F.countDistinct(name).alias(f"distinct_{name}"))
    return df.agg(*aggs)


def checks(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """name, violations: one row for each named table of violations."""
    return reduce(lambda a, b: a.unionByName(b), [v.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("name"), "violations") for n, v in parts])


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are NULL or repeated."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | null)


def bound_violations(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.where((F.col(col) < lo) | (F.col(col) > hi))


def raise_on_violations(report: DataFrame) -> None:
    """Fails once, with all checks that found something."""
    bad = {r["name"]: r["violations"] for r in report.where("violations > 0").collect()}
    if bad:
        raise ValueError(f"violations: {bad}")
