"""Scoring forecasts on one mask, ladders of scores, and simple predictors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import weighted_mean
from .ranks import placed


def score_masked(df: DataFrame, metric: Column, weight: Column, test: Column, by: list[str] = (), **extra: Column) -> DataFrame:
    """n_cells, plain and weighted means of metric, and of each extra, over the
    rows of the test part where metric is known."""
    rows = df.select(*by, metric.alias("m"), weight.alias("w"), test.alias("t"), *[x.alias(f"x_{k}") for k, x in extra.items()]).where("t and m is not null")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("m").alias("plain"), weighted_mean(F.col("m"), F.col("w")).alias("weighted"), *[F.avg(f"x_{k}").alias(k) for k in extra])


def ladder(rows: DataFrame, baseline: str, metric: str) -> DataFrame:
    """rows with delta = metric minus the baseline's; fails if it is absent."""
    base = rows.where(F.col("rung") == baseline).select(metric).limit(1).collect()
    if not base:
        raise ValueError(f"no rung {baseline}")
    return rows.withColumn("delta", F.col(metric) - F.lit(base[0][0]))


def prior_row(df: DataFrame, cols: list[str], train: Column, weight: str | None = None) -> dict[str, float]:
    """Mean of each column over the training rows, by weight if given."""
    one = [(weighted_mean(F.col(c), F.col(weight)) if weight else F.avg(c)).alias(c) for c in cols]
    return df.where(train).agg(*one).first().asDict()


def global_prior(df: DataFrame, cols: list[str], train: Column, weight: str | None = None, prefix: str = "prior_") -> DataFrame:
    """df with the training means on every row, as literals."""
    means = prior_row(df, cols, train, weight)
    return df.select("*", *[F.lit(v).cast("double").alias(prefix + c) for c, v in means.items()])


def sweep(df: DataFrame, predict: Callable[[int | None], list[Column]], metric: Callable[[list[Column]], Column], ks: list[int | None], weight: Column, test: Column) -> DataFrame:
    """One row per window: label, n_cells, plain, weighted.

    All windows are computed in one pass over the series, then put in rows.
    """
    names = [f"k={k}" if k else "expanding" for k in ks]
    preds = {}
    for i, k in enumerate(ks):
        preds |= {f"p{i}_{j}": p for j, p in enumerate(predict(k))}
    wide = df.withColumns(preds)
    n = len(preds) // len(ks)
    scored = wide.select(test.alias("t"), weight.alias("w"), F.explode(F.array(*[F.struct(F.lit(name).alias("label"), metric([F.col(f"p{i}_{j}") for j in range(n)]).alias("m")) for i, name in enumerate(names)])).alias("r"))
    return score_masked(scored.select("t", "w", "r.label", "r.m"), F.col("m"), F.col("w"), F.col("t"), ["label"])


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, qs: list[float]) -> DataFrame:
    """by, q, value: interpolated at (cumulative weight - half weight) / total,
    clamped at the ends. Ties of value are one point with their summed weight."""
    points = df.where(f"{value} is not null and {weight} > 0").groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    points = placed(points, by, ["v"], w=F.sum("w"))
    inner = Window.partitionBy(*by, "__r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    points = points.select(*by, ((F.col("before_w") + F.sum("w").over(inner) - F.col("w") / 2) / F.col("all_w")).alias("at"), "v")
    rows = points.select("*", F.explode(F.array(*map(F.lit, qs))).alias("q"))
    point = F.struct("at", "v")
    near = rows.groupBy(*by, "q").agg(F.max(F.when(F.col("at") < F.col("q"), point)).alias("lo"), F.min(F.when(F.col("at") >= F.col("q"), point)).alias("hi"))
    part = (F.col("q") - F.col("lo.at")) / (F.col("hi.at") - F.col("lo.at"))
    return near.select(*by, "q", F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v")).otherwise(F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * part).alias("value"))
