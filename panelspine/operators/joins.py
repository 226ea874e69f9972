"""Joins that check or report on their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).count().where("count > 1").limit(1).count()


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join; fails if either side repeats a key."""
    for side, df in (("left", left), ("right", right)):
        if repeated(df, keys):
            raise ValueError(f"the {side} side repeats a key of {keys}")
    return left.join(right, keys, "left")


def join_covariates(target: DataFrame, covariates: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins on the same keys, so one partitioning serves all; gaps stay NULL."""
    return reduce(lambda a, b: a.join(b, keys, "left"), covariates, target)


def merge_all(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of both sides, of the left alone and of the right alone."""
    a, b = left.select(*keys).distinct().withColumn("l", F.lit(1)), right.select(*keys).distinct().withColumn("r", F.lit(1))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def restrict(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order; one aggregate, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return ranked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
