"""Learned rungs by MLlib, and ladders that compare them with a baseline."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import total
from ..sources.artifacts import kept
from .ranks import first_ranks, shuffled_rank, spearman


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """df with a vector of features; rows with an unknown one are left out."""
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def boosted(label: str, weight: str | None = None, rounds: int = 10) -> Estimator:
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol=f"pred_{label}", maxIter=rounds, maxDepth=3, stepSize=0.2, seed=7)
    return gbt.setWeightCol(weight) if weight else gbt


def ridge(label: str, penalty: float, weight: str | None = None) -> Estimator:
    """Least squares with a penalty on squared coefficients, in MLlib's scale (see ridge_penalty)."""
    lr = LinearRegression(featuresCol="features", labelCol=label, predictionCol=f"pred_{label}", regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal")
    return lr.setWeightCol(weight) if weight else lr


def ridge_penalty(df: DataFrame, labels: list[str], weight: str) -> dict[str, float]:
    """For each label, what a penalty on the weighted sum of squared errors is
    multiplied by to be MLlib's, which divides errors by the weights and the label's deviation."""
    w = F.col(weight)
    mean = lambda x: F.sum(w * x) / F.sum(w)
    one = [F.sqrt(mean(F.col(c) * F.col(c)) - mean(F.col(c)) * mean(F.col(c))).alias(c) for c in labels]
    row = df.agg(F.sum(w).alias("__w"), *one).first()
    return {c: (row[c] or 0.0) / (row["__w"] or 1.0) for c in labels}


def standardized(df: DataFrame, features: list[str], train: Column) -> DataFrame:
    """df with features centred and scaled by their training rows; constant ones are 0."""
    row = df.where(train).agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.lit(row[f"m_{c}"]), F.lit(row[f"s_{c}"])), F.lit(0.0)) for c in features})


def simplex_predict(df: DataFrame, features: list[str], shares: list[str], train: Column, make: Callable[[str], Estimator]) -> DataFrame:
    """One regressor per share; predictions are cut at 0 and scaled to sum to 1.

    A row whose predictions are all cut to 0 is an error when it is read.
    """
    out = assembled(df.withColumn("__train", train), features)
    fit_rows = out.where("__train").persist()
    models = [make(s).fit(fit_rows) for s in shares]
    fit_rows.unpersist()
    for m in models:
        out = m.transform(out)
    cut = {s: F.greatest(F.col(f"pred_{s}"), F.lit(0.0)) for s in shares}
    all_ = total(list(cut.values()))
    return out.withColumns({f"pred_{s}": F.when(all_ > 0, c / all_).otherwise(F.raise_error(F.lit("all predicted shares of a row are 0")).cast("double")) for s, c in cut.items()}).drop("features", "__train")


def _known(panel: DataFrame, cols: list[str], train: Column) -> DataFrame:
    return panel.where(" and ".join(f"`{c}` is not null" for c in cols)).withColumn("__train", train)


def _predicted(rows: DataFrame, target: str, features: list[str], make: Callable[[str], Estimator]) -> DataFrame:
    """target and __pred of the test rows for a model of these features."""
    ready = assembled(rows, features)
    return make(target).fit(ready.where("__train")).transform(ready.where("not __train")).select(target, F.col(f"pred_{target}").cast("double").alias("__pred"))


def _scores(predictions: dict[str, DataFrame], target: str) -> DataFrame:
    """rung, n, rho: the rank score of each of the named predictions, all ranked in one pass."""
    rows = reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("rung"), target, "__pred") for name, p in predictions.items()])
    names = rows.sparkSession.createDataFrame([(name,) for name in predictions], "rung string")
    got = spearman(rows, target, "__pred", ["rung"])
    return names.join(got, "rung", "left").select("rung", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "rho")


def rank_ladder(panel: DataFrame, target: str, floor: str, rungs: dict[str, list[str]], train: Column, make: Callable[[str], Estimator]) -> DataFrame:
    """rung, n_test, rho (rank score on the test rows) and delta to the floor:
    the floor column itself, then each rung's features on top of it, all on the
    rows that know every feature."""
    used = sorted({f for fs in rungs.values() for f in fs} | {floor, target})
    rows = kept(_known(panel, used, train).select(*used, "__train"), "ladder")  # read by every model
    parts = {"floor": rows.where("not __train").select(target, F.col(floor).cast("double").alias("__pred"))}
    parts |= {name: _predicted(rows, target, [floor, *features], make) for name, features in rungs.items()}
    out = kept(_scores(parts, target), "ladder-scores").withColumnRenamed("n", "n_test").withColumn("__one", F.lit(1))
    base = out.where("rung = 'floor'").select("__one", F.col("rho").alias("__floor"))  # one row
    return out.join(base, "__one").select("rung", "n_test", "rho", (F.col("rho") - F.col("__floor")).alias("delta"))


def shuffle_control(panel: DataFrame, target: str, floor: str, covariates: list[str], train: Column, key: str, make: Callable[[str], Estimator], times: int = 10) -> DataFrame:
    """One row: the delta of the covariates to the floor, mean, deviation and
    maximum of the deltas of times refits with the covariates on other rows, and
    the separation in deviations. The floor column stays with its rows.

    The models are fitted here; rows are ranked by key once for all permutations.
    """
    rows = _known(panel, [*covariates, floor, target], train).select(key, target, floor, *covariates, "__train", F.lit(0).alias("__zero"))
    ranked = kept(first_ranks(rows, "__zero", key).select("rank", "n", target, floor, *covariates, "__train"), "shuffled")
    parts = {"floor": ranked.where("not __train").select(target, F.col(floor).cast("double").alias("__pred"))}
    for seed in range(times + 1):
        dealt = ranked
        if seed:
            other = ranked.select(shuffled_rank(F.col("rank"), F.col("n"), F.lit(seed)).alias("rank"), *covariates)
            dealt = kept(ranked.drop("n", *covariates).join(other, "rank"), f"shuffled-{seed}")
        parts[str(seed)] = _predicted(dealt, target, [floor, *covariates], make)
    got = {r["rung"]: r for r in _scores(parts, target).collect()}  # a row per permutation
    n, deltas = got["floor"]["n"], [got[str(seed)]["rho"] - got["floor"]["rho"] for seed in range(times + 1)]
    null = np.array(deltas[1:])
    spread = float(null.std())
    row = (n, deltas[0], float(null.mean()), spread, float(null.max()), (deltas[0] - float(null.mean())) / spread if spread else None)
    return panel.sparkSession.createDataFrame([row], "n_test long, delta double, null_mean double, null_std double, null_max double, separation double")


def poisson_rate(df: DataFrame, label: str, features: list[str], offset: str | None = None) -> DataFrame:
    """df with pred, a Poisson rate; the coefficient of offset in its log is fixed at 1."""
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol=label, predictionCol="pred", regParam=1e-3)
    ready = assembled(df.where(F.col(offset).isNotNull()) if offset else df, features)
    return (glm.setOffsetCol(offset) if offset else glm).fit(ready).transform(ready).drop("features")
