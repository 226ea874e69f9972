"""Ridge regressions from sums of products.

One aggregate over the training rows holds everything that least squares asks
of them: sums, and sums of products, of features and labels. It is as small as
features squared, whatever the rows, and merges map-side. All penalties, labels
and subsets of the features are then solved from it without reading the rows
again, and all their predictions are scored in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gram:
    """Weighted means and centred sums of products of (features, labels), and the
    features' own means and deviations, which they are standardised by."""

    features: tuple[str, ...]
    labels: tuple[str, ...]
    weight: float
    mean: np.ndarray
    cross: np.ndarray
    centre: np.ndarray
    spread: np.ndarray


@dataclass(frozen=True)
class Linear:
    """intercept + coefficients * features, in the features' own units."""

    label: str
    intercept: float
    coefficients: dict[str, float]

    def predict(self) -> Column:
        return reduce(add, [F.lit(b) * F.col(c) for c, b in self.coefficients.items()], F.lit(self.intercept))


def gram_sums(features: list[str], labels: list[str], weight: str | None) -> list[Column]:
    """The aggregates: __n, __w, of each column s (sum), u (unweighted) and v
    (unweighted squares), and p (products), named by the columns' places."""
    w = F.col(weight) if weight else F.lit(1.0)
    cols = [F.col(c).cast("double") for c in (*features, *labels)]
    out = [F.count(F.lit(1)).alias("__n"), F.sum(w).alias("__w")]
    out += [F.sum(w * x).alias(f"s{i}") for i, x in enumerate(cols)]
    out += [f.alias(f"{k}{i}") for i, x in enumerate(cols[: len(features)]) for k, f in (("u", F.sum(x)), ("v", F.sum(x * x)))]
    return out + [F.sum(w * cols[i] * cols[j]).alias(f"p{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]


def as_gram(row, features: list[str], labels: list[str]) -> Gram:
    """The Gram of a row of gram_sums. No rows, or no weight: an error."""
    if not row["__n"] or not row["__w"]:
        raise ValueError("no training rows with a weight")
    k, w, n = len(features) + len(labels), float(row["__w"]), row["__n"]
    mean = np.array([row[f"s{i}"] for i in range(k)], float) / w
    cross = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cross[i, j] = cross[j, i] = row[f"p{i}_{j}"] - w * mean[i] * mean[j]
    centre = np.array([row[f"u{i}"] for i in range(len(features))], float) / n
    square = np.array([row[f"v{i}"] for i in range(len(features))], float) / n
    return Gram(tuple(features), tuple(labels), w, mean, cross, centre, np.sqrt(np.maximum(square - centre * centre, 0)))


def gram_of(df: DataFrame, features: list[str], labels: list[str], weight: str | None = None) -> Gram:
    """One pass over df; rows with an unknown feature, label or weight are left out."""
    known = df.where(" and ".join(f"`{c}` is not null" for c in [*features, *labels, *([weight] if weight else [])]))
    return as_gram(known.agg(*gram_sums(features, labels, weight)).first(), features, labels)


def ridge(gram: Gram, label: str, penalty: float, features: list[str] | None = None) -> Linear:
    """The least weighted sum of squared errors plus penalty times the squared
    coefficients of the standardised features; the intercept is free. Constant
    features have coefficient 0."""
    chosen = [i for i, c in enumerate(gram.features) if (features is None or c in features) and gram.spread[i] > 1e-12 * (1 + abs(gram.centre[i]))]
    y = len(gram.features) + gram.labels.index(label)
    scale = gram.spread[chosen]
    left = gram.cross[np.ix_(chosen, chosen)] / np.outer(scale, scale) + penalty * np.eye(len(chosen))
    b = np.linalg.solve(left, gram.cross[chosen, y] / scale) / scale if chosen else np.zeros(0)
    return Linear(label, float(gram.mean[y] - b @ gram.mean[chosen]), {gram.features[i]: float(x) for i, x in zip(chosen, b, strict=True)})


def simplex(models: list[Linear]) -> list[Column]:
    """Predictions cut at 0 and scaled to sum to 1; NULL where all are cut."""
    cut = [F.greatest(m.predict(), F.lit(0.0)) for m in models]
    return [F.try_divide(c, reduce(add, cut)) for c in cut]


def penalty_sweep(df: DataFrame, features: list[str], shares: list[str], weight: str, train: Column, penalties: list[float], distance) -> DataFrame:
    """penalty, n and score: the mean distance of predicted and true shares over
    the rows that are not train. distance: a function of two lists of columns.

    The sums are made here, in one pass; the result is one more, over all penalties."""
    gram = gram_of(df.where(train), features, shares, weight)
    rows = df.where(~train).where(" and ".join(f"`{c}` is not null" for c in [*features, *shares]))
    scored = [F.struct(F.lit(float(p)).alias("penalty"), distance(simplex([ridge(gram, s, p) for s in shares]), [F.col(s) for s in shares]).alias("m")) for p in penalties]
    return rows.select(F.explode(F.array(*scored)).alias("r")).groupBy("r.penalty").agg(F.count("r.m").alias("n"), F.avg("r.m").alias("score"))


def predictions(df: DataFrame, models: dict[str, Linear], keep: list[str]) -> DataFrame:
    """keep, model and pred: a row for each row of df and model."""
    each = [F.struct(F.lit(name).alias("model"), m.predict().alias("pred")) for name, m in models.items()]
    return df.select(*keep, F.explode(F.array(*each)).alias("r")).select(*keep, "r.model", "r.pred")
