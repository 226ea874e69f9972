"""Error measures as column expressions; NULL in gives NULL out."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def total(cols: list[Column]) -> Column:
    return reduce(add, cols)


def tvd(pred: list[Column], actual: list[Column]) -> Column:
    """Total variation distance of two compositions."""
    return 0.5 * total([F.abs(p - a) for p, a in zip(pred, actual, strict=True)])


def overlap(pred: list[Column], actual: list[Column]) -> Column:
    """Shared mass of two compositions, 1 - tvd where both sum to 1."""
    least = [F.when(p.isNotNull() & a.isNotNull(), F.least(p, a)) for p, a in zip(pred, actual, strict=True)]
    return total(least)


def argmax(cols: list[Column]) -> Column:
    """1-based place of the largest value, the first of equals; NULL if any is NULL."""
    none = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    return F.when(~none, F.array_position(F.array(*cols), F.greatest(*cols)))


def top1_hit(pred: list[Column], actual: list[Column]) -> Column:
    return (argmax(pred) == argmax(actual)).cast("double")


def absolute_error(pred: Column, actual: Column) -> Column:
    return F.abs(pred - actual)


def poisson_deviance(actual: Column, pred: Column, floor: float = 1e-6) -> Column:
    p = F.when(pred.isNotNull(), F.greatest(pred, F.lit(floor)))
    return 2 * (F.when(actual > 0, actual * F.ln(actual / p)).otherwise(0.0) - (actual - p))


def verdict(delta: Column, band: float = 0.005) -> Column:
    return F.when(delta < -band, "better").when(delta > band, "worse").when(delta.isNotNull(), "level")


def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: mean of x by w over rows where both are known."""
    both = x.isNotNull() & w.isNotNull()
    return F.try_divide(F.sum(F.when(both, x * w)), F.sum(F.when(both, w)))


def log10_floored(x: Column, least: float = 1e-4) -> Column:
    """log10 of positive values, the floor's for the others."""
    return F.when(x > 0, F.log10(F.greatest(x, F.lit(least)))).otherwise(F.lit(-4.0))


def log_positive(x: Column) -> Column:
    """Natural log of positive values, NULL for the others."""
    return F.when(x > 0, F.ln(x))
