"""Ranks and rank statistics.

A window without partitions would bring all rows to one task, and one with a
few large groups to a few. Ranks come from an index instead: the rows, range
partitioned once by (group, value, tie key) and stored with the number of their
range. The rows before each range are a running sum over one row per group and
range; ranks within a range are local. As the tie key is part of the ranges, a
value that most rows have is spread over as many as it needs. What is ranked is
stored first, so that the plan above it runs once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.artifacts import kept


def placed(df: DataFrame, by: list[str], cols: list[str], **sums: Column) -> DataFrame:
    """df, stored by range, with __r, the row's range of (by, cols), and for each
    of sums the total over the earlier ranges of its group (before_...) and over
    the group (all_...). df is read twice: give what is stored or aggregated."""
    rows = kept(df.repartitionByRange(*by, *cols).withColumn("__r", F.spark_partition_id()), "rank-index")
    totals = rows.groupBy(*by, "__r").agg(*[x.alias(k) for k, x in sums.items()])
    w = Window.partitionBy(*(by or [F.lit(1)]))
    earlier = w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__r").alias("__at"), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"before_{k}") for k in sums], *[F.sum(k).over(w).alias(f"all_{k}") for k in sums])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__r") == F.col("__at"))
    return rows.join(before if by else F.broadcast(before), same).drop("__at", *[f"__by_{c}" for c in by])


def _running(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, c, before (rows of the group with a lesser value) and n (all of
    them). counts: by, value and c, its rows; one row per distinct value."""
    inner = Window.partitionBy(*by, "__r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_c") + F.coalesce(F.sum("c").over(inner), F.lit(0))
    return placed(counts, by, [value], c=F.sum("c")).select(*by, value, "c", before.alias("before"), F.col("all_c").alias("n"))


def _counted(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))


def average_ranks(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """by, value and its average rank: one row per distinct value."""
    return _running(_counted(df, value, list(by)), value, list(by)).select(*by, value, (F.col("before") + (F.col("c") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] = ()) -> DataFrame:
    """by, q: the interpolated quantiles of value at qs as an array, from the two
    values next to each place. One row of NULL where there is no value, if by is empty."""
    at = [F.lit(q) * (F.col("n") - 1) for q in qs]
    holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("c"))
    v = F.col(value).cast("double")
    got = _running(_counted(df, value, list(by)), value, list(by)).groupBy(*by).agg(
        *[F.max(F.when(holds(F.floor(p)), v)).alias(f"lo{k}") for k, p in enumerate(at)],
        *[F.max(F.when(holds(F.ceil(p)), v)).alias(f"hi{k}") for k, p in enumerate(at)],
        *[F.max(p - F.floor(p)).alias(f"part{k}") for k, p in enumerate(at)],
    )
    return got.select(*by, F.array(*[F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"part{k}") for k in range(len(qs))]).alias("q"))


def with_quantiles(df: DataFrame, value: str, qs: list[float], of: DataFrame | None = None) -> DataFrame:
    """df with q, the quantiles of value over df (or over of), in every row. df
    is stored first: a value that is worked out anew may differ from the quantile
    that it gave in its last digit."""
    df = kept(df, "quantiled") if of is None else df
    one = quantiles(df if of is None else of, value, qs).withColumn("__one", F.lit(1))  # one row
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")


def guarded_corr(a: str, b: str) -> Column:
    """Correlation, NULL where a side is constant."""
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _pair_ranks(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, a, b, w, ra, rb, n: one row per distinct pair of known values, w rows
    of df, with the values' average ranks less their mean, among n rows.

    Pairs are counted and stored once; one index holds the values of both."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    pairs = kept(pairs, "rank-pairs")
    both = F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("a").alias("v")), F.struct(F.lit(1).alias("of"), F.col("b").alias("v")))).alias("x")
    values = pairs.select(*by, both, "w").groupBy(*by, "x.of", "x.v").agg(F.sum("w").alias("c"))
    index = _running(values, "v", [*by, "of"]).select(*by, "of", "v", (F.col("before") + (F.col("c") - F.col("n")) / 2).alias("r"), "n")
    of = lambda k, name: index.where(F.col("of") == k).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("v").alias(name), F.col("r").alias(f"r{name}"), *([F.col("n")] if k else []))
    for k, name in enumerate("ab"):
        one = of(k, name)
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], pairs[name] == one[name])
        pairs = pairs.join(one, same).drop(one[name], *[f"__{c}" for c in by])
    return pairs


def _rho(a: Column, b: Column, w: Column) -> Column:
    """Correlation of centred ranks a and b with weights w; NULL where a side is constant."""
    spread = F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))
    return F.when(spread > 0, F.try_divide(F.sum(w * a * b), spread))


def spearman(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """by, n, rho over rows where both columns are known (compared as doubles)."""
    by = list(by)
    got = _pair_ranks(df, a, b, by).groupBy(*by).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), _rho(F.col("ra"), F.col("rb"), F.col("w")).alias("rho"))
    return got


def first_ranks(df: DataFrame, value: str, key: str, by: list[str] = ()) -> DataFrame:
    """df with rank 1.. by value, ties by key; and n, the rows of the group."""
    by = list(by)
    rows = placed(kept(df, "ranked"), by, [value, key], t=F.count(F.lit(1)))
    w = Window.partitionBy(*by, "__r").orderBy(value, key)
    return rows.withColumns({"rank": F.col("before_t") + F.row_number().over(w), "n": F.col("all_t")}).drop("__r", "before_t", "all_t")


def equal_count_bucket(rank: Column, n: Column, q: int) -> Column:
    """Bucket 1..q of a rank among n >= 2, as quantile edges over ranks cut them."""
    return F.greatest(F.lit(1), F.floor(((rank - 1) * q + n - 2) / (n - 1))).cast("int")


def quartile_bucket(df: DataFrame, value: str, bucket: str = "bucket") -> DataFrame:
    """df with bucket 1..4 by interpolated quartiles of value, closed on the right."""
    v, q = F.col(value), F.col("q")
    cut = F.when(v <= q[0], 1).when(v <= q[1], 2).when(v <= q[2], 3).when(v.isNotNull(), 4)
    return with_quantiles(df, value, [0.25, 0.5, 0.75]).withColumn(bucket, cut).drop("q")


def cumulative_share(df: DataFrame, value: str, key: str, order: str | None = None) -> DataFrame:
    """df with rank by falling order (by default value; ties by key), cum, the
    share of the total of value that ranks up to it hold, and n, the rows."""
    rows = placed(kept(df.withColumn("__neg", -F.col(order or value)), "ranked"), [], ["__neg", key], t=F.count(F.lit(1)), s=F.sum(value))
    inner = Window.partitionBy("__r").orderBy("__neg", key)
    held = F.col("before_s") + F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumns({"rank": F.col("before_t") + F.row_number().over(inner), "cum": F.try_divide(held, F.col("all_s")), "n": F.col("all_t")})
    return out.drop("__neg", "__r", "before_t", "before_s", "all_t", "all_s")


#: Fixed values of the permutation: its half-rounds, walks, and the multipliers and primes of its round function.
ROUNDS, WALKS = 12, 64
STEP_1, PRIME_1, STEP_2, PRIME_2, DROPPED = 1103515245, 2147483647, 1664525, 2147483629, 1024


def round_key(seed, i: int):
    """The key of half-round i for a seed (a number or a column below a million); odd ones change the high half."""
    return ((seed * 2654435 + i * 40503 + 97) * 48271 % 1073741789) * 2 + i % 2


def shuffled_rank(rank: Column, n: Column, seed: Column) -> Column:
    """Another rank 1..n for each rank: a permutation that the seed chooses.

    rank - 1 goes through a Feistel network over the least power of two that
    holds n (4 at least), as often as it takes to come out below n. As the
    network takes each number to another one, so does the walk. Batches of ranks
    go through it together."""
    return F.pandas_udf(_walker(), "long")(rank.cast("long"), n.cast("long"), seed.cast("long"))


def _walker():
    """The walk of shuffled_rank over a batch; it holds all that it needs, so that
    workers need not have this module."""
    walks, rounds = WALKS, [(i, i * 40503 + 97) for i in range(1, ROUNDS + 1)]

    def network(x, low_bits, low, high, seed):
        mixed = lambda v, k: (v * STEP_1 + k) % PRIME_1 * STEP_2 % PRIME_2 // DROPPED
        hi, lo = np.right_shift(x, low_bits), x % low
        for i, add in rounds:
            k = ((seed * 2654435 + add) * 48271 % 1073741789) * 2 + i % 2  # round_key
            if i % 2:
                hi = hi ^ mixed(lo, k) % high
            else:
                lo = lo ^ mixed(hi, k) % low
        return hi * low + lo

    def walked(rank: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
        x, n, seed = rank.to_numpy() - 1, n.to_numpy(), seed.to_numpy()
        sizes, which = np.unique(n, return_inverse=True)
        bits = np.array([max(2, int(k - 1).bit_length()) for k in sizes], dtype=np.int64)[which]
        low_bits = bits // 2
        low, high = np.left_shift(1, low_bits), np.left_shift(1, bits - low_bits)
        todo = np.arange(len(x))
        for _ in range(walks + 1):
            x[todo] = network(x[todo], low_bits[todo], low[todo], high[todo], seed[todo])
            todo = todo[x[todo] >= n[todo]]
            if not len(todo):
                return pd.Series(x + 1)
        raise ValueError("a shuffled rank needs more walks")

    return walked


def permuted(df: DataFrame, cols: list[str], key: str, seed: int, by: list[str] = ()) -> DataFrame:
    """df with the values of cols dealt anew over the rows of each group, together,
    as *_permuted: the same for the same keys and seed. Rows are ranked by key once."""
    by = list(by)
    ranked = kept(first_ranks(df.withColumn("__zero", F.lit(0)), "__zero", key, by).drop("__zero"), "permuted")
    other = ranked.select(*[F.col(c).alias(f"__{c}") for c in by], shuffled_rank(F.col("rank"), F.col("n"), F.lit(seed)).alias("__to"), *[F.col(c).alias(f"{c}_permuted") for c in cols])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("rank") == F.col("__to"))
    return ranked.join(other, same).drop("rank", "n", "__to", *[f"__{c}" for c in by])


def shuffled_scores(df: DataFrame, a: str, b: str, key: str, times: int) -> DataFrame:
    """One row: the rank correlation of a and b, mean and deviation over times
    permutations of b, and how many deviations the real one is above.

    For scored cells of one panel: rows times permutations are made, but sorted once.
    """
    rows = kept(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(key).alias("k"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")), "scored")
    ranked = kept(first_ranks(rows.join(_pair_ranks(rows, "a", "b", []).select("a", "b", "ra", "rb"), ["a", "b"]).select("k", "ra", "rb", F.lit(0).alias("zero")), "zero", "k"), "scored-ranks")
    seeded = ranked.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(times))))
    own = seeded.select("seed", F.col("rank").alias("at"), "ra")
    other = seeded.select("seed", shuffled_rank(F.col("rank"), F.col("n"), F.col("seed")).alias("at"), "rb")
    rho = _rho(F.col("ra"), F.col("rb"), F.lit(1)).alias("rho")
    null = own.join(other, ["seed", "at"]).groupBy("seed").agg(rho)
    null = null.agg(F.avg("rho").alias("null_mean"), F.stddev_samp("rho").alias("null_std"))
    real = ranked.agg(F.count(F.lit(1)).alias("n"), rho)
    both = real.withColumn("__one", F.lit(1)).join(null.withColumn("__one", F.lit(1)), "__one").drop("__one")  # one row each
    return both.withColumn("deviations", F.try_divide(F.col("rho") - F.col("null_mean"), F.col("null_std")))


def shuffled_twin(df: DataFrame, a: str, b: str, key: str, by: list[str] = (), seed: int = 11) -> DataFrame:
    """by, n, rho and rho_shuffled: the rank correlation of a and b in each group,
    and the same after b is dealt anew over the group's rows."""
    by = list(by)
    values = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(key).alias("__key"), F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    rows = kept(values, "scored")
    pairs = _pair_ranks(rows, "__a", "__b", by)
    pairs = pairs.select(*[F.col(c).alias(f"__of_{c}") for c in by], "a", "b", "ra", "rb")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b")))
    # what is dealt anew are ranks: those of a and b are the same before and after
    dealt = permuted(rows.join(pairs, same).select(*by, "__key", "ra", "rb"), ["rb"], "__key", seed, by)
    rho = lambda c: _rho(F.col("ra"), F.col(c), F.lit(1))
    return dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rho("rb").alias("rho"), rho("rb_permuted").alias("rho_shuffled"))


def shuffled_calibration(df: DataFrame, pred: str, actual: str, key: str, strata: int = 20, seed: int = 11) -> DataFrame:
    """variant (real or shuffled), stratum, n, predicted, actual and off (mean
    absolute difference): rows in strata of equal count by the prediction, with
    their own actual values and with values dealt anew over all rows."""
    rows = permuted(df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull()).select(key, F.col(pred).alias("p"), F.col(actual).alias("y")), ["y"], key, seed)
    ranked = first_ranks(rows, "p", key).withColumn("stratum", equal_count_bucket(F.col("rank"), F.col("n"), strata))
    which = F.explode(F.array(F.struct(F.lit("real").alias("variant"), F.col("y").alias("v")), F.struct(F.lit("shuffled").alias("variant"), F.col("y_permuted").alias("v")))).alias("x")
    return ranked.select("stratum", "p", which).groupBy("x.variant", "stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg("x.v").alias("actual"), F.avg(F.abs(F.col("p") - F.col("x.v"))).alias("off"))
