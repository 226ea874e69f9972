"""From event records to the place-by-season grain and its targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CELL, PanelConfig
from ..functions.metrics import ratio, total
from .clean import coarse_class, drop_partial, missing_flag


def cell_category(records: DataFrame, cfg: PanelConfig, cell: list[str] = CELL) -> DataFrame:
    """One row per cell and category, every category of the vocabulary present.

    size, n: sums over attributed rows; cell_size: the cell's attributed size;
    share: of it; missing_size, missing_n: what the sentinel category holds,
    repeated on each row of the cell; missing_frac: missing over all, NULL when
    all is 0. A cell with sentinel rows only has no rows here.
    """
    miss = missing_flag(cfg)
    pick = {c: F.col("category") == c for c in cfg.vocabulary}
    # One aggregate with a column per category, then one row per category: no join, one shuffle.
    wide = records.groupBy(*cell).agg(
        F.count_if(~miss).alias("__attributed"),
        F.sum(F.when(miss, F.col("size")).otherwise(0.0)).alias("missing_size"),
        F.count_if(miss).alias("missing_n"),
        *[F.sum(F.when(on, F.col("size")).otherwise(0.0)).alias(f"__s{i}") for i, on in enumerate(pick.values())],
        *[F.count_if(on).alias(f"__n{i}") for i, on in enumerate(pick.values())],
    )
    wide = wide.where("__attributed > 0").withColumn("cell_size", total([F.col(f"__s{i}") for i in range(len(pick))]))
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"__s{i}").alias("size"), F.col(f"__n{i}").alias("n")) for i, c in enumerate(pick)]))
    out = wide.select(*cell, long.alias("r"), "cell_size", "missing_size", "missing_n").select(*cell, "r.*", "cell_size", "missing_size", "missing_n")
    return out.withColumns({"share": ratio(F.col("size"), F.col("cell_size")), "missing_frac": ratio(F.col("missing_size"), F.col("missing_size") + F.col("cell_size"))})


def share_violations(grain: DataFrame, cell: list[str] = CELL, tolerance: float = 1e-9) -> DataFrame:
    """Cells with attributed size whose shares do not sum to 1."""
    return grain.groupBy(*cell).agg(F.sum("share").alias("s"), F.max("cell_size").alias("cell_size")).where((F.col("cell_size") > 0) & (F.abs(F.col("s") - 1) > tolerance))


def varying_cells(grain: DataFrame, cols: list[str], cell: list[str] = CELL) -> DataFrame:
    """Cells in which a column that should repeat does not."""
    checks = [F.countDistinct(c).alias(c) for c in cols]
    return grain.groupBy(*cell).agg(*checks).where(" or ".join(f"{c} > 1" for c in cols))


def per_cell(grain: DataFrame, cols: list[str], cell: list[str] = CELL) -> DataFrame:
    """One row per cell of columns that repeat in it; never a sum of them."""
    return grain.groupBy(*cell).agg(*[F.max(c).alias(c) for c in cols])


def series_support(grain: DataFrame, series: list[str], thresholds: tuple[int, ...] = ()) -> DataFrame:
    """Per series: seasons with rows, total size, and whether each threshold is met."""
    cells = grain.groupBy(*series, "season_idx").agg(F.sum("size").alias("size"))
    out = cells.groupBy(*series).agg(F.count(F.lit(1)).alias("seasons"), F.sum("size").alias("size"))
    return out.select("*", *[(F.col("seasons") >= t).alias(f"at_least_{t}") for t in thresholds])


def by_class(grain: DataFrame, cfg: PanelConfig, *more: Column, cell: list[str] = CELL) -> DataFrame:
    """Cells with the size of each attributed class, 0 where it is absent, and
    more aggregates of the same pass."""
    sums = {c: F.sum(F.when(coarse_class(cfg) == c, F.col("size")).otherwise(0)) for c in ("Natural", "Human")}
    return grain.groupBy(*cell).agg(*[s.alias(c.lower()) for c, s in sums.items()], *more)


def repeated_value(col: str) -> Column:
    """Aggregate: a value that all rows of a cell repeat. It is never summed."""
    return F.max(col).alias(col)


def composition(grain: DataFrame, cfg: PanelConfig, with_counts: bool = False) -> DataFrame:
    """Tier 1: human, natural and unknown shares of a cell's total size.

    Cells of the boundary seasons and cells without size are left out.
    log_total: log10 of the total. with_counts adds n and log_mean_size.
    """
    g = drop_partial(grain, cfg)
    sizes = by_class(g, cfg, repeated_value("missing_size"), repeated_value("missing_n"), F.sum("n").alias("n_attributed"))
    out = sizes.withColumn("total", F.col("natural") + F.col("human") + F.col("missing_size")).where("total > 0")
    out = out.withColumns({"natural": F.col("natural") / F.col("total"), "human": F.col("human") / F.col("total"), "unknown": F.col("missing_size") / F.col("total"), "log_total": F.log10("total")})
    extra = []
    if with_counts:
        out = out.withColumn("n", F.col("n_attributed") + F.col("missing_n"))
        out = out.withColumn("log_mean_size", F.log10(F.col("total") / F.col("n")))
        extra = ["n", "log_mean_size"]
    return out.select(*CELL, "human", "natural", "unknown", "total", "log_total", *extra)


def human_shares(grain: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Shares of the human categories (h0, h1, ... in vocabulary order) of a
    cell's human size; cells without any are left out."""
    g = drop_partial(grain, cfg)
    wide = g.groupBy(*CELL).agg(*[F.sum(F.when(F.col("category") == c, F.col("size")).otherwise(0.0)).alias(f"h{i}") for i, c in enumerate(cfg.human)])
    names = [f"h{i}" for i in range(len(cfg.human))]
    out = wide.withColumn("human_size", total([F.col(c) for c in names])).where("human_size > 0")
    return out.select(*CELL, *[(F.col(c) / F.col("human_size")).alias(c) for c in names], "human_size")


def natural_starts(grain: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Natural size and number per cell, zeros kept."""
    return drop_partial(grain, cfg).where(F.col("category") == cfg.natural).select(*CELL, F.col("size").alias("natural_size"), F.col("n").alias("natural_n"))


def attribution_quality(grain: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Missing fraction beside the attributed classes and the natural share."""
    g = drop_partial(grain, cfg)
    out = by_class(g, cfg, repeated_value("missing_frac"), repeated_value("missing_size"))
    return out.withColumn("natural_share", ratio(F.col("natural"), F.col("natural") + F.col("human"))).where("missing_frac is not null")


def class_snapshot(grain: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Size and share of the three classes over all cells."""
    g = drop_partial(grain, cfg)
    sizes = by_class(g, cfg, repeated_value("missing_size")).agg(*[F.sum(c).alias(c) for c in ("natural", "human", "missing_size")])
    long = sizes.select(F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(c).alias("size")) for n, c in (("Natural", "natural"), ("Human", "human"), ("Unknown", "missing_size"))])).alias("r"), (F.col("natural") + F.col("human") + F.col("missing_size")).alias("all"))
    return long.select("r.class", "r.size", (F.col("r.size") / 1e6).alias("millions"), ratio(F.col("r.size"), F.col("all")).alias("share"))


def cell_targets(records: DataFrame, cfg: PanelConfig, keys: list[str], least: int = 1) -> dict[str, DataFrame]:
    """weights, count_shares and size_shares at any grain.

    weights has every cell (missing rate of rows and size); the shares are of
    attributed rows, in cells with at least least of them.
    """
    miss = missing_flag(cfg)
    weights = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.avg(miss.cast("double")).alias("missing_rate"), F.sum(F.when(miss, F.col("size")).otherwise(0.0)).alias("missing_size"))
    weights = weights.withColumn("missing_size_rate", ratio(F.col("missing_size"), F.col("size"))).drop("missing_size")
    sums = records.where(~miss).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumns({"all_n": F.sum("n").over(w), "all_size": F.sum("size").over(w)}).where(F.col("all_n") >= least)
    return {
        "weights": weights,
        "count_shares": sums.select(*keys, "category", (F.col("n") / F.col("all_n")).alias("share")),
        "size_shares": sums.select(*keys, "category", ratio(F.col("size"), F.col("all_size")).alias("share")),
    }


#: Rows that one task is to make of the rows of a short table.
ROWS_OF_A_TASK = 2_000_000


def spread_rows(df: DataFrame, times: int, per_task: int | None = None) -> DataFrame:
    """df, of whose rows times as many will be made each, dealt to tasks so that
    none makes many more than per_task rows. A short table can be one file, which
    one task reads: what it makes there, and aggregates, would grow with the table."""
    return deal(df, tasks_for(df.count() * times, per_task or ROWS_OF_A_TASK), *df.columns)


def tasks_for(rows: int, per_task: int) -> int:
    return max(1, -(-rows // per_task))


def deal(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df in so many tasks by its keys. Tables dealt by the same key to as many
    tasks meet, and are aggregated by that key and others, where they lie."""
    return df.repartition(tasks, *keys) if tasks > 1 else df


def dense_spine(places: DataFrame, lo: int, hi: int) -> DataFrame:
    """Every place in every season lo..hi; a task makes a bounded number of rows,
    however few files hold the places."""
    return spread_rows(places, hi - lo + 1).select("*", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("season_idx"))


def dense_panel(events: DataFrame, grid: DataFrame, cfg: PanelConfig, value: Column, prefix: str) -> DataFrame:
    """cell x season with one value per class and their total; zeros are data.

    events: cell, season_idx, category; grid: cell, place, area.
    """
    classes = ("Natural", "Human", "Unknown")
    sums = events.groupBy("cell", "season_idx").agg(*[F.sum(F.when(coarse_class(cfg) == c, value).otherwise(0)).alias(f"{prefix}{c.lower()}") for c in classes])
    names = [f"{prefix}{c.lower()}" for c in classes]
    out = dense_spine(grid, 0, cfg.last_idx).join(sums, ["cell", "season_idx"], "left").fillna(0, names)
    return out.withColumn(f"{prefix}total", total([F.col(c) for c in names]))
