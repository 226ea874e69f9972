"""The validation roster: named checks of records, grain, features and panel.

All row checks of a table are counted in one pass; checks across rows or tables
are tables of violations. Nothing fails before all have been counted
(``contracts.raise_on_violations``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PanelConfig
from .contracts import checks, key_violations

CELL = ["place", "season_idx"]


def record_rules(cfg: PanelConfig) -> dict[str, str]:
    """What is wrong with a single record, as SQL conditions."""
    order = "CASE season WHEN 'DJF' THEN 0 WHEN 'MAM' THEN 1 WHEN 'JJA' THEN 2 WHEN 'SON' THEN 3 END"
    return {
        "keys_known": "id IS NULL OR date IS NULL OR size IS NULL OR category IS NULL OR season IS NULL OR season_idx IS NULL",
        "excluded_state_absent": "state = 'MACHINERY'",
        "excluded_agency_absent": "agency = 'P'",
        "season_labels": "season NOT IN ('DJF', 'MAM', 'JJA', 'SON')",
        "season_idx_reconstructible": f"season_idx <> (season_year - {cfg.base_year}) * 4 + {order}",
        "december_is_winter": "month(date) = 12 AND season <> 'DJF'",
        "december_counts_forward": "month(date) = 12 AND season_year <> year(date) + 1",
        "other_months_keep_their_year": "month(date) <> 12 AND season_year <> year(date)",
        "season_year_of_date": "season_year <> year(date) + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END",
        "season_of_month": f"{order} <> floor((month(date) % 12) / 3)",
        "parent_known_with_place": "place IS NOT NULL AND parent IS NULL",
        "sizes_not_negative": "size < 0",
    }


def grain_rules(cfg: PanelConfig) -> dict[str, str]:
    return {
        "sentinel_is_no_category": f"category = '{cfg.sentinel}'",
        "no_negative_quantities": "size < 0 OR n < 0 OR missing_size < 0 OR missing_n < 0",
        "share_bounds": "share < 0 OR share > 1",
        "share_unknown_where_empty": "(share IS NULL) <> (cell_size <= 0)",
        "missing_frac_bounds": "missing_frac < 0 OR missing_frac > 1",
        "size_needs_a_count": "size > 0 AND n = 0",
    }


def feature_rules(cfg: PanelConfig) -> dict[str, str]:
    return {
        "composition_sums_to_one": 'abs(human + "natural" + unknown - 1) > 1e-9',
        "composition_bounds": 'least(human, "natural", unknown) < 0 OR greatest(human, "natural", unknown) > 1 + 1e-12',
        "partial_seasons_gone": f"season_idx IN ({', '.join(map(str, cfg.partial_seasons))})",
        "log_total_of_total": "abs(log_total - log10(total)) > 1e-9",
        "totals_positive": "NOT total > 0",
    }


PANEL_RULES = {"parts_sum": "starts_natural + starts_human + starts_unknown <> starts_total", "counts_not_negative": "starts_total < 0"}


def row_checks(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """name, violations for conditions on single rows, in one pass."""
    one = df.agg(*[F.count_if(F.expr(rule.replace('"', "`"))).alias(name) for name, rule in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def roster(records: DataFrame, grain: DataFrame, features: DataFrame, panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """name, violations, one row for each check; 0 where all is well.

    records are those kept after the exclusion; NULLs that a rule does not name
    violate nothing but keys_known; checks of shares count 1 if they fail.
    """
    known = records.where(F.col("category") != cfg.sentinel)
    source = known.groupBy(*CELL).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    lost = records.where(F.col("category") == cfg.sentinel).groupBy(*CELL).agg(F.sum("size").alias("lost"))
    cells = grain.groupBy(*CELL).agg(
        F.sum("size").alias("g_size"), F.sum("n").alias("g_n"), F.sum("share").alias("share"), F.count(F.lit(1)).alias("rows"), F.max("cell_size").alias("cell_size"), F.min("missing_size").alias("low"), F.max("missing_size").alias("high"), F.min("missing_n").alias("n_low"), F.max("missing_n").alias("n_high")
    )
    both = cells.join(source, CELL, "full").join(lost, CELL, "full")
    per_cell = {
        "grain_is_dense": "rows <> 4",
        "shares_sum_to_one": "cell_size > 0 AND abs(share - 1) > 1e-9",
        "cell_size_is_the_sum": "abs(g_size - cell_size) > 1e-6 * greatest(1, cell_size)",
        "missing_constant_in_cell": "low <> high OR n_low <> n_high",
        "attributed_size_agrees_by_cell": "abs(g_size - size) > 1e-6 * greatest(1, size)",
        "attributed_count_agrees_by_cell": "g_n <> n",
        "covers_the_cells_with_a_category": "(g_size IS NULL) <> (size IS NULL)",
        "missing_size_agrees_by_cell": "g_size IS NOT NULL AND abs(high - coalesce(lost, 0)) > 1e-6 * greatest(1, high)",
        "no_invented_missing_size": "g_size IS NOT NULL AND high > 0 AND lost IS NULL",
    }
    share = lambda df, part, least: df.agg((F.sum(F.when(F.expr(part), F.col("size")).otherwise(0.0)) / F.sum("size")).alias("s")).where(F.col("s") < least)
    span = records.agg(F.min("season_idx").alias("lo"), F.max("season_idx").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("season_idx"))
    totals = both.agg(F.sum("size").alias("size"), F.sum("lost").alias("lost"), F.sum(F.when(F.col("g_size").isNull(), F.col("lost"))).alias("orphan"), F.sum("g_size").alias("g_size"), F.sum("g_n").alias("g_n"), F.sum("n").alias("n"))
    across = [
        ("record_key", key_violations(records, ["id"])),
        ("retained_state_present", records.agg(F.count_if(F.col("state") == "BUILDING").alias("k")).where("k = 0")),
        ("season_idx_contiguous", span.join(records.select("season_idx"), "season_idx", "left_anti")),
        ("one_year_per_season_idx", records.groupBy("season_idx").agg(F.countDistinct("season_year").alias("k")).where("k > 1")),
        ("one_parent_per_place", records.groupBy("place").agg(F.countDistinct("parent").alias("k")).where("k > 1")),
        ("placed_size", share(records, "place IS NOT NULL", 0.999)),
        ("placed_size_of_retained_state", share(records.where("state = 'BUILDING'"), "place IS NOT NULL", 0.97)),
        ("grain_key", key_violations(grain, [*CELL, "category"])),
        ("attributed_size_agrees", totals.where("abs(g_size - size) > 1e-6 * greatest(1, size)")),
        ("attributed_count_agrees", totals.where("g_n <> n")),
        ("orphan_cells_negligible", totals.where("coalesce(orphan, 0) >= 0.001 * (size + coalesce(lost, 0))")),
        ("places_of_records", grain.select("place").join(records.select("place"), "place", "left_anti").distinct()),
        ("vocabulary_of_records", known.select("category").distinct().join(grain.select("category").distinct().withColumn("g", F.lit(1)), "category", "full").where("g is null").unionByName(grain.select("category", F.lit(1).alias("g")).join(known.select("category"), "category", "left_anti").distinct())),
        ("feature_key", key_violations(features, CELL)),
        ("features_of_grain", features.select(*CELL).join(grain.select(*CELL), CELL, "left_anti")),
        ("panel_key", key_violations(panel, ["cell", "season_idx"])),
        ("panel_is_dense", panel.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).where(f"k <> {cfg.last_idx + 1}")),
    ]
    parts = [row_checks(records, record_rules(cfg)), row_checks(grain, grain_rules(cfg)), row_checks(features, feature_rules(cfg)), row_checks(panel, PANEL_RULES), row_checks(both, per_cell), checks(across)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def roster_sql(cfg: PanelConfig, records: str = "records", grain: str = "grain", features: str = "tier1", panel: str = "starts") -> str:
    """The same counts as one SQL text over tables of these names."""
    s, ok = f"category = '{cfg.sentinel}'", f"category <> '{cfg.sentinel}'"
    source = f"(SELECT place, season_idx, sum(size) AS size, count(*) AS n FROM {records} WHERE {ok} GROUP BY ALL)"
    lost = f"(SELECT place, season_idx, sum(size) AS lost FROM {records} WHERE {s} GROUP BY ALL)"
    cells = f"(SELECT place, season_idx, sum(size) AS g_size, sum(n) AS g_n, max(missing_size) AS high FROM {grain} GROUP BY ALL)"
    key = lambda table, names: f"SELECT 1 FROM {table} GROUP BY {names} HAVING count(*) > 1 OR {' OR '.join(f'{n.strip()} IS NULL' for n in names.split(','))}"
    found = {
        "grain_is_dense": f"SELECT 1 FROM {grain} GROUP BY place, season_idx HAVING count(*) <> 4",
        "shares_sum_to_one": f"SELECT 1 FROM {grain} GROUP BY place, season_idx HAVING max(cell_size) > 0 AND abs(sum(share) - 1) > 1e-9",
        "cell_size_is_the_sum": f"SELECT 1 FROM {grain} GROUP BY place, season_idx HAVING abs(sum(size) - max(cell_size)) > 1e-6 * greatest(1, max(cell_size))",
        "missing_constant_in_cell": f"SELECT 1 FROM {grain} GROUP BY place, season_idx HAVING count(DISTINCT missing_size) > 1 OR count(DISTINCT missing_n) > 1",
        "attributed_size_agrees_by_cell": f"SELECT 1 FROM {cells} c JOIN {source} s USING (place, season_idx) WHERE abs(g_size - size) > 1e-6 * greatest(1, size)",
        "attributed_count_agrees_by_cell": f"SELECT 1 FROM {cells} c JOIN {source} s USING (place, season_idx) WHERE g_n <> n",
        "covers_the_cells_with_a_category": f"SELECT 1 FROM {cells} c FULL JOIN {source} s USING (place, season_idx) WHERE (g_size IS NULL) <> (size IS NULL)",
        "missing_size_agrees_by_cell": f"SELECT 1 FROM {cells} c LEFT JOIN {lost} l USING (place, season_idx) WHERE abs(high - coalesce(lost, 0)) > 1e-6 * greatest(1, high)",
        "no_invented_missing_size": f"SELECT 1 FROM {cells} c LEFT JOIN {lost} l USING (place, season_idx) WHERE high > 0 AND lost IS NULL",
        "record_key": key(records, "id"),
        "retained_state_present": f"SELECT 1 FROM (SELECT count(*) FILTER (state = 'BUILDING') AS k FROM {records}) WHERE k = 0",
        "season_idx_contiguous": f"SELECT unnest(range(min(season_idx), max(season_idx) + 1)) FROM {records} EXCEPT SELECT season_idx FROM {records}",
        "one_year_per_season_idx": f"SELECT 1 FROM {records} GROUP BY season_idx HAVING count(DISTINCT season_year) > 1",
        "one_parent_per_place": f"SELECT 1 FROM {records} GROUP BY place HAVING count(DISTINCT parent) > 1",
        "placed_size": f"SELECT 1 FROM {records} HAVING sum(CASE WHEN place IS NOT NULL THEN size ELSE 0 END) / sum(size) < 0.999",
        "placed_size_of_retained_state": f"SELECT 1 FROM {records} WHERE state = 'BUILDING' HAVING sum(CASE WHEN place IS NOT NULL THEN size ELSE 0 END) / sum(size) < 0.97",
        "grain_key": key(grain, "place, season_idx, category"),
        "attributed_size_agrees": f"SELECT 1 FROM (SELECT sum(size) AS a FROM {grain}), (SELECT sum(size) AS b FROM {records} WHERE {ok}) WHERE abs(a - b) > 1e-6 * greatest(1, b)",
        "attributed_count_agrees": f"SELECT 1 FROM (SELECT sum(n) AS a FROM {grain}), (SELECT count(*) AS b FROM {records} WHERE {ok}) WHERE a <> b",
        "orphan_cells_negligible": f"SELECT 1 FROM (SELECT sum(size) AS t, coalesce(sum(size) FILTER ({s} AND (place, season_idx) NOT IN (SELECT (place, season_idx) FROM {grain})), 0) AS o FROM {records}) WHERE o >= 0.001 * t",
        "places_of_records": f"SELECT place FROM {grain} EXCEPT SELECT place FROM {records}",
        "vocabulary_of_records": f"(SELECT category FROM {grain} EXCEPT SELECT category FROM {records} WHERE {ok}) UNION ALL (SELECT category FROM {records} WHERE {ok} EXCEPT SELECT category FROM {grain})",
        "feature_key": key(features, "place, season_idx"),
        "features_of_grain": f"SELECT 1 FROM {features} WHERE (place, season_idx) NOT IN (SELECT (place, season_idx) FROM {grain})",
        "panel_key": key(panel, "cell, season_idx"),
        "panel_is_dense": f"SELECT 1 FROM {panel} GROUP BY cell HAVING count(*) <> {cfg.last_idx + 1}",
    }
    rows = [f"SELECT '{n}' AS name, count(*) FILTER ({r}) AS violations FROM {t}" for t, rules in ((records, record_rules(cfg)), (grain, grain_rules(cfg)), (features, feature_rules(cfg)), (panel, PANEL_RULES)) for n, r in rules.items()]
    return " UNION ALL ".join([*rows, *(f"SELECT '{n}' AS name, count(*) AS violations FROM ({q}) AS v" for n, q in found.items())])
