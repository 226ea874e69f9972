"""Every check of the roster finds what is broken on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspine.operators.roster import roster
from panelspine.plans.bindings import CFG, Tables


def changed(df, **values):
    """Columns with new values in the rows of a condition: name=(condition, value)."""
    return df.withColumns({c: F.when(F.expr(when), F.expr(value)).otherwise(F.col(c)) for c, (when, value) in values.items()})


def test_each_check_finds_its_fault(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    records = t.records.where("season_idx <> 5")
    for k, values in enumerate(
        [
            {"place": ("id % 20 = 0", "NULL")},
            {"parent": ("id % 20 = 1", "NULL")},
            {"parent": ("id % 20 = 2", "'ELSEWHERE'")},
            {"season": ("id % 20 = 3", "'WET'")},
            {"season_year": ("month(date) = 12 AND id % 2 = 0", "year(date)")},
            {"season": ("month(date) = 12 AND id % 20 = 4", "'MAM'")},
            {"season_year": ("month(date) <> 12 AND id % 20 = 5", "season_year + 1")},
            {"size": ("id % 20 = 6", "-size")},
            {"date": ("id % 20 = 7", "NULL")},
        ]
    ):
        records = changed(records, **values)
    records = records.unionByName(records.limit(1))
    grain = changed(t.grain, category=("season_idx = 3 AND category = '5-LOW'", f"'{CFG.sentinel}'"), n=("season_idx = 4", "0"), share=("season_idx = 6", "1.5"), missing_frac=("season_idx = 7", "2.0"), place=("season_idx = 8 AND place LIKE '%3'", "'NOWHERE'"))
    grain = changed(grain, size=("season_idx = 9", "-1.0"), cell_size=("season_idx = 10", "cell_size + 5"), missing_size=("season_idx = 11 AND category = '2-HIGH'", "missing_size + 7"), share=("season_idx = 12", "NULL"))
    grain = grain.where("NOT (season_idx = 13 AND category = '1-URGENT')").unionByName(grain.where("season_idx = 14").limit(1))
    grain = grain.unionByName(grain.where("season_idx = 15").withColumns({"season_idx": F.lit(90), "missing_size": F.lit(9.0)}))
    features = changed(t.tier1, human=("season_idx = 2", "human + 0.5"), natural=("season_idx = 3", "-0.1"), log_total=("season_idx = 4", "log_total + 1"), total=("season_idx = 6", "-total"), season_idx=("season_idx = 7", "0"))
    features = features.unionByName(features.limit(1)).unionByName(features.limit(1).withColumn("season_idx", F.lit(91)))
    panel = changed(t.starts, starts_total=("season_idx = 2", "starts_total + 1"), starts_human=("season_idx = 3", "-5"))
    panel = changed(panel, starts_total=("season_idx = 4", "-1")).unionByName(t.starts.limit(1))
    got = {r["name"]: r["violations"] for r in roster(records, grain, features, panel, CFG).collect()}
    assert {n for n, v in got.items() if not v} == {"retained_state_present", "placed_size_of_retained_state"} - {n for n, v in got.items() if v}
    none = roster(records.where("state <> 'BUILDING' OR state = 'BUILDING' AND place IS NULL"), t.grain.limit(0), t.tier1.limit(0), t.starts.limit(0), CFG)
    assert {r["name"]: r["violations"] for r in none.collect()}["placed_size_of_retained_state"] == 1
    gone = roster(t.records.where("state <> 'BUILDING'"), t.grain.limit(0), t.tier1.limit(0), t.starts.limit(0), CFG)
    assert {r["name"]: r["violations"] for r in gone.collect()}["retained_state_present"] == 1


def test_sound_tables_pass(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    got = {r["name"]: r["violations"] for r in roster(t.kept, t.kept_grain, t.tier1.limit(0), t.starts, CFG).collect()}
    assert len(got) > 39 and {n for n, v in got.items() if v} <= {"orphan_cells_negligible", "season_idx_contiguous"}
