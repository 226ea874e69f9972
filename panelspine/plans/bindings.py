"""How the tables at hand stand in for event records, grids and covariates.

``Tables`` builds the inputs as DataFrames; ``VIEWS`` says the same as SQL
common table expressions, of which a query's SQL gets those that it names.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PanelConfig
from ..functions.spine import with_spine
from ..operators.grain import cell_category, composition, deal, dense_panel, human_shares, tasks_for

CFG = PanelConfig(base_year=1995, partial_seasons=(0, 26), last_idx=26, test_start=1999, sentinel="4-NOT SPECIFIED", natural="1-URGENT", human=("2-HIGH", "3-MEDIUM", "5-LOW"))
#: Lines of orders that one task aggregates by order: they hardly get fewer, so that its memory goes with them.
LINES_OF_A_TASK = 500_000


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        """Event records: orders with their customer, nation and region."""
        o, c, n, r = (self.table(t) for t in ("orders", "customer", "nation", "region"))
        rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select(
            F.col("o_orderkey").alias("id"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_totalprice").alias("size"),
            F.col("o_orderpriority").alias("category"),
            F.col("n_name").alias("place"),
            F.col("r_name").alias("parent"),
            F.col("c_mktsegment").alias("state"),
            F.col("o_orderstatus").alias("agency"),
            F.col("c_custkey").alias("cell"),
            F.col("c_acctbal").alias("area"),
        )

    @cached_property
    def records(self) -> DataFrame:
        return with_spine(self.raw, "date", CFG.base_year)

    @cached_property
    def sparse(self) -> DataFrame:
        """Records with gaps in their series."""
        return self.records.where("agency = 'F' and state = 'BUILDING'")

    @cached_property
    def kept(self) -> DataFrame:
        """Records after the exclusion of a state and an agency."""
        return self.records.where("NOT (state = 'MACHINERY' OR agency = 'P')")

    @cached_property
    def kept_grain(self) -> DataFrame:
        return cell_category(self.kept, CFG)

    @cached_property
    def grain(self) -> DataFrame:
        return cell_category(self.records, CFG)

    @cached_property
    def sparse_grain(self) -> DataFrame:
        return cell_category(self.sparse, CFG)

    @cached_property
    def tier1(self) -> DataFrame:
        return composition(self.grain, CFG, with_counts=True)

    @cached_property
    def human(self) -> DataFrame:
        return human_shares(self.grain, CFG)

    @cached_property
    def grid(self) -> DataFrame:
        """Cells with place and area: customers."""
        c, n = self.table("customer"), self.table("nation")
        return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("cell"), F.col("n_name").alias("place"), F.col("c_acctbal").alias("area"))

    @cached_property
    def starts(self) -> DataFrame:
        return dense_panel(self.records, self.grid, CFG, F.lit(1), "starts_")

    @cached_property
    def acres(self) -> DataFrame:
        return dense_panel(self.records, self.grid, CFG, F.col("size"), "size_")

    @cached_property
    def line_tasks(self) -> int:
        return tasks_for(self.table("lineitem").count(), LINES_OF_A_TASK)

    @cached_property
    def overlap(self) -> DataFrame:
        """(event, cell, overlap): lines of an order by supplier, dealt to
        line_tasks by event before they are summed, and not again."""
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("cell"), "l_quantity")
        return deal(lines, self.line_tasks, "event").groupBy("event", "cell").agg(F.sum("l_quantity").alias("overlap"))

    @cached_property
    def supplier_grid(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation")
        return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("cell"), F.col("n_name").alias("place"), F.col("s_acctbal").alias("area"))

    @cached_property
    def monthly(self) -> DataFrame:
        """(place, cell, month, v1, v2, v3): covariates of a grid by month."""
        li, g = self.table("lineitem"), self.supplier_grid.select("cell", "place")
        return li.join(g, li.l_suppkey == g.cell).select("place", "cell", F.trunc(F.to_date("l_shipdate"), "month").alias("month"), F.col("l_discount").alias("v1"), F.col("l_tax").alias("v2"), F.col("l_quantity").alias("v3"))

    @cached_property
    def pixels(self) -> DataFrame:
        """(cell, day, kind, value): raster pixels."""
        return self.table("events").select(F.col("user_id").alias("cell"), F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), "value")


CLASS = "CASE WHEN category = '4-NOT SPECIFIED' THEN 'Unknown' WHEN category = '1-URGENT' THEN 'Natural' ELSE 'Human' END"
_GRAIN = """
    SELECT k.*, v.category, coalesce(s.size, 0.0) AS size, coalesce(s.n, 0)::BIGINT AS n,
      sum(coalesce(s.size, 0.0)) OVER c AS cell_size, coalesce(m.size, 0.0) AS missing_size, coalesce(m.n, 0)::BIGINT AS missing_n,
      coalesce(s.size, 0.0) / nullif(sum(coalesce(s.size, 0.0)) OVER c, 0) AS share,
      coalesce(m.size, 0.0) / nullif(coalesce(m.size, 0.0) + sum(coalesce(s.size, 0.0)) OVER c, 0) AS missing_frac
    FROM (SELECT DISTINCT place, season, season_idx, season_year FROM {r} WHERE category <> '4-NOT SPECIFIED') k
    CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW']) AS category) v
    LEFT JOIN (SELECT place, season_idx, category, sum(size) AS size, count(*) AS n FROM {r} GROUP BY ALL) s
      ON s.place = k.place AND s.season_idx = k.season_idx AND s.category = v.category
    LEFT JOIN (SELECT place, season_idx, sum(size) AS size, count(*) AS n FROM {r} WHERE category = '4-NOT SPECIFIED' GROUP BY ALL) m
      ON m.place = k.place AND m.season_idx = k.season_idx
    WINDOW c AS (PARTITION BY k.place, k.season_idx)"""
_DENSE = """
    SELECT g.*, i.season_idx, {cols}
    FROM grid g CROSS JOIN (SELECT unnest(range(0, 27))::INT AS season_idx) i
    LEFT JOIN (SELECT cell, season_idx, {sums} FROM records GROUP BY ALL) s ON s.cell = g.cell AND s.season_idx = i.season_idx"""


def _dense(prefix: str, value: str) -> str:
    kinds = ("Natural", "Human", "Unknown")
    sums = ", ".join(f"sum(CASE WHEN {CLASS} = '{k}' THEN {value} ELSE 0 END) AS {k}" for k in kinds)
    cols = [f"coalesce(s.{k}, 0){'::BIGINT' if value == '1' else ''}" for k in kinds]
    named = ", ".join(f"{c} AS {prefix}{k.lower()}" for c, k in zip(cols, kinds, strict=True))
    return _DENSE.format(cols=f"{named}, {' + '.join(cols)} AS {prefix}total", sums=sums)


_TIER1 = """
    SELECT place, season, season_idx, season_year, human / total AS human, natural_ / total AS "natural", miss / total AS unknown, total, log10(total) AS log_total,
      n, log10(total / n) AS log_mean_size
    FROM (SELECT place, season, season_idx, season_year, sum(CASE WHEN """ + CLASS + """ = 'Human' THEN size ELSE 0 END) AS human,
        sum(CASE WHEN """ + CLASS + """ = 'Natural' THEN size ELSE 0 END) AS natural_, max(missing_size) AS miss, sum(size) + max(missing_size) AS total,
        (sum(n) + max(missing_n))::BIGINT AS n
      FROM {grain} WHERE season_idx NOT IN (0, 26) GROUP BY ALL) WHERE total > 0"""


#: In order of dependence.
VIEWS = {
    "raw": """
    SELECT o_orderkey AS id, o_orderdate::DATE AS date, o_totalprice AS size, o_orderpriority AS category, n_name AS place, r_name AS parent,
      c_mktsegment AS state, o_orderstatus AS agency, c_custkey AS cell, c_acctbal AS area
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "records": """
    SELECT *, (['DJF', 'MAM', 'JJA', 'SON'])[(month(date) % 12) // 3 + 1] AS season, (year(date) + (month(date) = 12)::INT)::INT AS season_year,
      ((year(date) + (month(date) = 12)::INT - 1995) * 4 + (month(date) % 12) // 3)::INT AS season_idx FROM raw""",
    "sparse": "SELECT * FROM records WHERE agency = 'F' AND state = 'BUILDING'",
    "kept": "SELECT * FROM records WHERE NOT (state = 'MACHINERY' OR agency = 'P')",
    "grain": _GRAIN.format(r="records"),
    "kept_grain": _GRAIN.format(r="kept"),
    "sparse_grain": _GRAIN.format(r="sparse"),
    "tier1": _TIER1.format(grain="grain"),
    "kept_tier1": _TIER1.format(grain="kept_grain"),
    "human": """
    SELECT place, season, season_idx, season_year, a / s AS h0, b / s AS h1, c / s AS h2, s AS human_size
    FROM (SELECT place, season, season_idx, season_year, sum(size) FILTER (category = '2-HIGH') AS a, sum(size) FILTER (category = '3-MEDIUM') AS b,
        sum(size) FILTER (category = '5-LOW') AS c, sum(size) FILTER (category IN ('2-HIGH', '3-MEDIUM', '5-LOW')) AS s
      FROM grain WHERE season_idx NOT IN (0, 26) GROUP BY ALL) WHERE s > 0""",
    "grid": "SELECT c_custkey AS cell, n_name AS place, c_acctbal AS area FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "starts": _dense("starts_", "1"),
    "acres": _dense("size_", "size"),
    "overlap": "SELECT l_orderkey AS event, l_suppkey AS cell, sum(l_quantity) AS overlap FROM lineitem GROUP BY ALL",
    "supplier_grid": "SELECT s_suppkey AS cell, n_name AS place, s_acctbal AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "monthly": """
    SELECT g.place, g.cell, date_trunc('month', l_shipdate)::DATE AS month, l_discount AS v1, l_tax AS v2, l_quantity AS v3
    FROM lineitem JOIN supplier_grid g ON l_suppkey = g.cell""",
    "pixels": "SELECT user_id AS cell, ts::DATE AS day, event_type AS kind, value FROM events",
}


def with_views(sql: str) -> str:
    """sql after the common table expressions that it needs."""
    need, text = [], sql
    for name in reversed(VIEWS):
        if re.search(rf"\b{name}\b", text):
            need.append(name)
            text += VIEWS[name]
    if not need:
        return sql
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in reversed(need))
    return f"WITH {views} {sql}"
