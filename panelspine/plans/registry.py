"""The list of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Keeps values that lie on half a digit from being rounded by their noise.
NUDGE = 1.3e-8


def query(name: str, run: Callable, sql: str | None = None, floats: str = "") -> None:
    """Register run(tables). Columns named in floats are rounded to six digits
    on both sides, as sums of doubles depend on their order in the last ones;
    dates are returned as text."""
    names = floats.split()

    def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .bindings import Tables

        out = run(Tables(spark, sf_dir))
        out = out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "date"})
        return out.withColumns({c: F.round(F.col(c).cast("double") + NUDGE, 6) + F.lit(0.0) for c in names}) if names else out

    QUERIES[name] = whole
    if sql is not None:
        from .bindings import with_views

        swap = ", ".join(f'round("{c}"::DOUBLE + {NUDGE:.10f}, 6) + 0.0 AS "{c}"' for c in names)
        SQL[name] = with_views(f"SELECT * REPLACE ({swap}) FROM ({sql}) AS q" if names else sql)
