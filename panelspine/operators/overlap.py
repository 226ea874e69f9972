"""Exact areas of polygons by grid cell, from edges alone.

By Green's theorem the area of a polygon below its edges, summed with the
direction of each edge, is its own area; cut off at a cell's lower and upper
side it is the area in that cell. So edges are cut where they cross lines of
the grid; a piece gives its own cell the area under it, and every cell below in
its column a full strip of its width. Strips are running sums down a column. No
polygon is put together, no cell is met with an edge that does not touch it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _crossings(a: Column, b: Column, side: float) -> Column:
    """Where on the way from a to b (0 to 1) multiples of side are crossed."""
    lo, hi = F.floor(F.least(a, b) / side) + 1, F.ceil(F.greatest(a, b) / side) - 1
    lines = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(lines, lambda k: (k * F.lit(side) - a) / (b - a))


def cut_edges(edges: DataFrame, side: float) -> DataFrame:
    """edges (x1, y1, x2, y2 and others) as pieces that cross no line of the
    square grid, with the cell (col, row) of each."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0)), _crossings(x1, x2, side), _crossings(y1, y2, side), F.array(F.lit(1.0))))
    pieces = F.transform(F.sequence(F.lit(0), F.size("__t") - 2), lambda k: F.struct(F.get("__t", k).alias("a"), F.get("__t", k + 1).alias("b")))
    out = edges.withColumn("__t", cuts).withColumn("__p", F.explode(pieces)).where("__p.a < __p.b")
    at = lambda p, q, t: F.when(t == 0, p).when(t == 1, q).otherwise(p + t * (q - p))
    a, b = F.col("__p.a"), F.col("__p.b")
    out = out.withColumns({"__x1": at(x1, x2, a), "__y1": at(y1, y2, a), "__x2": at(x1, x2, b), "__y2": at(y1, y2, b)})
    out = out.drop("__t", "__p", "x1", "y1", "x2", "y2").withColumnsRenamed({f"__{c}": c for c in ("x1", "y1", "x2", "y2")})
    return out.withColumns({"col": F.floor((F.col("x1") + F.col("x2")) / 2 / side), "row": F.floor((F.col("y1") + F.col("y2")) / 2 / side)})


def cell_overlaps(edges: DataFrame, side: float, least: float = 1e-9) -> DataFrame:
    """(poly, col, row, area): the area of each polygon in each cell of a square
    grid, of cells where it is more than least of the cell.

    Rings may run either way round, but holes against their outer ring; a
    polygon is a row set of poly, so parts and holes need no order. A column of
    a polygon is summed in one task: as many rows as cells there have edges.
    """
    cut = cut_edges(edges.select("poly", "x1", "y1", "x2", "y2"), side).where("x1 != x2")
    width = F.col("x1") - F.col("x2")
    own = F.sum(width * ((F.col("y1") + F.col("y2")) / 2 - F.col("row") * side)).alias("own")
    cells = cut.groupBy("poly", "col", "row").agg(own, F.sum(width).alias("width"))
    down = Window.partitionBy("poly", "col").orderBy(F.desc("row"))
    above = F.coalesce(F.sum("width").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cells = cells.withColumns({"above": above, "next": F.coalesce(F.lead("row").over(down), F.col("row"))})
    # cells between this one and the next one down have upright edges at most: the strip goes through them
    strip = F.col("above") + F.col("width")
    gap = F.when((F.col("next") < F.col("row") - 1) & (F.abs(strip) > side * least), F.sequence(F.col("row") - 1, F.col("next") + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    edge_cell = F.struct("row", (F.col("own") + F.col("above") * side).alias("area"))
    full = F.transform(gap, lambda k: F.struct(k.alias("row"), (strip * side).alias("area")))
    found = cells.select("poly", "col", F.explode(F.concat(F.array(edge_cell), full)).alias("c")).select("poly", "col", "c.row", "c.area")
    return found.withColumn("area", F.abs("area")).where(F.col("area") > least * side * side)


def areas(edges: DataFrame) -> DataFrame:
    """(poly, area): the whole area of each polygon."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return edges.groupBy("poly").agg((F.abs(twice) / 2).alias("area"))
