"""A hexagonal grid as column arithmetic.

Points are projected by the equal-area sinusoidal projection and binned to
axial coordinates with cube rounding. An id packs both coordinates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
OFFSET, SPAN = 1 << 20, 1 << 21


def cell_id(q: Column, r: Column) -> Column:
    return ((q + OFFSET) * SPAN + (r + OFFSET)).cast("long")


def cell_of(lat: Column, lon: Column, side_km: float) -> Column:
    """The id of the cell that holds a point; NULL for an unknown place."""
    x = EARTH_KM * F.radians(lon) * F.cos(F.radians(lat))
    y = EARTH_KM * F.radians(lat)
    # Steps over an array of one bind what the next step uses more than once.
    v = F.array(F.struct(((math.sqrt(3) / 3 * x - y / 3) / side_km).alias("q"), ((2 / 3 * y) / side_km).alias("r")))
    v = F.transform(v, lambda p: F.struct(p["q"].alias("q"), p["r"].alias("r"), F.round(p["q"]).alias("rq"), F.round(p["r"]).alias("rr"), F.round(-p["q"] - p["r"]).alias("rs")))
    v = F.transform(v, lambda p: F.struct(p["rq"].alias("rq"), p["rr"].alias("rr"), p["rs"].alias("rs"), F.abs(p["rq"] - p["q"]).alias("dq"), F.abs(p["rr"] - p["r"]).alias("dr"), F.abs(p["rs"] + p["q"] + p["r"]).alias("ds")))

    def rounded(p: Column) -> Column:
        q_off = (p["dq"] > p["dr"]) & (p["dq"] > p["ds"])
        q = F.when(q_off, -p["rr"] - p["rs"]).otherwise(p["rq"])
        r = F.when(~q_off & (p["dr"] > p["ds"]), -p["rq"] - p["rs"]).otherwise(p["rr"])
        return cell_id(q.cast("long"), r.cast("long"))

    return F.when(lat.isNotNull() & lon.isNotNull(), F.transform(v, rounded)[0])


def centre(cell: Column, side_km: float) -> tuple[Column, Column]:
    """(lat, lon) of a cell's centre."""
    q, r = F.floor(cell / SPAN) - OFFSET, cell % SPAN - OFFSET
    x, y = side_km * math.sqrt(3) * (q + r / 2), side_km * 1.5 * r
    lat = F.degrees(y / EARTH_KM)
    return lat, F.degrees(x / (EARTH_KM * F.cos(F.radians(lat))))


def boundary(cell: Column, side_km: float) -> Column:
    """The six corners as an array of (x, y) in projected km."""
    q, r = F.floor(cell / SPAN) - OFFSET, cell % SPAN - OFFSET
    x, y = side_km * math.sqrt(3) * (q + r / 2), side_km * 1.5 * r
    return F.array(*[F.struct((x + side_km * math.cos(math.radians(60 * k - 30))).alias("x"), (y + side_km * math.sin(math.radians(60 * k - 30))).alias("y")) for k in range(6)])


def cell_area_km2(side_km: float) -> float:
    return 1.5 * math.sqrt(3) * side_km**2
