"""Cells on the sphere: bands of latitude cut into rings of cells, closed at the date line and at the poles.

A band's number of cells depends on the band alone, so a row has one cell and
whatever lies within a distance of a point is found in a short list of cells,
by equal keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import col

#: Widens searches by more than rounding can move a point.
SLACK = 1e-9


def band(lat, deg: float) -> Column:
    """Number of the band of ``deg`` degrees, from the south pole."""
    return F.floor((col(lat) + 90.0) / deg)


def ring_size(k: Column, deg: float) -> Column:
    """Cells in band ``k``: each at least ``deg`` wide at the band's edge towards the pole; 1 at the poles."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(k * deg - 90.0), F.abs((k + 1) * deg - 90.0)))
    return F.greatest(F.lit(1).cast("long"), F.floor(F.cos(F.radians(edge)) * (360.0 / deg)))


def cell(lat, lon, deg: float) -> Column:
    """The cell (struct k, c) of a position; null if a coordinate is."""
    k = band(lat, deg)
    n = ring_size(k, deg)
    known = col(lat).isNotNull() & col(lon).isNotNull()
    return F.when(known, F.struct(k.alias("k"), F.pmod(F.floor(col(lon) / 360.0 * n), n).alias("c")))


def cells_around(lat, lon, deg: float, nm: float, bands: tuple[int, ...] = (-1, 0, 1)) -> Column:
    """All cells with a point within ``nm`` of a position, of its own band and those ``bands`` away; nm is at most 60 * deg."""
    d = nm / 60.0 + SLACK
    if d > deg + 2 * SLACK:
        raise ValueError("cells are smaller than the distance")
    y, x = col(lat), col(lon)
    half = F.when(F.abs(y) + d >= 90.0, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(d)) / F.cos(F.radians(y))))) + SLACK)

    def of_band(step: int) -> Column:
        k = band(y, deg) + step
        n = ring_size(k, deg)
        lo, hi = F.floor((x - half) / 360.0 * n), F.floor((x + half) / 360.0 * n)
        every = F.sequence(F.lit(0).cast("long"), n - 1)
        some = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda c: F.pmod(c, n))
        return F.transform(F.when(hi - lo + 1 >= n, every).otherwise(some), lambda c: F.struct(k.alias("k"), c.alias("c")))

    return F.when(y.isNotNull() & x.isNotNull(), F.concat(*[of_band(b) for b in bands]))


def touched(df: DataFrame, lat: str, lon: str, deg: float, nm: float) -> DataFrame:
    """Rows once for each cell (_k, _c) with a point within ``nm`` of them; _home marks the row's own cell.

    As cells_around(), but the distance may be any, and as numbers in place of
    arrays of structs: with cells far larger than the distance most rows have one.
    """
    d = nm / 60.0 + SLACK
    y, x = col(lat), col(lon)
    half = F.when(F.abs(y) + d >= 90.0, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(d)) / F.cos(F.radians(y))))) + SLACK)
    out = df.withColumn("_k", F.explode(F.sequence(band(y - d, deg), band(y + d, deg)))).withColumn("_n", ring_size(F.col("_k"), deg))
    out = out.withColumns({"_lo": F.floor((x - half) / 360.0 * F.col("_n")), "_hi": F.floor((x + half) / 360.0 * F.col("_n"))})
    every = F.col("_hi") - F.col("_lo") + 1 >= F.col("_n")
    out = out.withColumn("_c", F.explode(F.sequence(F.when(every, F.lit(0).cast("long")).otherwise(F.col("_lo")), F.when(every, F.col("_n") - 1).otherwise(F.col("_hi")))))
    out = out.withColumn("_c", F.pmod(F.col("_c"), F.col("_n")))
    own = cell(y, x, deg)
    return out.withColumn("_home", (F.col("_k") == own["k"]) & (F.col("_c") == own["c"])).drop("_n", "_lo", "_hi")


def box_cells(west, south, east, north, deg: float) -> Column:
    """Plane cells (struct k, c) of ``deg`` degrees that a box covers, edges included."""
    at = lambda v: F.floor(col(v) / deg)
    return F.flatten(F.transform(F.sequence(at(south), at(north)), lambda k: F.transform(F.sequence(at(west), at(east)), lambda c: F.struct(k.alias("k"), c.alias("c")))))


def plane_cell(lat, lon, deg: float) -> Column:
    """The plane cell of a position, as box_cells() numbers them."""
    known = col(lat).isNotNull() & col(lon).isNotNull()
    return F.when(known, F.struct(F.floor(col(lat) / deg).alias("k"), F.floor(col(lon) / deg).alias("c")))
