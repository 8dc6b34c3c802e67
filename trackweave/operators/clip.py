"""Flights against polygons along their lines: crossing times, parts inside, intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells, geo
from ..functions.timeunits import from_us, us
from .joins import small
from .keys import TIME, ordered

#: Degrees of the cells in which lines and polygons meet.
CELL = 0.5


def lines(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per leg between consecutive known positions: x0, y0, z0, t0 to x1, y1, z1, t1 (z: altitude, t: microseconds)."""
    known = df.filter("latitude is not null and longitude is not null")
    w = ordered(known, by)
    z = F.col("altitude").cast("double") if "altitude" in df.columns else F.lit(None).cast("double")
    ends = {"x0": F.col("longitude"), "y0": F.col("latitude"), "z0": z, "t0": us(TIME)}
    rows = known.select(*by, TIME, *[c for c in ("event_id",) if c in df.columns], *[c.alias(n) for n, c in ends.items()])
    ahead = [F.lead(f"{c}0").over(w).alias(f"{c}1") for c in "xyzt"]
    return rows.select(*by, *ends, *ahead, F.row_number().over(w).alias("leg")).filter("t1 is not null")


def _inside_parts(ring: str) -> Column:
    """Parts (a, b) of a leg, as shares of it from 0 to 1, that run inside a ring."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.size(ring)

    def crossing(p, i):
        q = F.get(F.col(ring), F.pmod(i + 1, n))
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        det = dx * ey - dy * ex
        t = ((p["x"] - F.col("x0")) * ey - (p["y"] - F.col("y0")) * ex) / det
        u = ((p["x"] - F.col("x0")) * dy - (p["y"] - F.col("y0")) * dx) / det
        return F.when((det != 0) & (t > 0) & (t < 1) & (u >= 0) & (u < 1), t)

    found = F.array_compact(F.transform(ring, crossing))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), found, F.array(F.lit(1.0)))))
    middle = lambda p: (p["a"] + p["b"]) / 2

    def between(c: Column) -> Column:
        parts = F.transform(F.slice(c, 1, F.size(c) - 1), lambda a, i: F.struct(a.alias("a"), F.get(c, i + 1).alias("b")))
        return F.filter(parts, lambda p: geo.in_ring(F.col("x0") + dx * middle(p), F.col("y0") + dy * middle(p), ring))

    return F.flatten(F.transform(F.array(cuts), between))  # the cuts are computed once


def parts_inside(df: DataFrame, zones: DataFrame, by: list[str]) -> DataFrame:
    """(key, zone, start_us, stop_us, za, zb, lower, upper) of each part of a leg inside a polygon.

    zones: name, ring (array of struct x, y) and, if there are layers, lower and
    upper in flight levels.  A leg and a polygon meet by equal cells of their
    boxes and are compared once, in the first cell that both have.
    """
    side = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    level = lambda c: F.col(c).cast("double") if c in zones.columns else F.lit(None).cast("double")
    z = zones.select(F.col("name").alias("zone"), "ring", level("lower").alias("lower"), level("upper").alias("upper"), side(F.array_min, "x").alias("_w"), side(F.array_min, "y").alias("_s"), side(F.array_max, "x").alias("_e"), side(F.array_max, "y").alias("_n"))
    z = z.select("*", F.explode(cells.box_cells("_w", "_s", "_e", "_n", CELL)).alias("_cell"))
    legs = lines(df, by)
    low, high = lambda c: F.least(f"{c}0", f"{c}1"), lambda c: F.greatest(f"{c}0", f"{c}1")
    legs = legs.withColumn("_cell", F.explode(cells.box_cells(low("x"), low("y"), high("x"), high("y"), CELL)))
    first = (F.col("_cell.k") == F.floor(F.greatest(low("y"), F.col("_s")) / CELL)) & (F.col("_cell.c") == F.floor(F.greatest(low("x"), F.col("_w")) / CELL))
    boxes = (high("x") >= F.col("_w")) & (low("x") <= F.col("_e")) & (high("y") >= F.col("_s")) & (low("y") <= F.col("_n"))
    met = legs.join(small(z), "_cell").filter(first & boxes).select("*", F.explode(_inside_parts("ring")).alias("_p"))
    at = lambda c, p: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col(f"_p.{p}")
    return met.select(*by, "zone", F.rint(at("t", "a")).cast("long").alias("start_us"), F.rint(at("t", "b")).cast("long").alias("stop_us"), at("z", "a").alias("za"), at("z", "b").alias("zb"), "lower", "upper")


def crossings(df: DataFrame, zones: DataFrame, by: list[str]) -> DataFrame:
    """(key, zone, seg_idx, start, stop): times at which each flight is inside each polygon, entry and exit interpolated."""
    parts = parts_inside(df, zones, by)
    key = [*by, "zone"]
    w = W.partitionBy(*key).orderBy("start_us", "stop_us")
    top = F.max("stop_us").over(w.rowsBetween(W.unboundedPreceding, -1))
    grouped = parts.withColumn("_new", F.when(top.isNull() | (F.col("start_us") > top), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = grouped.groupBy(*key, "_g").agg(F.min("start_us").alias("_a"), F.max("stop_us").alias("_z"))
    return out.select(*key, (F.col("_g") - 1).cast("long").alias("seg_idx"), from_us("_a").alias("start"), from_us("_z").alias("stop"))


def clip(df: DataFrame, zones: DataFrame, by: list[str], strict: bool = True) -> DataFrame:
    """Rows between a flight's entry into a polygon and its exit, with zone and index_; strict leaves the ends out."""
    s = crossings(df, zones, by).select(*[F.col(c).alias(f"_{c}") for c in by], "zone", F.col("seg_idx").alias("index_"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    t = F.col(TIME)
    inside = (t > F.col("_start")) & (t < F.col("_stop")) if strict else (t >= F.col("_start")) & (t <= F.col("_stop"))
    return df.join(s, [*[F.col(c) == F.col(f"_{c}") for c in by], inside]).drop(*[f"_{c}" for c in by], "_start", "_stop")


def intersects(df: DataFrame, zones: DataFrame, by: list[str]) -> DataFrame:
    """(key, zone) of flights whose line passes through a polygon between its lower and upper level, heights interpolated."""
    p = parts_inside(df, zones, by)
    above = F.col("lower").isNull() | F.col("za").isNull() | (F.greatest("za", "zb") > 100 * F.col("lower"))
    below = F.col("upper").isNull() | F.col("za").isNull() | (F.least("za", "zb") < 100 * F.col("upper"))
    return p.filter(above & below).select(*by, "zone").distinct()


def distance_to_zone(df: DataFrame, zones: DataFrame, zone: str, name: str = "distance") -> DataFrame:
    """Adds the metres from each row to the boundary of a zone (name, ring of struct x, y), negative inside.

    Measured in a plane about the middle of the zone's box; null where a
    coordinate is, or where there is no such zone.  The ring is projected once
    and goes to all tasks: a row of one zone.
    """
    side = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    one = zones.filter(F.col("name") == zone).limit(1).select("ring", ((side(F.array_min, "x") + side(F.array_max, "x")) / 2).alias("_lon0"), ((side(F.array_min, "y") + side(F.array_max, "y")) / 2).alias("_lat0"))

    def corner(p: Column) -> Column:
        x, y = geo.azimuthal(p["y"], p["x"], F.col("_lat0"), F.col("_lon0"))
        return F.struct(x.alias("x"), y.alias("y"))

    flat = one.select("_lat0", "_lon0", F.transform("ring", corner).alias("_ring"), F.lit(0).alias("_zone"))
    j = df.withColumn("_zone", F.lit(0)).join(F.broadcast(flat), "_zone", "left")
    x, y = geo.azimuthal("latitude", "longitude", F.col("_lat0"), F.col("_lon0"))
    j = j.withColumns({"_x": x, "_y": y})
    sign = F.when(geo.in_ring("_x", "_y", "_ring"), -1.0).otherwise(1.0)
    return j.withColumn(name, geo.ring_distance("_x", "_y", "_ring") * sign).drop("_zone", "_lat0", "_lon0", "_ring", "_x", "_y")
