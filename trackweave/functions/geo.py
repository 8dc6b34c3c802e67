"""Spherical geodesy and map projections as Column expressions.

Angles are in degrees, distances in nautical miles unless a name says metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

R_M = 6371000.0
R_NM = R_M / 1852.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def distance(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance (haversine) in nautical miles; null or NaN if a coordinate is."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    # Rounding can lift h above 1 for opposite points; nanvl evaluates h once and keeps nulls.
    return 2 * R_NM * F.nanvl(F.asin(F.sqrt(h)), math.pi / 2 + 0 * (a + b + c + d))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(d - b) * F.cos(c)
    x = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat, lon, course, dist) -> tuple[Column, Column]:
    """(latitude, longitude) reached from a point on an initial course."""
    a, b, t, s = F.radians(col(lat)), F.radians(col(lon)), F.radians(col(course)), col(dist) / R_NM
    out = F.asin(F.sin(a) * F.cos(s) + F.cos(a) * F.sin(s) * F.cos(t))
    to = b + F.atan2(F.sin(t) * F.sin(s) * F.cos(a), F.cos(s) - F.sin(a) * F.sin(out))
    return F.degrees(out), F.pmod(F.degrees(to) + 540.0, F.lit(360.0)) - 180.0


def angle_between(a, b) -> Column:
    """Smaller of the two angles between directions, 0 to 180."""
    d = F.pmod(col(a) - col(b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def wind(gs, track, tas, heading) -> tuple[Column, Column]:
    """(u, v) of the wind: ground vector less air vector."""
    t, h = F.radians(col(track)), F.radians(col(heading))
    return col(gs) * F.sin(t) - col(tas) * F.sin(h), col(gs) * F.cos(t) - col(tas) * F.cos(h)


def air_vector(gs, track, u, v) -> tuple[Column, Column]:
    """(TAS, heading) from ground vector and wind."""
    t = F.radians(col(track))
    x, y = col(gs) * F.sin(t) - col(u), col(gs) * F.cos(t) - col(v)
    return F.hypot(x, y), F.pmod(90.0 - F.degrees(F.atan2(y, x)), F.lit(360.0))


def lcc(lat, lon, lat0: float, lon0: float, lat1: float, lat2: float) -> tuple[Column, Column]:
    """Lambert conformal conic (x, y) in metres on the sphere."""
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    tan = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if abs(p1 - p2) < 1e-10 else math.log(math.cos(p1) / math.cos(p2)) / math.log(tan(p2) / tan(p1))
    f = math.cos(p1) * tan(p1) ** n / n
    rho = R_M * f / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2), n)
    rho0 = R_M * f / tan(p0) ** n
    theta = n * F.radians(F.pmod(col(lon) - lon0 + 180.0, F.lit(360.0)) - 180.0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def lcc_inverse(x, y, lat0: float, lon0: float, lat1: float, lat2: float) -> tuple[Column, Column]:
    """(latitude, longitude) of lcc's (x, y)."""
    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    tan = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(p1) if abs(p1 - p2) < 1e-10 else math.log(math.cos(p1) / math.cos(p2)) / math.log(tan(p2) / tan(p1))
    f = math.cos(p1) * tan(p1) ** n / n
    rho0 = R_M * f / tan(p0) ** n
    dy = rho0 - col(y)
    rho = math.copysign(1.0, n) * F.hypot(col(x), dy)
    theta = F.atan2(col(x) * math.copysign(1.0, n), dy * math.copysign(1.0, n))
    lat = 2 * F.atan(F.pow(R_M * f / rho, 1 / n)) - math.pi / 2
    return F.degrees(lat), F.degrees(theta) / n + lon0


def azimuthal(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Azimuthal equidistant (x, y) in metres about a centre."""
    d, b = distance(lat0, lon0, lat, lon) * 1852.0, F.radians(bearing(lat0, lon0, lat, lon))
    return d * F.sin(b), d * F.cos(b)


def in_ring(x, y, ring) -> Column:
    """Whether a point is inside a ring (array of struct x, y; closed or not) by ray casting."""
    px, py, r = col(x), col(y), col(ring)
    n = F.size(r)

    def crosses(p, i):
        q = F.get(r, F.pmod(i + 1, n))
        spans = (p["y"] > py) != (q["y"] > py)
        return F.when(spans, px < (q["x"] - p["x"]) * (py - p["y"]) / (q["y"] - p["y"]) + p["x"]).otherwise(False)

    odd = F.size(F.filter(F.transform(r, crosses), lambda v: v)) % 2 == 1
    return odd


def ring_distance(x, y, ring) -> Column:
    """Plane distance of a point to a ring's boundary."""
    px, py, r = col(x), col(y), col(ring)
    n = F.size(r)

    def to_side(p, i):
        q = F.get(r, F.pmod(i + 1, n))
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - p["x"]) * dx + (py - p["y"]) * dy) / len2))).otherwise(F.lit(0.0))
        return F.hypot(px - p["x"] - t * dx, py - p["y"] - t * dy)

    return F.array_min(F.transform(r, to_side))


def ring_area(ring) -> Column:
    """Signed area of a ring by the shoelace rule."""
    r = col(ring)
    n = F.size(r)
    parts = F.transform(r, lambda p, i: p["x"] * F.get(r, F.pmod(i + 1, n))["y"] - F.get(r, F.pmod(i + 1, n))["x"] * p["y"])
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / 2
