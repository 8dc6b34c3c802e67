"""Queries: unions of polygons, with and without levels, convex hulls, distances to a zone, learned holding patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clip, holding, hulls, overlay
from .base import brg, dist, points, query, table


def _boxes(spark, d) -> DataFrame:
    """A box per event, in steps of an eighth of a degree, with levels; user_id names the airspace."""
    e = F.col("event_id")
    b = table(spark, d, "events").select("user_id", (e * 37 % 23).alias("w"), (e * 91 % 19).alias("s"), (1 + e % 5).alias("a"), (1 + e * 7 % 4).alias("b"), (e % 3 * 100).alias("lower"), (e % 3 * 100 + 100 + e % 2 * 100).alias("upper"))
    at = lambda x, y: F.struct((x / 8.0).alias("x"), (y / 8.0).alias("y"))
    w, s, east, n = F.col("w"), F.col("s"), F.col("w") + F.col("a"), F.col("s") + F.col("b")
    return b.select("user_id", "lower", "upper", F.array(at(w, s), at(east, s), at(east, n), at(w, n)).alias("ring"))


def _around(ring: Column) -> Column:
    n = F.size(ring)
    side = lambda p, i: F.abs(p["x"] - F.get(ring, F.pmod(i + 1, n))["x"]) + F.abs(p["y"] - F.get(ring, F.pmod(i + 1, n))["y"])
    return F.aggregate(F.transform(ring, side), F.lit(0.0), lambda t, v: t + v)


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    """Area, perimeter and parts less holes of each union."""
    length = _around(F.col("ring")) + F.aggregate(F.transform("holes", _around), F.lit(0.0), lambda t, v: t + v)
    each = parts.select(*by, "area", length.alias("length"), (1 - F.size("holes")).alias("euler"), "loose")
    return each.groupBy(*by).agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("length"), 6).alias("perimeter"), F.sum("euler").alias("parts_less_holes"), F.max("loose").alias("loose"))


# The boxes as cells of an eighth of a degree: sides between a cell that is covered and one that isn't, and Euler's count of cells, pairs and fours.
_CELLS = """b AS (SELECT user_id, event_id*37%23 w, event_id*91%19 s, 1+event_id%5 a, 1+event_id*7%4 b, event_id%3*100 lower, event_id%3*100+100+event_id%2*100 upper FROM events)"""
_COUNTS = """SELECT {by}, round(count(*)/64.0,6) area, round((4*count(*)-2*sum(r)-2*sum(u))/8.0,6) perimeter, CAST(count(*)-sum(r)-sum(u)+sum(q) AS BIGINT) parts_less_holes, 0 loose
FROM (SELECT {c}, CASE WHEN e.x IS NULL THEN 0 ELSE 1 END r, CASE WHEN n.x IS NULL THEN 0 ELSE 1 END u, CASE WHEN e.x IS NULL OR n.x IS NULL OR f.x IS NULL THEN 0 ELSE 1 END q
FROM c LEFT JOIN c e ON {e} AND e.x=c.x+1 AND e.y=c.y LEFT JOIN c n ON {n} AND n.x=c.x AND n.y=c.y+1 LEFT JOIN c f ON {f} AND f.x=c.x+1 AND f.y=c.y+1) GROUP BY ALL"""


def _sql(*by: str) -> str:
    same = {t: " AND ".join(f"{t}.{k}=c.{k}" for k in by) for t in "enf"}
    return _COUNTS.format(by=", ".join(by), c=", ".join(f"c.{k}" for k in by), **same)


@query(f"WITH {_CELLS}, c AS (SELECT DISTINCT user_id, unnest(range(w, w+a)) x, y FROM (SELECT *, unnest(range(s, s+b)) y FROM b)) {_sql('user_id')}")
def airspace_union(spark, d):
    return _summed(overlay.union(_boxes(spark, d).drop("lower", "upper"), ["user_id"]), "user_id")


@query(
    f"WITH {_CELLS}, cut AS (SELECT DISTINCT user_id, unnest([lower, upper]) lo FROM b), sl AS (SELECT user_id, lo, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) hi FROM cut), "
    "ly AS (SELECT DISTINCT sl.user_id, lo, hi, w, s, a, b FROM sl JOIN b ON b.user_id=sl.user_id AND lower<=lo AND upper>=hi), "
    "c AS (SELECT DISTINCT user_id, lo, unnest(range(w, w+a)) x, y FROM (SELECT *, unnest(range(s, s+b)) y FROM ly)), "
    f"k AS ({_sql('user_id', 'lo')}) SELECT user_id, CAST(sum(area*(hi-lo)) AS DOUBLE) volume FROM (SELECT user_id, lo, hi, area FROM k JOIN sl USING (user_id, lo)) GROUP BY user_id"
)
def airspace_union_levels(spark, d):
    # The slabs of equal layers are one, so what is compared is the sum over all slabs.
    parts = overlay.union_levels(_boxes(spark, d), ["user_id"])
    return parts.groupBy("user_id").agg(F.round(F.sum(F.col("area") * (F.col("upper") - F.col("lower"))), 6).alias("volume"))


@query(
    "WITH pt AS (SELECT DISTINCT user_id, CAST(event_id*37%1009 AS DOUBLE) x, CAST(event_id*event_id%997 AS DOUBLE) y FROM events), "
    "sd AS (SELECT a.user_id, (b.x-a.x)/sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) u, (b.y-a.y)/sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) v, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) d "
    "FROM pt a JOIN pt b ON a.user_id=b.user_id AND (a.x<b.x OR (a.x=b.x AND a.y<b.y))), "
    "ar AS (SELECT user_id, u, v, (max(x*u+y*v)-min(x*u+y*v))*(max(y*u-x*v)-min(y*u-x*v)) area FROM (SELECT DISTINCT user_id, u, v FROM sd) s JOIN pt USING (user_id) GROUP BY user_id, u, v), "
    "dm AS (SELECT user_id, max(d) diameter FROM sd GROUP BY user_id), nn AS (SELECT user_id, count(*) n FROM events GROUP BY user_id) "
    "SELECT user_id, n, round(coalesce(min(area), 0), 4) rectangle, round(coalesce(any_value(diameter), 0), 6) diameter FROM nn LEFT JOIN ar USING (user_id) LEFT JOIN dm USING (user_id) GROUP BY user_id, n"
)
def flight_hulls(spark, d):
    # In SQL every line through two places is tried as a side of the rectangle.
    e = F.col("event_id")
    p = table(spark, d, "events").select("user_id", (e * 37 % 1009).alias("x"), (e * e % 997).alias("y"))
    return hulls.hulls(p, ["user_id"]).select("user_id", "n", F.round(F.col("length") * F.col("width"), 4).alias("rectangle"), F.round("diameter", 6).alias("diameter"))


def _flat(lat: str, lon: str, which: str) -> str:
    """A place in the plane about the zone's middle, in SQL."""
    return f"({dist('43.8', '2.4', lat, lon)}*1852.0*{which}(radians({brg('43.8', '2.4', lat, lon)})))"


@query(
    f"SELECT event_id, round(min(d)*CASE WHEN sum(c)%2=1 THEN -1 ELSE 1 END, 3) distance FROM (SELECT event_id, CASE WHEN (y1>py)<>(y2>py) AND px<(x2-x1)*(py-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END c, "
    "sqrt((px-x1-t*(x2-x1))*(px-x1-t*(x2-x1))+(py-y1-t*(y2-y1))*(py-y1-t*(y2-y1))) d FROM (SELECT *, greatest(0.0, least(1.0, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) t "
    f"FROM (SELECT event_id, {_flat('latitude', 'longitude', 'sin')} px, {_flat('latitude', 'longitude', 'cos')} py FROM p) a, "
    "(SELECT x x1, y y1, coalesce(lead(x) OVER (ORDER BY i), first(x) OVER (ORDER BY i)) x2, coalesce(lead(y) OVER (ORDER BY i), first(y) OVER (ORDER BY i)) y2 FROM "
    f"(SELECT i, {_flat('la', 'lo', 'sin')} x, {_flat('la', 'lo', 'cos')} y FROM (SELECT unnest([0,1,2,3]) i, unnest([43.3, 43.3, 44.3, 44.3]) la, unnest([1.6, 3.2, 3.2, 1.6]) lo FROM nation WHERE n_name='NATION_7'))) s)) GROUP BY event_id"
)
def zone_distance(spark, d):
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    zones = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.array(at(1.6, 43.3), at(3.2, 43.3), at(3.2, 44.3), at(1.6, 44.3)).alias("ring"))
    return clip.distance_to_zone(points(spark, d), zones, "NATION_7").select("event_id", F.round("distance", 3).alias("distance"))


@query("SELECT c_custkey flight_id FROM customer WHERE c_custkey%2=1 AND c_custkey%3=0")
def holding_learned(spark, d):
    # A flight is made for each customer; the even ones teach which windows hold, the odd ones are judged.
    seeds = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("flight_id"), (F.col("c_custkey") % 3 == 0).alias("holds"))
    model = holding.trained(spark, seeds.filter("flight_id % 2 = 0"))
    made = holding.generated(seeds.filter("flight_id % 2 = 1")).drop("holds")
    return holding.learned(made, ["flight_id"], model).select("flight_id").distinct()
