"""Queries: reference tables, airspaces, shapes of flights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import references
from ..sources import exchange
from .base import beacons, brg, dist, flights, points, query, table

BY = ["flight_id"]
E = "event_id"


def k():
    return F.col("n_nationkey")


@query("SELECT event_id FROM p WHERE longitude BETWEEN 1.5 AND 2.5 AND latitude BETWEEN 43.5 AND 44.5")
def extent_filter(spark, d):
    return references.extent(points(spark, d), 2, 44, 2, 44).select(E)


@query("PLAIN SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation_1')")
def search_names(spark, d):
    return references.search(table(spark, d, "nation").select("n_nationkey", "n_name"), "Nation_1", "n_name", "n_nationkey")


@query("PLAIN SELECT s_suppkey, s_name FROM supplier WHERE upper(s_name) = 'SUPPLIER#000000003' OR CAST(s_suppkey AS VARCHAR) = 'SUPPLIER#000000003'")
def lookup_code(spark, d):
    return references.lookup(table(spark, d, "supplier").select("s_suppkey", "s_name"), "supplier#000000003", "s_name", "s_suppkey")


_LE, _HE = ("(43+n_nationkey*CAST(0.2 AS DOUBLE))", "(1+n_nationkey*CAST(0.15 AS DOUBLE))"), ("(43+n_nationkey*CAST(0.2 AS DOUBLE)+0.01)", "(1+n_nationkey*CAST(0.15 AS DOUBLE)+(n_nationkey%3)*CAST(0.02 AS DOUBLE))")


def _end(name: str, here, there) -> str:
    b = brg(*here, *there)
    return f"SELECT n_name airport, '{name}' AS name, round({here[0]},6) latitude, round({here[1]},6) longitude, round(CASE WHEN {b}=0 THEN 360.0 ELSE {b} END,6) bearing FROM nation"


@query(f"PLAIN {_end('LE', _LE, _HE)} UNION ALL {_end('HE', _HE, _LE)}")
def runway_thresholds(spark, d):
    lat, lon = 43 + k() * F.lit(0.2), 1 + k() * F.lit(0.15)
    r = table(spark, d, "nation").select(
        F.col("n_name").alias("airport_ident"), F.lit("LE").alias("le_ident"), F.lit("HE").alias("he_ident"), lat.alias("le_latitude_deg"), lon.alias("le_longitude_deg"),
        (lat + F.lit(0.01)).alias("he_latitude_deg"), (lon + k() % 3 * F.lit(0.02)).alias("he_longitude_deg"),
    )
    return references.thresholds(r).select("airport", "name", *[F.round(c, 6).alias(c) for c in ("latitude", "longitude", "bearing")])


@query("SELECT icao24, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, ts DESC, event_id) k FROM p) WHERE k=1")
def navaid_priority(spark, d):
    rank = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return references.best_named(points(spark, d), "icao24", rank, F.desc("timestamp"), E).select("icao24", "event_type", E)


_ND = dist("latitude", "longitude", "45.0", "3.0")


@query(f"SELECT icao24, event_id, round(dd,6) distance FROM (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY dd, event_id) k FROM (SELECT *, {_ND} dd FROM p)) WHERE k=1")
def navaid_nearest(spark, d):
    return references.nearest_named(points(spark, d), "icao24", 45, 3, E).select("icao24", E, F.round("distance", 6).alias("distance"))


@query("PLAIN SELECT o_custkey route, count(*) n, string_agg(CAST(o_orderkey AS VARCHAR)||':'||o_orderstatus, ' ' ORDER BY o_orderdate, o_orderkey) path FROM orders GROUP BY o_custkey")
def airway_routes(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("route"), F.struct("o_orderdate", "o_orderkey").alias("number"), "o_orderkey", "o_orderstatus")
    r = references.routes(o, "route", "number", "o_orderkey", "o_orderstatus")
    path = F.array_join(F.transform("points", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), " ")
    return r.select("route", F.size("points").cast("long").alias("n"), path.alias("path"))


_NM = "(SELECT n_regionkey route, list(n_name ORDER BY n_nationkey) nm FROM nation GROUP BY n_regionkey)"


@query(f"PLAIN SELECT route, array_to_string(list_slice(nm,2,len(nm)-1),' ') forward, array_to_string(list_reverse(list_slice(nm,2,len(nm)-1)),' ') backward FROM {_NM}")
def sub_route(spark, d):
    r = references.routes(table(spark, d, "nation").withColumnRenamed("n_regionkey", "route"), "route", "n_nationkey", "n_name")
    names = F.col("points.n_name")
    a, b = F.element_at(names, 2), F.element_at(names, -2)
    return r.select("route", F.array_join(references.sub_route(names, a, b), " ").alias("forward"), F.array_join(references.sub_route(names, b, a), " ").alias("backward"))


@query("SELECT event_id, n_name country FROM (SELECT event_id, (event_id*7919)%16777216 a FROM p) LEFT JOIN nation ON a BETWEEN n_nationkey*600000 AND n_nationkey*600000+400000")
def country_of_address(spark, d):
    r = table(spark, d, "nation").select((k() * 600000).alias("first"), (k() * 600000 + 400000).alias("last"), F.col("n_name").alias("country"))
    a = points(spark, d).select(E, (F.col(E) * 7919 % 16777216).alias("address"))
    return references.registered_in(a, r, "address").select(E, "country")


@query("PLAIN SELECT p_type typecode, max(p_brand) model, count(*) AS \"count\" FROM part WHERE contains(p_name, 'widget') GROUP BY p_type")
def operator_stats(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("icao24"), F.col("p_name").alias("operator"), F.col("p_type").alias("typecode"), F.col("p_brand").alias("model"))
    return references.operator_stats(a.unionByName(a), "widget")


_PIA = "(10802833 + (event_id*1009)%20000)"


@query(f"SELECT event_id FROM p WHERE {_PIA} BETWEEN 10802833 AND 10811718 AND event_id%3 < 2")
def privacy_candidates(spark, d):
    e = F.col(E)
    callsign = F.concat(F.element_at(F.array(F.lit("DCM"), F.lit("FFL"), F.lit("ABC")), (e % 3 + 1).cast("int")), F.lit("12"))
    return references.privacy_candidates(points(spark, d).select(E, (10802833 + e * 1009 % 20000).alias("icao24"), callsign.alias("callsign"))).select(E)


_LY = "ly AS (SELECT n_regionkey sp, n_name nm, CAST((n_nationkey%5)*50 AS DOUBLE) lo, CAST((n_nationkey%5)*50+100+(n_nationkey%7)*30 AS DOUBLE) hi FROM nation)"


def _layers(spark, d):
    lower = (k() % 5 * 50).cast("double")
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("airspace"), F.col("n_name").alias("name"), lower.alias("lower"), (lower + 100 + k() % 7 * 30).alias("upper"))


@query(f"PLAIN WITH {_LY} SELECT nm AS name, 'at' kind FROM ly WHERE lo<=120 AND hi>=120 UNION ALL SELECT nm, 'above' FROM ly WHERE hi>=250 UNION ALL SELECT nm, 'below' FROM ly WHERE lo<=60")
def airspace_levels(spark, d):
    y = _layers(spark, d)
    parts = [(references.at_level(y, 120), "at"), (references.above(y, 250), "above"), (references.below(y, 60), "below")]
    out = [p.select("name", F.lit(kind).alias("kind")) for p, kind in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    f"PLAIN WITH {_LY}, c AS (SELECT DISTINCT sp, unnest([lo,hi]) a FROM ly), c2 AS (SELECT sp, a, lead(a) OVER (PARTITION BY sp ORDER BY a) b FROM c), "
    "s AS (SELECT c2.sp, a, b, string_agg(nm, ',' ORDER BY nm) ls FROM c2 JOIN ly ON ly.sp=c2.sp AND lo<=a AND hi>=b WHERE b IS NOT NULL GROUP BY c2.sp, a, b), "
    "g AS (SELECT *, CASE WHEN lag(ls) OVER w = ls AND lag(b) OVER w = a THEN 0 ELSE 1 END o FROM s WINDOW w AS (PARTITION BY sp ORDER BY a)), "
    "r AS (SELECT *, sum(o) OVER (PARTITION BY sp ORDER BY a ROWS UNBOUNDED PRECEDING) k FROM g) "
    'SELECT sp airspace, min(a) AS "lower", max(b) AS "upper", min(ls) layers FROM r GROUP BY sp, k'
)
def airspace_slabs(spark, d):
    return references.slabs(_layers(spark, d), ["airspace"], "name").withColumn("layers", F.array_join("layers", ","))


@query("SELECT flight_id, min(longitude) west, min(latitude) south, max(longitude) east, max(latitude) north FROM f GROUP BY flight_id")
def flight_bounds(spark, d):
    return references.bounds(flights(spark, d), BY)


_END = "(SELECT flight_id, max(ts) t, avg(groundspeed) gs, arg_max(latitude,(ts,event_id)) la, arg_max(longitude,(ts,event_id)) lo FROM f GROUP BY flight_id)"
_LEGS = f"(SELECT *, sum(coalesce({dist('pl', 'po', 'latitude', 'longitude')},0)) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) al FROM (SELECT *, lag(latitude) OVER (ORDER BY name) pl, lag(longitude) OVER (ORDER BY name) po FROM pts))"


@query(
    f"SELECT flight_id, name, round(latitude,6) latitude FROM (SELECT flight_id, q.name, q.latitude, ({dist('la', 'lo', 'z.latitude', 'z.longitude')}+q.al)/gs h FROM {_END} e, {_LEGS} q, (SELECT * FROM pts WHERE name='NATION_0') z) WHERE floor(h*3.6e9) <= 3600000000"
)
def follow_plan(spark, d):
    plan = beacons(spark, d).withColumn("number", F.col("name"))
    return references.follow_plan(flights(spark, d), plan, BY, "1 h").select("flight_id", "name", F.round("latitude", 6).alias("latitude"))


# Exchange formats


@query("SELECT flight_id, 'LineString' AS kind, count(*) n, round(arg_min(longitude, (ts, event_id)),6) lon0, round(arg_max(latitude, (ts, event_id)),6) lat1 FROM f GROUP BY flight_id")
def geojson_lines(spark, d):
    g = exchange.line_string(flights(spark, d), BY).select("flight_id", F.from_json("geojson", "type string, coordinates array<array<double>>").alias("g"))
    at = F.col("g.coordinates")
    return g.select("flight_id", F.col("g.type").alias("kind"), F.size(at).cast("long").alias("n"), F.round(at[0][0], 6).alias("lon0"), F.round(F.element_at(at, -1)[1], 6).alias("lat1"))


@query(f"PLAIN WITH {_LY} SELECT CAST(sp AS BIGINT) AS name, lo AS \"lower\", hi AS \"upper\", CAST(4 AS BIGINT) corners, lo AS x0 FROM ly")
def airspace_json(spark, d):
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, one = F.col("lower"), F.lit(1.0)
    ring = F.array(corner(x, x), corner(x + one, x), corner(x + one, x + one), corner(x, x + one))
    y = _layers(spark, d).select(F.col("airspace").cast("string").alias("name"), F.lit("FIR").alias("type"), "lower", "upper", ring.alias("ring"))
    back = exchange.airspace_from_json(exchange.airspace_to_json(y), "json")
    return back.select(F.col("name").cast("long").alias("name"), "lower", "upper", F.size("ring").cast("long").alias("corners"), F.col("ring")[0]["x"].alias("x0"))


@query("SELECT CAST(event_id AS DOUBLE) mintime, lower(printf('%x', event_id*7919)) rawmsg FROM p WHERE event_id%5 > 0")
def raw_templates(spark, d):
    e = F.col(E)
    line = F.concat(F.when(e % 5 == 0, "bad").otherwise(e.cast("string")), F.lit(", "), F.lit("0" * exchange.LONG_HEADER), F.lower(F.hex(e * 7919)))
    return exchange.raw_messages(points(spark, d).select(line.alias("value")))
