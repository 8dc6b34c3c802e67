"""Queries: parsing, codecs, grouped algorithms, learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec, geo
from ..operators import graphs, grouped, ml
from ..sources import files
from .base import TABLES, beacons, flights, points, query, table

BY = ["flight_id"]
E = "event_id"


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) k FROM p")
def json_flatten(spark, d):
    return files.flatten_json(points(spark, d), "props", "k int").select(E, "k")


_POS = "CAST(latitude AS VARCHAR)"


@query("SELECT event_id, CAST(100+event_id%50 AS DOUBLE) latitude, CAST(event_id%90 AS DOUBLE) longitude, altitude, groundspeed, track, make_timestamp(event_id*1000000) ts FROM p")
def fr24_csv(spark, d):
    e = F.col(E)
    web = points(spark, d).select(
        e.alias("Timestamp"), F.lit("x").alias("UTC"), F.col("icao24").cast("string").alias("Callsign"), F.concat_ws(",", (100 + e % 50).cast("string"), (e % 90).cast("string")).alias("Position"),
        F.col("altitude").alias("Altitude"), F.col("groundspeed").alias("Speed"), F.col("track").alias("Direction"),
    )
    out = files.web_csv(web)
    return out.select(F.unix_seconds("timestamp").alias(E), "latitude", "longitude", "altitude", "groundspeed", "track", F.col("timestamp").cast("timestamp_ntz").alias("ts"))


_DMS = "lpad(CAST(event_id%90 AS VARCHAR),2,'0')||lpad(CAST(event_id%60 AS VARCHAR),2,'0')||lpad(CAST((event_id*7)%60 AS VARCHAR),2,'0')||CASE WHEN event_id%2=0 THEN 'N' ELSE 'S' END||lpad(CAST(event_id%180 AS VARCHAR),3,'0')||lpad(CAST((event_id*3)%60 AS VARCHAR),2,'0')||lpad(CAST((event_id*11)%60 AS VARCHAR),2,'0')||CASE WHEN event_id%3=0 THEN 'E' ELSE 'W' END"
_DLAT = "((event_id%90)+(event_id%60)/60.0+((event_id*7)%60)/3600.0)*CASE WHEN event_id%2=0 THEN 1 ELSE -1 END"
_DLON = "((event_id%180)+((event_id*3)%60)/60.0+((event_id*11)%60)/3600.0)*CASE WHEN event_id%3=0 THEN 1 ELSE -1 END"


def _dms(e):
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(pad(e % 90, 2), pad(e % 60, 2), pad(e * 7 % 60, 2), F.when(e % 2 == 0, "N").otherwise("S"), pad(e % 180, 3), pad(e * 3 % 60, 2), pad(e * 11 % 60, 2), F.when(e % 3 == 0, "E").otherwise("W"))


@query(f"SELECT event_id, round({_DLAT},6) latitude, round({_DLON},6) longitude FROM p")
def coord_parse(spark, d):
    lat, lon = codec.dms_pair(_dms(F.col(E)))
    return points(spark, d).select(E, r6(lat, "latitude"), r6(lon, "longitude"))


@query(f"SELECT event_id, n, CASE WHEN n=0 THEN 'AAA' ELSE 'BBB' END point, CAST(CASE WHEN n=0 THEN 100 ELSE 200 END AS VARCHAR) \"flightLevel\", round({_DLAT},6) latitude FROM p, (SELECT unnest([0,1]) n)")
def allft_profile(spark, d):
    e = F.col(E)
    one = lambda name, fl: F.concat_ws(":", F.lit("20240101"), F.lit(name), F.lit("R1"), F.lit(fl), F.lit("0"), F.lit("V"), _dms(e), F.lit("0"), F.lit("Y"))
    packed = points(spark, d).select(E, F.concat_ws("  ", one("AAA", "100"), one("BBB", "200")).alias("profile"))
    return files.point_profile(packed, "profile", E).select(E, "n", "point", "flightLevel", r6("latitude"))


@query("SELECT event_id, CAST(event_id%1000 AS INTEGER) speed, CAST((event_id*3)%500 AS INTEGER) \"level\" FROM p")
def speedlevel_parse(spark, d):
    e = F.col(E)
    s, v = codec.speed_level(F.concat(F.lit("N"), F.lpad((e % 1000).cast("string"), 4, "0"), F.lit("F"), F.lpad((e * 3 % 500).cast("string"), 3, "0")))
    return points(spark, d).select(E, s.alias("speed"), v.alias("level"))


@query("SELECT event_id, round(CAST(event_id%90 AS DOUBLE)*CASE WHEN event_id%2=0 THEN 1 ELSE -1 END,6) latitude, round(CAST(event_id%180 AS DOUBLE)*-1,6) longitude FROM p")
def coordinate_token(spark, d):
    e = F.col(E)
    lat, lon = codec.coordinate(F.concat(F.lpad((e % 90).cast("string"), 2, "0"), F.when(e % 2 == 0, "N").otherwise("S"), F.lpad((e % 180).cast("string"), 3, "0"), F.lit("W")))
    return points(spark, d).select(E, r6(lat, "latitude"), r6(lon, "longitude"))


@query("SELECT event_id, round(event_id*1000/12e6,9) dump, round((event_id%86400) + ((event_id*977)%1000000000)/1e9, 9) radarcape FROM p")
def timestamp_decode(spark, d):
    e = F.col(E)
    rc = F.hex(F.shiftleft((e % 86400).cast("long"), 30).bitwiseOR(e * 977 % 1000000000))
    return points(spark, d).select(E, F.round(codec.dump1090_seconds(F.hex(e * 1000)), 9).alias("dump"), F.round(codec.radarcape_seconds(rc), 9).alias("radarcape"))


_ICAO = "lower(printf('%x', 10485761 + (event_id*91)%915399))"


@query(f"SELECT event_id, {_ICAO} icao24 FROM p")
def n_number_roundtrip(spark, d):
    n = codec.icao_to_n_number(F.lower(F.hex(10485761 + F.col(E) * 91 % 915399)))
    return points(spark, d).select(E, n.alias("n")).select(E, codec.n_number_to_icao("n").alias("icao24"))


_B1, _B2, _B3, _B4, _SX = 101711, 10111, 951, 35, 601


@query(
    "SELECT event_id, lower(printf('%x', CASE "
    f"WHEN event_id%3=0 THEN 10485761+(event_id%9)*{_B1} "
    f"WHEN event_id%3=1 THEN 10485761+(event_id%9)*{_B1}+{_SX}+(event_id%10)*{_B2} "
    f"ELSE 10485761+(event_id%9)*{_B1}+{_SX}+(event_id%10)*{_B2}+{_SX}+(event_id*7%10)*{_B3}+{_SX}+(event_id*3%10)*{_B4} END)) icao24 FROM p"
)
def n_number_encode(spark, d):
    e = F.col(E)
    s = lambda x: x.cast("string")
    n = F.when(e % 3 == 0, s(e % 9 + 1)).when(e % 3 == 1, F.concat(s(e % 9 + 1), s(e % 10))).otherwise(F.concat(s(e % 9 + 1), s(e % 10), s(e * 7 % 10), s(e * 3 % 10)))
    return points(spark, d).select(E, codec.n_number_to_icao(F.concat(F.lit("N"), n)).alias("icao24"))


@query("SELECT event_id, CASE event_id%6 WHEN 0 THEN 'direct' WHEN 1 THEN 'speed_level' WHEN 2 THEN 'airway' WHEN 3 THEN 'point' WHEN 4 THEN 'coordinate' ELSE 'rule' END kind FROM p")
def plan_tokens(spark, d):
    t = F.element_at(F.array(*[F.lit(x) for x in ("DCT", "N0450F340", "L888", "NARAK", "61N070W", "VFR")]), (F.col(E) % 6 + 1).cast("int"))
    return points(spark, d).select(E, codec.token_kind(t, F.lit("X")).alias("kind"))


@query("SELECT event_id, 0.0 d_lat, 0.0 d_lon FROM p")
def projection_roundtrip(spark, d):
    x, y = geo.lcc("latitude", "longitude", 45.0, 3.0, 44.0, 46.0)
    lat, lon = geo.lcc_inverse("x", "y", 45.0, 3.0, 44.0, 46.0)
    p = points(spark, d).withColumns({"x": x, "y": y})
    return p.select(E, (F.round(F.abs(lat - F.col("latitude")), 6) + 0.0).alias("d_lat"), (F.round(F.abs(lon - F.col("longitude")), 6) + 0.0).alias("d_lon"))


# Learning

_DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1]-z[2] AS DOUBLE), 2)))"


@query(f"PLAIN SELECT vec_id, round(m, 4) mean_distance FROM (SELECT a.vec_id, avg(sqrt({_DIST})) m FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id GROUP BY a.vec_id) ORDER BY m, vec_id LIMIT 1")
def centroid(spark, d):
    return ml.centroid(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("mean_distance", 4).alias("mean_distance"))


@query()
def kmeans(spark, d):
    return ml.kmeans(table(spark, d, "embeddings").select("vec_id", "embedding"), 5, column="embedding").select("vec_id", "cluster")


@query()
def dbscan(spark, d):
    v = points(spark, d).select(E, F.array("latitude", "longitude").alias("features"))
    return ml.dbscan(v, 0.02, 3, E)


_FN = "(SELECT icao24, min(epoch_us(ts)) a, max(epoch_us(ts)) z FROM p GROUP BY icao24)"
_FG = f"(SELECT icao24, i, a+CAST(floor((z-a)*i/9) AS BIGINT) t FROM {_FN}, range(10) r(i))"
_FJ = f"(SELECT g.icao24, g.i, p.latitude, p.longitude, row_number() OVER (PARTITION BY g.icao24, g.i ORDER BY abs(epoch_us(ts)-g.t), ts, event_id) k FROM {_FG} g JOIN p ON g.icao24=p.icao24)"


@query(f"SELECT icao24, string_agg(CAST(CAST(round(latitude*1000) AS BIGINT) AS VARCHAR), ',' ORDER BY i)||','||string_agg(CAST(CAST(round(longitude*1000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) features FROM {_FJ} WHERE k=1 GROUP BY icao24")
def trajectory_features(spark, d):
    v = ml.features(points(spark, d), ["icao24"], 10, "latitude", "longitude")
    return v.select("icao24", F.array_join(F.transform("features", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("features"))


@query()
def generation(spark, d):
    v = ml.features(points(spark, d), ["icao24"], 5, "altitude")
    return ml.Generation.fit(v).sample(spark, 10)


# One flight at a time


def _xy(spark, d):
    f = flights(spark, d).select("flight_id", E, "timestamp", "latitude", "longitude", "altitude", "groundspeed", "track", "vertical_rate")
    x, y = geo.azimuthal("latitude", "longitude", 45.0, 3.0)
    return f.withColumns({"x": x, "y": y})


@query()
def simplify_rdp(spark, d):
    return grouped.simplify(_xy(spark, d), BY, 20000.0).select("flight_id", E)


@query(
    f"PLAIN WITH RECURSIVE {TABLES}, r AS (SELECT flight_id, CAST(0 AS BIGINT) k, min(ts) s FROM f GROUP BY flight_id UNION ALL "
    "SELECT r.flight_id, r.k+1, min(f.ts) FROM r JOIN f ON f.flight_id=r.flight_id AND epoch_us(f.ts) > epoch_us(r.s)+21600000000 GROUP BY r.flight_id, r.k) "
    'SELECT f.flight_id, k AS "window", f.event_id FROM r JOIN f ON f.flight_id=r.flight_id AND f.ts >= r.s AND epoch_us(f.ts) < epoch_us(r.s)+43200000000'
)
def sliding_windows(spark, d):
    return grouped.sliding_windows(flights(spark, d).select("flight_id", E, "timestamp"), BY, "12 h", "6 h").select("flight_id", "window", E)


@query()
def kalman6d(spark, d):
    return grouped.kalman6d(_xy(spark, d), BY, True).select(E, "x", "y", "altitude")


@query()
def ekf_rts(spark, d):
    return grouped.ekf_rts(_xy(spark, d), BY).select(E, "x", "y", "altitude")


@query()
def consistency(spark, d):
    return grouped.consistency(_xy(spark, d), BY).select(E, "ok")


_V, _H = "greatest(groundspeed*1852/3600, 30.0)", "greatest(0.0, altitude*CAST(0.3048 AS DOUBLE))"
_DYN = f"(0.5*(1.225*pow(greatest(1-CAST(2.2558e-5 AS DOUBLE)*{_H}, 0.2), CAST(4.2559 AS DOUBLE)))*{_V}*{_V}*122.0)"


def _flow(m):
    cl = f"({m}*CAST(9.80665 AS DOUBLE)/{_DYN})"
    return f"greatest(CAST(0.1 AS DOUBLE), greatest({_DYN}*(0.02+0.04*{cl}*{cl})+{m}*CAST(9.80665 AS DOUBLE)*(vertical_rate*CAST(0.3048 AS DOUBLE)/60)/{_V}, 0.0)*CAST(1.6e-5 AS DOUBLE))"


@query(
    f"PLAIN WITH RECURSIVE {TABLES}, n AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY ts, event_id) i, coalesce((epoch_us(lead(ts) OVER (PARTITION BY flight_id ORDER BY ts, event_id))-epoch_us(ts))/CAST(1e6 AS DOUBLE), 0) dt FROM f), "
    f"r AS (SELECT flight_id, i, event_id, dt, CAST(60000 AS DOUBLE) mass, {_flow('60000.0')} ff FROM n WHERE i=1 UNION ALL "
    f"SELECT flight_id, i, event_id, dt, m, {_flow('m')} FROM (SELECT n.*, greatest(r.mass-r.ff*r.dt, 1.0) m FROM r JOIN n ON n.flight_id=r.flight_id AND n.i=r.i+1)) "
    'SELECT event_id, round(ff,6) fuelflow, round(mass,3) mass, round(sum(ff*dt) OVER (PARTITION BY flight_id ORDER BY i)*3149.0*0.001, 2) "CO2" FROM r'
)
def fuel_recurrence(spark, d):
    out = grouped.emission(grouped.fuel(_xy(spark, d), BY), BY)
    return out.select(E, r6("fuelflow"), F.round("mass", 3).alias("mass"), F.round("CO2", 2).alias("CO2"))


@query('SELECT icao24, make_timestamp(CAST(round_even(epoch_us(ts)/CAST(86400000000 AS DOUBLE),0) AS BIGINT)*86400000000) rounded, max(altitude)-min(altitude) span FROM p GROUP BY 1, 2')
def apply_time(spark, d):
    f = points(spark, d).select("icao24", "timestamp", "altitude")
    return grouped.apply_time(f, ["icao24"], "1 d", span=lambda f: np.fmax.reduce(f["altitude"]) - np.fmin.reduce(f["altitude"]))


@query()
def map_match(spark, d):
    nodes = beacons(spark, d).withColumn("node", F.row_number().over(W.orderBy("name")) - 1)  # a small graph, of one airport
    edges = nodes.select(F.col("node").alias("u"), (F.col("node") + 1).alias("v"), F.lit(1.0).alias("w"))
    return graphs.map_match(flights(spark, d).select("flight_id", E, "timestamp", "latitude", "longitude"), BY, nodes, edges.join(nodes.select(F.col("node").alias("v")), "v"))
