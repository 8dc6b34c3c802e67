"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo

from ..operators import aggregates, keys, resample, segments, sets, slicing, windows
from .base import brg, dist, flights, pmod, points, query, runs

BY = ["flight_id"]
H6, H12, DAY = 21600000000, 43200000000, 86400000000
E = "event_id"


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


# Flights and time slices


@query('SELECT icao24, leg, count(*) n, min(ts) AS "start", max(ts) AS "stop" FROM f GROUP BY icao24, leg')
def leg_split(spark, d):
    return keys.legs(points(spark, d), ["icao24"], "12 h").groupBy("icao24", "leg").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("start"), F.max("timestamp").alias("stop"))


@query('SELECT flight_id, count(*) n, min(ts) AS "start", max(ts) AS "stop", epoch_us(max(ts))-epoch_us(min(ts)) duration_us, max(altitude) altitude_max, round(avg(altitude),6) altitude_mean FROM f GROUP BY flight_id')
def leg_summary(spark, d):
    s = aggregates.summary(flights(spark, d), BY, "count", "start", "stop", "duration_us", "altitude_max", "altitude_mean")
    return s.withColumnRenamed("count", "n").withColumn("altitude_mean", F.round("altitude_mean", 6))


@query("SELECT event_id, flight_id FROM f")
def assign_id(spark, d):
    return flights(spark, d).select(E, "flight_id")


@query("SELECT event_id FROM p WHERE ts > '2024-01-05 00:00:00' AND ts < '2024-01-12 12:00:00'")
def between_strict(spark, d):
    return slicing.between(points(spark, d), "2024-01-05 00:00:00", "2024-01-12 12:00:00").select(E)


@query("SELECT event_id FROM p WHERE ts >= '2024-01-05 00:00:00' AND ts <= '2024-01-12 12:00:00'")
def between_inclusive(spark, d):
    return slicing.between(points(spark, d), "2024-01-05 00:00:00", "2024-01-12 12:00:00", False).select(E)


_EDGE = "(SELECT *, min(ts) OVER (PARTITION BY flight_id) a, max(ts) OVER (PARTITION BY flight_id) z FROM f)"


@query(f"SELECT event_id FROM {_EDGE} WHERE ts > a AND ts < '2024-01-15 00:00:00'")
def before_strict(spark, d):
    return slicing.before(flights(spark, d), "2024-01-15 00:00:00", BY).select(E)


@query("SELECT event_id FROM f WHERE ts >= '2024-01-15 00:00:00'")
def after_inclusive(spark, d):
    return slicing.after(flights(spark, d), "2024-01-15 00:00:00", BY, strict=False).select(E)


@query(f"SELECT event_id FROM {_EDGE} WHERE epoch_us(ts) < epoch_us(a)+{H6}")
def first_window(spark, d):
    return slicing.first(flights(spark, d), "6 h", BY).select(E)


@query(f"SELECT event_id FROM {_EDGE} WHERE epoch_us(ts) >= epoch_us(a)+{H6}")
def skip_window(spark, d):
    return slicing.skip(flights(spark, d), "6 h", BY).select(E)


@query(f"SELECT event_id FROM {_EDGE} WHERE epoch_us(ts) > epoch_us(z)-{H6}")
def last_window(spark, d):
    return slicing.last(flights(spark, d), "6 h", BY).select(E)


@query(f"SELECT event_id FROM {_EDGE} WHERE epoch_us(ts) <= epoch_us(z)-{H6}")
def shorten_window(spark, d):
    return slicing.shorten(flights(spark, d), "6 h", BY).select(E)


@query("SELECT flight_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(altitude, (ts, event_id)) altitude FROM f GROUP BY flight_id")
def at_last(spark, d):
    return slicing.at(flights(spark, d), BY).select("flight_id", E, "altitude")


@query("SELECT event_id FROM p WHERE ts = (SELECT min(ts) FROM events)")
def at_time(spark, d):
    p = points(spark, d)
    return slicing.at(p, ["icao24"], str(p.agg(F.min("timestamp")).first()[0])).select(E)


@query(f"SELECT flight_id, arg_max(event_id, (ts, event_id)) event_id FROM {_EDGE} WHERE epoch_us(ts) <= epoch_us(a)+(epoch_us(z)-epoch_us(a))*CAST(0.5 AS DOUBLE) GROUP BY flight_id")
def at_ratio(spark, d):
    return slicing.at_ratio(flights(spark, d), BY, 0.5).select("flight_id", E)


# Predicates


@query("SELECT event_id, altitude, track FROM p WHERE altitude > 100 AND track < 180 AND event_type IN ('view','click')")
def query_filter(spark, d):
    return points(spark, d).filter("altitude > 100 and track < 180 and event_type in ('view', 'click')").select(E, "altitude", "track")


@query(f"SELECT event_id FROM {_EDGE} WHERE epoch_us(z)-epoch_us(a) > {DAY}")
def longer_than(spark, d):
    return slicing.longer_than(flights(spark, d), "1 d", BY).select(E)


@query(f"SELECT event_id FROM {_EDGE} WHERE epoch_us(z)-epoch_us(a) <= {DAY}")
def shorter_than(spark, d):
    return slicing.shorter_than(flights(spark, d), "1 d", BY, strict=False).select(E)


@query("SELECT event_id FROM f WHERE flight_id IN (SELECT flight_id FROM f GROUP BY flight_id HAVING max(altitude) > 300)")
def feature_gt(spark, d):
    return slicing.feature_gt(flights(spark, d), aggregates.feature("altitude_max"), 300, BY).select(E)


@query("SELECT event_id FROM f WHERE flight_id IN (SELECT flight_id FROM f GROUP BY flight_id HAVING avg(groundspeed) < 250)")
def feature_lt(spark, d):
    return slicing.feature_lt(flights(spark, d), aggregates.feature("groundspeed_mean"), 250, BY).select(E)


@query("SELECT event_id FROM p WHERE icao24 IN (SELECT icao24 FROM p GROUP BY icao24 HAVING count(DISTINCT altitude) > 66)")
def clean_invalid(spark, d):
    return slicing.clean_invalid(points(spark, d), ["icao24"], "altitude", 66).select(E)


@query("SELECT event_id FROM p WHERE longitude BETWEEN 1.5 AND 3 AND latitude BETWEEN 43.2 AND 45")
def inside_bbox(spark, d):
    return slicing.inside_bbox(points(spark, d), 1.5, 43.2, 3, 45).select(E)


@query("SELECT event_id, NOT onground AS air FROM p")
def airborne_onground(spark, d):
    p = points(spark, d)
    return slicing.airborne(p).select(E, F.lit(True).alias("air")).unionByName(slicing.onground(p).select(E, F.lit(False).alias("air")))


@query(f'SELECT * FROM (WITH e AS (SELECT * FROM f WHERE squawk=\'7700\'), {runs("e", "flight_id", H6)} SELECT flight_id, seg_idx, "start", "stop", n FROM seg)')
def emergency(spark, d):
    return segments.segments(slicing.emergency(flights(spark, d)), BY, "6 h").select("flight_id", "seg_idx", "start", "stop", "n")


# Columns and windows

_W = "OVER (PARTITION BY flight_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, round(altitude - lag(altitude) {_W}, 6) altitude_diff FROM f")
def diff(spark, d):
    return windows.diff(flights(spark, d), BY, altitude_diff="altitude").select(E, r6("altitude_diff"))


@query("SELECT event_id, abs(vertical_rate) vertical_rate_abs FROM p")
def abs_column(spark, d):
    return windows.absolute(points(spark, d), vertical_rate_abs="vertical_rate").select(E, "vertical_rate_abs")


_U = f"(SELECT *, track - lag(track) {_W} dd FROM f)"
_UNWRAP = f"(SELECT *, track + sum(coalesce(CASE WHEN dd>180 THEN -360*ceil((dd-180)/360) WHEN dd<-180 THEN -360*floor((dd+180)/360) END,0)) OVER (PARTITION BY flight_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) tu FROM {_U})"


@query(f"SELECT event_id, round(tu, 6) track_unwrapped FROM {_UNWRAP}")
def unwrap(spark, d):
    return windows.unwrap(flights(spark, d), BY, "track").select(E, r6("track_unwrapped"))


@query("SELECT event_id, round_even(altitude/0.3048, 0) altitude, round_even(groundspeed/(1852.0/3600.0), 0) groundspeed, round_even(vertical_rate/(0.3048/60.0), 0) vertical_rate FROM p")
def unit_convert(spark, d):
    from ..schema import to_nautical

    return to_nautical(points(spark, d)).select(E, "altitude", "groundspeed", "vertical_rate")


_TAS = "(groundspeed+20)"
_HD = "(track+5)"


@query(f"SELECT event_id, round(groundspeed*sin(radians(track))-{_TAS}*sin(radians({_HD})),6) wind_u, round(groundspeed*cos(radians(track))-{_TAS}*cos(radians({_HD})),6) wind_v FROM p")
def wind_vector(spark, d):
    u, v = geo.wind("groundspeed", "track", F.col("groundspeed") + 20, F.col("track") + 5)
    return points(spark, d).select(E, r6(u, "wind_u"), r6(v, "wind_v"))


_AX, _AY = "(groundspeed*sin(radians(track))-10.0)", "(groundspeed*cos(radians(track))-5.0)"


@query(f"SELECT event_id, round(sqrt({_AX}*{_AX}+{_AY}*{_AY}),6) TAS, round({pmod(f'(90.0-degrees(atan2({_AY},{_AX})))', '360.0')},6) heading FROM p")
def compute_tas(spark, d):
    tas, heading = geo.air_vector("groundspeed", "track", 10.0, 5.0)
    return points(spark, d).select(E, r6(tas, "TAS"), r6(heading, "heading"))


@query(f"SELECT event_id, coalesce((SELECT true FROM (SELECT flight_id fi, \"start\" sa, \"stop\" so FROM (WITH e AS (SELECT * FROM f WHERE altitude > 60), {runs('e', 'flight_id', H6)} SELECT * FROM seg)) s WHERE s.fi=f.flight_id AND f.ts BETWEEN s.sa AND s.so LIMIT 1), false) high FROM f")
def label_segments(spark, d):
    fl = flights(spark, d)
    return segments.label(fl, segments.segments(fl.filter("altitude > 60"), BY, "6 h"), BY, "high").select(E, "high")


_FB = "CASE WHEN event_type IN ('view','click') THEN altitude END"
_FILLW = "PARTITION BY flight_id ORDER BY ts, event_id"


@query(f"SELECT event_id, coalesce(first_value(x IGNORE NULLS) OVER ({_FILLW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(x IGNORE NULLS) OVER ({_FILLW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x FROM (SELECT *, {_FB} x FROM f)")
def ffill_bfill(spark, d):
    x = flights(spark, d).withColumn("x", F.when(F.col("event_type").isin("view", "click"), F.col("altitude")))
    return windows.fill(x, BY, "x").select(E, "x")


_LAG = f"(SELECT *, lag(latitude) {_W} la, lag(longitude) {_W} lo, lag(ts) {_W} lt, row_number() {_W} rn FROM f)"
_STEP = f"(SELECT *, {dist('la', 'lo', 'latitude', 'longitude')} dd, {brg('la', 'lo', 'latitude', 'longitude')} bb, epoch_us(ts)-epoch_us(lt) dt FROM {_LAG})"
_STEP2 = f"(SELECT *, CASE WHEN dt>0 THEN dd/(dt/3.6e9) END gs, CASE WHEN bb=0 THEN 360.0 ELSE bb END tb FROM {_STEP})"


@query(f"SELECT event_id, round(sum(coalesce(dd,0)) OVER (PARTITION BY flight_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),5) cumdist FROM {_STEP2}")
def cumulative_distance(spark, d):
    return windows.cumulative_distance(flights(spark, d), BY).select(E, F.round("cumdist", 5).alias("cumdist"))


@query(f"SELECT event_id, round(CASE WHEN rn=1 THEN lead(gs) {_W} ELSE gs END,5) compute_gs, round(CASE WHEN rn=1 THEN lead(tb) {_W} ELSE tb END,5) compute_track FROM {_STEP2}")
def compute_gs_track(spark, d):
    return windows.cumulative_distance(flights(spark, d), BY).select(E, F.round("compute_gs", 5).alias("compute_gs"), F.round("compute_track", 5).alias("compute_track"))


def _kernel(k):
    return f"OVER (PARTITION BY icao24 ORDER BY ts, event_id ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING)"


@query(f"SELECT event_id, CASE WHEN count(altitude) {_kernel(5)} = 5 THEN round(median(altitude) {_kernel(5)}, 6) ELSE round(altitude, 6) END altitude FROM p")
def median_filter(spark, d):
    return windows.median(["icao24"], altitude=5)(points(spark, d)).select(E, r6("altitude"))


@query(f"SELECT event_id, CASE WHEN count(altitude) {_kernel(10)} = 10 THEN round(avg(altitude) {_kernel(10)}, 6) ELSE round(altitude, 6) END altitude FROM p")
def mean_filter(spark, d):
    return windows.mean(["icao24"], altitude=10)(points(spark, d)).select(E, r6("altitude"))


_PADM = "list_sort(list_concat(list({c}) {w}, list_transform(range(5 - len(list({c}) {w})), lambda z: 0.0::DOUBLE)))[3]"
_SIG1 = f"(SELECT *, {_PADM.format(c='altitude', w=_kernel(5))} m FROM p)"
_SIG2 = f"(SELECT *, pow(altitude - m, 2) e2 FROM {_SIG1})"


@query(f"SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY icao24) < 5 OR e2 <= sqrt({_PADM.format(c='e2', w=_kernel(5))}) THEN altitude END altitude FROM {_SIG2}")
def sigma_median(spark, d):
    return windows.sigma_median(["icao24"], altitude=5)(points(spark, d)).select(E, "altitude")


_PW = "(PARTITION BY icao24 ORDER BY ts, event_id)"
_D1 = f"(SELECT *, abs((altitude-lag(altitude) OVER {_PW})/((epoch_us(ts)-epoch_us(lag(ts) OVER {_PW}))/1e6)) d1 FROM p)"
_D2 = f"(SELECT *, abs((d1-lag(d1) OVER {_PW})/((epoch_us(ts)-epoch_us(lag(ts) OVER {_PW}))/1e6)) d2 FROM {_D1})"
_D3 = f"(SELECT *, CASE WHEN d1>0.01 OR d2>0.01 THEN epoch_us(ts) END sp FROM {_D2})"
_D4 = f"(SELECT *, last_value(sp IGNORE NULLS) OVER (PARTITION BY icao24 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) pv, first_value(sp IGNORE NULLS) OVER (PARTITION BY icao24 ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) nx FROM {_D3})"


@query(f"SELECT event_id, CASE WHEN NOT coalesce(epoch_us(ts)-pv <= 7200000000 AND nx-epoch_us(ts) <= 7200000000, false) THEN altitude END altitude FROM {_D4}")
def derivative_filter(spark, d):
    return windows.derivative(["icao24"], "altitude", 0.01, 0.01, 7200)(points(spark, d)).select(E, "altitude")


_C1 = f"(SELECT *, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER {_PW}) > {H12} OR abs(altitude-lag(altitude) OVER {_PW}) > 60 THEN 1 ELSE 0 END cut FROM p)"
_C2 = f"(SELECT *, sum(cut) OVER (PARTITION BY icao24 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) grp FROM {_C1})"


@query(f"SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY icao24, grp) > 2 THEN altitude END altitude FROM {_C2}")
def cluster_filter(spark, d):
    return windows.clustering(["icao24"], "altitude", 60, 2, "12 h")(points(spark, d)).select(E, "altitude")


_GSP = f"(SELECT *, CASE WHEN rn=1 THEN lead(gs) {_W} ELSE gs END cgs FROM {_STEP2})"


@query(f"SELECT event_id FROM (SELECT event_id, cgs, avg(cgs) OVER (PARTITION BY flight_id) + 3*stddev_samp(cgs) OVER (PARTITION BY flight_id) bd FROM {_GSP}) WHERE cgs < bd")
def position_filter(spark, d):
    return windows.position(BY, 1)(flights(spark, d)).select(E)


# Aggregates


@query("SELECT icao24, count(*) AS \"count\" FROM p GROUP BY icao24")
def basic_stats(spark, d):
    return aggregates.basic_stats(points(spark, d), ["icao24"])


@query("SELECT icao24, count(DISTINCT event_type) types, CASE WHEN count(DISTINCT squawk)=1 THEN max(squawk) END squawk, round(median(altitude),6) altitude_median, round(stddev_samp(altitude),6) altitude_std FROM p GROUP BY icao24")
def summary(spark, d):
    return points(spark, d).groupBy("icao24").agg(F.count_distinct("event_type").alias("types"), aggregates.unique("squawk").alias("squawk"), r6(F.median("altitude"), "altitude_median"), r6(F.stddev_samp("altitude"), "altitude_std"))


_B = f"make_timestamp(CAST(round_even(epoch_us(ts)/CAST({H6} AS DOUBLE),0) AS BIGINT)*{H6})"


@query(f"SELECT event_id, max(altitude) OVER (PARTITION BY icao24, b) altitude_max, count(*) OVER (PARTITION BY icao24, b) event_id_count FROM (SELECT *, {_B} b FROM p)")
def agg_time_merge(spark, d):
    return aggregates.agg_time(points(spark, d), ["icao24"], "6 h", True, altitude="max", event_id="count").select(E, "altitude_max", "event_id_count")


@query(f"SELECT icao24, {_B} rounded, min(altitude) altitude_min, round(avg(altitude),6) altitude_mean, count(DISTINCT event_type) event_type_nunique FROM p GROUP BY 1, 2")
def agg_time_nomerge(spark, d):
    return aggregates.agg_time(points(spark, d), ["icao24"], "6 h", False, altitude=["min", "mean"], event_type="nunique").withColumn("altitude_mean", F.round("altitude_mean", 6))


@query("SELECT floor(longitude*100/50)*50 x, floor(latitude*100/25)*25 y, count(altitude) altitude_count, count(DISTINCT icao24) icao24_nunique FROM p GROUP BY 1, 2")
def agg_xy(spark, d):
    xy = points(spark, d).withColumns({"x": F.col("longitude") * 100, "y": F.col("latitude") * 100})
    return aggregates.agg_xy(xy, (50, 25), altitude="count", icao24="nunique").withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})


@query("SELECT round_even(latitude*2,0)/2 latitude, round_even(longitude*4,0)/4 longitude, round(avg(altitude),6) altitude_mean, count(event_id) event_id_count FROM p GROUP BY 1, 2")
def agg_latlon(spark, d):
    return aggregates.agg_latlon(points(spark, d), {"latitude": 2, "longitude": 4}, altitude="mean", event_id="count").withColumn("altitude_mean", F.round("altitude_mean", 6))


@query(f"SELECT round_even(latitude*2,0)/2 latitude, round_even(longitude*2,0)/2 longitude, round(avg(groundspeed*sin(radians(track))-{_TAS}*sin(radians({_HD}))),5) wind_u_mean, round(avg(groundspeed*cos(radians(track))-{_TAS}*cos(radians({_HD}))),5) wind_v_mean, count(ts) timestamp_count FROM p GROUP BY 1, 2")
def windfield(spark, d):
    u, v = geo.wind("groundspeed", "track", F.col("groundspeed") + 20, F.col("track") + 5)
    w = aggregates.windfield(points(spark, d).withColumns({"wind_u": u, "wind_v": v}), {"latitude": 2, "longitude": 2})
    return w.withColumns({c: F.round(c, 5) for c in ("wind_u_mean", "wind_v_mean")})


# Sets, order, top-k


@query("SELECT event_id FROM p WHERE altitude > 200 UNION ALL SELECT event_id FROM p WHERE track < 90")
def union_all(spark, d):
    p = points(spark, d)
    return sets.union(p.filter("altitude > 200"), p.filter("track < 90")).select(E)


@query("SELECT event_id FROM f WHERE flight_id IN (SELECT flight_id FROM f WHERE altitude > 250)")
def intersect_ids(spark, d):
    f = flights(spark, d)
    return sets.intersect(f, f.filter("altitude > 250"), BY).select(E)


@query("SELECT event_id FROM f WHERE flight_id NOT IN (SELECT flight_id FROM f WHERE altitude > 250)")
def minus_ids(spark, d):
    f = flights(spark, d)
    return sets.minus(f, f.filter("altitude > 250"), BY).select(E)


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 350), b AS (SELECT DISTINCT user_id FROM events WHERE event_type='view' AND value > 200) SELECT user_id icao24 FROM (SELECT user_id FROM a EXCEPT SELECT user_id FROM b UNION ALL (SELECT user_id FROM b EXCEPT SELECT user_id FROM a))")
def xor_ids(spark, d):
    p = points(spark, d)
    a, b = p.filter("altitude > 350").select("icao24").distinct(), p.filter("event_type = 'view' and altitude > 200").select("icao24").distinct()
    return sets.symmetric(a, b, ["icao24"])


@query("SELECT event_type, squawk, min(event_id) event_id FROM p GROUP BY 1, 2")
def drop_duplicates(spark, d):
    p = points(spark, d).select("event_type", "squawk", E)
    return sets.drop_duplicates(p, ["event_type", "squawk"], [E])


@query("SELECT icao24, count(*) n, max(altitude) top FROM p GROUP BY icao24 ORDER BY n DESC, icao24 LIMIT 10")
def topk_flights(spark, d):
    return points(spark, d).groupBy("icao24").agg(F.count(F.lit(1)).alias("n"), F.max("altitude").alias("top")).orderBy(F.desc("n"), "icao24").limit(10)


@query()
def sample_flights(spark, d):
    return sets.sample(flights(spark, d), BY, 20).select("flight_id", E)


@query(f'SELECT * FROM (WITH {runs("p", "icao24", H6)} SELECT icao24, seg_idx, "start", "stop", n FROM (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY epoch_us("stop")-epoch_us("start") DESC, seg_idx) k FROM seg) WHERE k=1)')
def longest_segment(spark, d):
    s = segments.segments(points(spark, d), ["icao24"], "6 h")
    return segments.pick(s, ["icao24"], "max").select("icao24", "seg_idx", "start", "stop", "n")


@query(f"SELECT event_id FROM f WHERE flight_id IN (SELECT flight_id FROM (WITH e AS (SELECT * FROM f WHERE altitude > 60), {runs('e', 'flight_id', H6)} SELECT flight_id FROM seg))")
def has_segment(spark, d):
    f = flights(spark, d)
    return segments.has(f, segments.segments(f.filter("altitude > 60"), BY, "6 h"), BY).select(E)


# Resampling

_BIN = f"(SELECT icao24, make_timestamp(epoch_us(ts)//{H6}*{H6}) b, arg_min(altitude, (ts, event_id)) v, arg_min(event_type, (ts, event_id)) et FROM p GROUP BY 1, 2)"
_GRID = f"(SELECT icao24, unnest(generate_series(min(b), max(b), INTERVAL 6 HOUR)) b FROM {_BIN} GROUP BY icao24)"
_RES = f"(SELECT g.icao24, g.b, v, et, CASE WHEN v IS NOT NULL THEN epoch_us(g.b) END t FROM {_GRID} g LEFT JOIN {_BIN} x ON g.icao24=x.icao24 AND g.b=x.b)"
_BACK, _AHEAD = "OVER (PARTITION BY icao24 ORDER BY b ROWS UNBOUNDED PRECEDING)", "OVER (PARTITION BY icao24 ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_RES2 = f"(SELECT *, last_value(v IGNORE NULLS) {_BACK} v0, last_value(t IGNORE NULLS) {_BACK} t0, first_value(v IGNORE NULLS) {_AHEAD} v1, first_value(t IGNORE NULLS) {_AHEAD} t1 FROM {_RES})"


@query(f'SELECT icao24, b AS "timestamp", round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0 ELSE v0+(v1-v0)*((epoch_us(b)-t0)/(t1-t0)) END,6) altitude FROM {_RES2}')
def resample_interp(spark, d):
    return resample.resample(points(spark, d), ["icao24"], "6 h", interpolate=("altitude",)).withColumn("altitude", F.round("altitude", 6))


@query(f'SELECT icao24, b AS "timestamp", last_value(et IGNORE NULLS) {_BACK} event_type FROM {_RES}')
def resample_ffill(spark, d):
    return resample.resample(points(spark, d), ["icao24"], "6 h", ffill=("event_type",))


_PN = "(SELECT icao24, min(epoch_us(ts)) a, max(epoch_us(ts)) z FROM p GROUP BY icao24)"
_PG = f"(SELECT icao24, CAST(i AS BIGINT) i, a+CAST(floor((z-a)*i/9) AS BIGINT) t FROM {_PN}, range(10) r(i))"
_PJ = f"(SELECT g.icao24, g.i, g.t, p.altitude, p.event_id, row_number() OVER (PARTITION BY g.icao24, g.i ORDER BY abs(epoch_us(ts)-g.t), ts, event_id) k FROM {_PG} g JOIN p ON g.icao24=p.icao24)"


@query(f'SELECT icao24, i, make_timestamp(t) AS "timestamp", altitude FROM {_PJ} WHERE k=1')
def resample_npoints(spark, d):
    return resample.resample_points(points(spark, d), ["icao24"], 10, "altitude")
