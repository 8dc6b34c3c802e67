"""Queries: joins, intervals, detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors, intervals, joins, segments
from .base import beacons, brg, dist, flights, points, query, runs, table

BY = ["flight_id"]
E = "event_id"
H6, H12, DAY = 21600000000, 43200000000, 86400000000
H1 = 3600000000


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


# Pairs and points

_X = "SELECT date_trunc('hour', ts) h, latitude, longitude, altitude, icao24 FROM p"


@query(
    f"""SELECT x.h AS "timestamp", x.icao24 icao24_x, y.icao24 icao24_y, round({dist('x.latitude', 'x.longitude', 'y.latitude', 'y.longitude')},6) "lateral", round(abs(x.altitude-y.altitude),6) vertical """
    f"FROM ({_X}) x JOIN ({_X}) y ON x.h=y.h AND y.icao24=x.icao24+1"
)
def pair_distance(spark, d):
    p = points(spark, d).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    j = joins.pair_distance(p.withColumn("pair", F.col("icao24")), p.withColumn("pair", F.col("icao24") - 1), ["timestamp", "pair"])
    return j.select("timestamp", "icao24_x", "icao24_y", r6("lateral"), r6("vertical"))


_LATERAL = dist("x.latitude", "x.longitude", "y.latitude", "y.longitude")
_CPA = f"""(SELECT x.icao24 ax, y.icao24 ay, x.event_id ex, y.event_id ey, x.ts tx, y.ts ty, {_LATERAL} lat_nm, abs(x.altitude-y.altitude) vertical
 FROM p x JOIN p y ON floor(epoch_us(x.ts)/CAST({H1} AS DOUBLE))=floor(epoch_us(y.ts)/CAST({H1} AS DOUBLE)) AND x.icao24<>y.icao24
 WHERE {_LATERAL} <= 40 AND abs(x.altitude-y.altitude) <= 60)"""


@query(f'SELECT ax icao24_x, ay icao24_y, ex event_id_x, ey event_id_y, round(lat_nm,6) "lateral", round(vertical,6) vertical, round(greatest(lat_nm/5, vertical/1000),6) aggregated FROM {_CPA}')
def cpa(spark, d):
    c = joins.cpa_score(joins.closest_approach(points(spark, d), 40, 60, "1 h", keep=["icao24", "event_id"]))
    return c.select("icao24_x", "icao24_y", "event_id_x", "event_id_y", r6("lateral"), r6("vertical"), r6("aggregated"))


@query(f'SELECT ax icao24_x, ay icao24_y, arg_min(ex, (lat_nm, tx, ty, ex, ey)) event_id_x, round(min(lat_nm),6) "lateral" FROM {_CPA} GROUP BY ax, ay')
def cpa_min(spark, d):
    c = joins.closest_pairs(points(spark, d), 40, 60, "1 h")
    return c.select("icao24_x", "icao24_y", "event_id_x", r6("lateral"))


_PD = dist("f.latitude", "f.longitude", "q.latitude", "q.longitude")


@query(f"SELECT flight_id, arg_min(q.name, ({_PD}, q.name)) point, round(min({_PD}),6) distance FROM f, pts q GROUP BY flight_id")
def closest_point(spark, d):
    return joins.closest_point(flights(spark, d), beacons(spark, d), BY).select("flight_id", "point", r6("distance"))


_LAST = "(SELECT flight_id, arg_max(latitude, (ts, event_id)) latitude, arg_max(longitude, (ts, event_id)) longitude FROM f GROUP BY flight_id)"


@query(f"SELECT flight_id, arg_min(q.name, ({_PD}, q.name)) airport, round(min({_PD}),6) distance FROM {_LAST} f, pts q GROUP BY flight_id")
def nearest_airport(spark, d):
    return detectors.nearest_airport(flights(spark, d), beacons(spark, d), BY).select("flight_id", "airport", r6("distance"))


@query(f"SELECT event_id, round({dist('latitude', 'longitude', '43.6', '1.4')},6) distance, round({brg('latitude', 'longitude', '43.6', '1.4')},6) bearing FROM p")
def distance_bearing(spark, d):
    return joins.bearing_to(joins.distance_to(points(spark, d), 43.6, 1.4), 43.6, 1.4).select(E, r6("distance"), r6("bearing"))


@query("PLAIN SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey")
def dimension_left(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.dimension(table(spark, d, "supplier"), n, "s_nationkey").select("s_suppkey", "s_name", "n_name")


_ERR = "SELECT icao24, ts, event_id FROM p WHERE event_type='error'"


@query("SELECT event_id, (SELECT max(q.event_id) FROM p q WHERE q.icao24=p.icao24 AND q.event_type='signup' AND q.ts=(SELECT max(z.ts) FROM p z WHERE z.icao24=p.icao24 AND z.event_type='signup' AND z.ts<=p.ts)) ref_id FROM p WHERE event_type='error'")
def asof_ffill(spark, d):
    p = points(spark, d)
    ref = p.filter("event_type = 'signup'").select("icao24", "timestamp", F.col(E).alias("ref_id"))
    return joins.as_of(p.filter("event_type = 'error'").select("icao24", "timestamp", E), ref, ["icao24"], "ref_id").select(E, "ref_id")


@query("SELECT event_id FROM p JOIN (SELECT icao24 k, min(ts)+INTERVAL 24 HOUR a FROM p GROUP BY icao24) ON icao24=k AND ts >= a")
def index_by_frame(spark, d):
    p = points(spark, d)
    frame = p.groupBy("icao24").agg((F.min("timestamp") + F.expr("interval 24 hours")).alias("start")).withColumn("stop", F.lit(None).cast("timestamp_ntz"))
    return joins.index_by(p, frame, ["icao24"]).select(E)


@query("PLAIN WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey+100 parent, n_nationkey child FROM nation UNION SELECT 200, r_regionkey+100 FROM region), r AS (SELECT parent root, child node FROM e UNION SELECT r.root, e.child FROM r JOIN e ON r.node=e.parent) SELECT CAST(root AS BIGINT) root, CAST(node AS BIGINT) node FROM r WHERE node IN (SELECT n_nationkey FROM nation)")
def recursive_composition(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.select((F.col("n_regionkey") + 100).cast("long").alias("parent"), F.col("n_nationkey").cast("long").alias("child")).unionByName(r.select(F.lit(200).cast("long").alias("parent"), (F.col("r_regionkey") + 100).cast("long").alias("child")))
    return joins.compositions(edges, n.select(F.col("n_nationkey").cast("long").alias("leaf"))).select("root", "node")


# Intervals: two sets per aircraft

_IA = f"SELECT user_id k, ts s, ts + INTERVAL 6 HOUR t FROM events WHERE event_type IN ('view','click')"
_IB = f"SELECT user_id k, ts s, ts + INTERVAL 9 HOUR t FROM events WHERE event_type='error'"


def _con(name: str, src: str) -> str:
    return f"""{name}m AS (SELECT *, max(t) OVER (PARTITION BY k ORDER BY s,t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM ({src})),
{name}g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s>pm THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s,t ROWS UNBOUNDED PRECEDING) gr FROM {name}m),
{name} AS (SELECT k, min(s) s, max(t) t FROM {name}g GROUP BY k, gr)"""


def _iv(spark, d):
    p = points(spark, d)
    a = p.filter("event_type in ('view', 'click')").select("icao24", F.col("timestamp").alias("start"), (F.col("timestamp") + F.expr("interval 6 hours")).alias("stop"))
    b = p.filter("event_type = 'error'").select("icao24", F.col("timestamp").alias("start"), (F.col("timestamp") + F.expr("interval 9 hours")).alias("stop"))
    return a, b


K = ["icao24"]


@query(f'PLAIN WITH {_con("a", _IA)} SELECT k icao24, s AS "start", t AS "stop" FROM a')
def interval_consolidate(spark, d):
    return intervals.consolidate(_iv(spark, d)[0], K)


@query(f'PLAIN WITH {_con("u", f"{_IA} UNION ALL {_IB}")} SELECT k icao24, s AS "start", t AS "stop" FROM u')
def interval_union(spark, d):
    return intervals.union(*_iv(spark, d), K)


@query(f'PLAIN WITH {_con("a", _IA)}, {_con("b", _IB)} SELECT a.k icao24, greatest(a.s,b.s) AS "start", least(a.t,b.t) AS "stop" FROM a JOIN b ON a.k=b.k AND a.s<b.t AND a.t>b.s')
def interval_intersection(spark, d):
    return intervals.intersection(*_iv(spark, d), K)


@query(
    f'PLAIN WITH {_con("a", _IA)}, {_con("b", _IB)}, c AS (SELECT a.k, a.s, a.t, b.s bs, b.t bt FROM a LEFT JOIN b ON a.k=b.k AND a.s<b.t AND a.t>b.s), '
    'e AS (SELECT k, s, t, s x0, min(bs) x1 FROM c GROUP BY k,s,t UNION ALL SELECT k, s, t, bt, lead(bs) OVER (PARTITION BY k,s,t ORDER BY bs) FROM c WHERE bs IS NOT NULL) '
    'SELECT k icao24, x0 AS "start", least(coalesce(x1,t),t) AS "stop" FROM e WHERE x0 < least(coalesce(x1,t),t)'
)
def interval_difference(spark, d):
    return intervals.difference(*_iv(spark, d), K)


@query(f'PLAIN WITH {_con("a", _IA)} SELECT k icao24, CAST(sum(epoch_us(t)-epoch_us(s)) AS BIGINT) duration_us FROM a GROUP BY k')
def total_duration(spark, d):
    return intervals.total_duration(_iv(spark, d)[0], K)


@query(f'PLAIN WITH {_con("a", _IA)}, {_con("b", _IB)} SELECT a.k icao24, a.s AS "start", a.t AS "stop", b.s start_y, b.t stop_y FROM a JOIN b ON a.k=b.k AND a.s<b.t AND a.t>b.s')
def interval_overlap(spark, d):
    a, b = _iv(spark, d)
    return joins.overlap(intervals.consolidate(a, K), intervals.consolidate(b, K), K).select("icao24", "start", "stop", "start_y", "stop_y")


# Detectors

_BD, _BB = dist("f.latitude", "f.longitude", "q.latitude", "q.longitude"), brg("f.latitude", "f.longitude", "q.latitude", "q.longitude")
_AL = f"(SELECT *, abs(bb-track) shift FROM (SELECT f.*, q.name navaid, {_BD} distance, {_BB} bb FROM f, pts q))"
_BEACON = f"WITH e AS (SELECT * FROM {_AL} WHERE shift < 30 AND distance < 500), {runs('e', 'flight_id, navaid', H12, ', min(distance) dmin, avg(shift) smean', 'AND dmin < 150', 30000000)}"


def _aligned(spark, d):
    return detectors.beacon_aligned(flights(spark, d), beacons(spark, d), BY, 30, "12 h", "30 s", 150)


@query(f'SELECT * FROM ({_BEACON} SELECT flight_id, navaid, seg_idx, "start", "stop", n, round(dmin,6) distance_min, round(smean,6) shift_mean FROM seg)')
def beacon_aligned(spark, d):
    return _aligned(spark, d).select("flight_id", "navaid", "seg_idx", "start", "stop", "n", r6("distance_min"), r6("shift_mean"))


@query(
    f'SELECT * FROM ({_BEACON}, m AS (SELECT *, max("stop") OVER (PARTITION BY flight_id ORDER BY "start","stop",navaid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM seg), '
    'gg AS (SELECT *, sum(CASE WHEN pm IS NULL OR "start">pm THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY "start","stop",navaid ROWS UNBOUNDED PRECEDING) gr FROM m), '
    'mx AS (SELECT *, max(epoch_us("stop")-epoch_us("start")) OVER (PARTITION BY flight_id, gr) md FROM gg), '
    'rk AS (SELECT *, row_number() OVER (PARTITION BY flight_id, gr ORDER BY smean, navaid) k FROM mx WHERE epoch_us("stop")-epoch_us("start") >= md-30000000) '
    'SELECT flight_id, navaid, "start", "stop", round(smean,6) shift_mean FROM rk WHERE k=1)'
)
def flightplan_infer(spark, d):
    return detectors.infer_flightplan(flights(spark, d), beacons(spark, d), BY, precision=30, gap="12 h", min_time="30 s", min_distance=150).select("flight_id", "navaid", "start", "stop", r6("shift_mean"))


_IL = f"(SELECT * FROM (SELECT f.*, q.name ILS, q.bearing tb, {_BD} distance, {_BB} bb FROM f, pts q) WHERE abs(distance*radians(bb-tb)) < 30 AND cos(radians(bb-track)) > 0)"
_ILS = f"WITH e AS (SELECT * FROM {_IL}), {runs('e', 'flight_id, ILS', H12, ', min(altitude) amin', 'AND amin < 400', 60000000)}"


def _ils(spark, d):
    return detectors.ils_aligned(flights(spark, d), beacons(spark, d), BY, 30, "12 h", "1 min", 400)


@query(f'SELECT * FROM ({_ILS} SELECT flight_id, ILS, seg_idx, "start", "stop", n, amin altitude_min FROM seg)')
def ils_aligned(spark, d):
    return _ils(spark, d).select("flight_id", "ILS", "seg_idx", "start", "stop", "n", "altitude_min")


_CLIMB = "c AS (SELECT flight_id fi, ts cs FROM f WHERE vertical_rate > 0)"
_PAIR = 'pr AS (SELECT flight_id, ILS, "start", "stop", lead("start") OVER (PARTITION BY flight_id ORDER BY "start", ILS) ns, lead(ILS) OVER (PARTITION BY flight_id ORDER BY "start", ILS) ni FROM seg)'


def _climbs(spark, d):
    return flights(spark, d).filter("vertical_rate > 0").select("flight_id", F.col("timestamp").alias("start"), F.col("timestamp").alias("stop"))


@query(f'SELECT * FROM ({_ILS}, {_CLIMB}, {_PAIR} SELECT flight_id, ILS, "start", ns next_start, ni "next_ILS", min(cs) climb_start FROM pr JOIN c ON fi=flight_id AND cs>="stop" AND cs<=ns GROUP BY flight_id, ILS, "start", "stop", ns, ni)')
def go_around(spark, d):
    return detectors.go_around(_ils(spark, d), _climbs(spark, d), BY).select("flight_id", "ILS", "start", "next_start", "next_ILS", "climb_start")


@query(f'SELECT * FROM ({_ILS}, {_CLIMB}, {_PAIR} SELECT flight_id, ILS, "start", ns next_start, ni "next_ILS" FROM pr WHERE ns IS NOT NULL AND ILS<>ni AND NOT EXISTS (SELECT 1 FROM c WHERE fi=flight_id AND cs>="stop" AND cs<=ns))')
def runway_change(spark, d):
    return detectors.runway_change(_ils(spark, d), _climbs(spark, d), BY).select("flight_id", "ILS", "start", "next_start", "next_ILS")


_ZN = "zn AS (SELECT n_name zone, 1+(n_nationkey%4) w, 2.5+(n_nationkey%4) e, 43.0+(n_nationkey%5) s, 44.5+(n_nationkey%5) n2 FROM nation)"


def _zones(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), (1 + k % 4).cast("double").alias("west"), (2.5 + k % 4).alias("east"), (43.0 + k % 5).alias("south"), (44.5 + k % 5).alias("north"))


@query(
    f'SELECT * FROM (WITH {_ZN}, nn AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY ts, event_id) rn FROM f), ins AS (SELECT nn.*, zone FROM nn JOIN zn ON longitude BETWEEN w AND e AND latitude BETWEEN s AND n2), '
    'gr AS (SELECT *, rn - row_number() OVER (PARTITION BY flight_id, zone ORDER BY rn) gp FROM ins) SELECT flight_id, zone, min(ts) AS "start", max(ts) AS "stop", count(*) n FROM gr GROUP BY flight_id, zone, gp HAVING count(*)>=3 AND epoch_us(max(ts))-epoch_us(min(ts)) >= 5000000)'
)
def runway_runs(spark, d):
    return detectors.zone_runs(flights(spark, d), _zones(spark, d), BY)


@query(f'SELECT * FROM (WITH {_ZN}, e AS (SELECT f.*, zone FROM f JOIN zn ON longitude >= w AND longitude < e AND latitude >= s AND latitude < n2), {runs("e", "flight_id, zone", H12)} SELECT flight_id, zone, seg_idx, "start", "stop", n FROM seg)')
def polygon_runs(spark, d):
    z = _zones(spark, d)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"))
    return detectors.polygon_runs(flights(spark, d), z.select("name", ring.alias("ring")), BY, "12 h").select("flight_id", "zone", "seg_idx", "start", "stop", "n")


_TW = "OVER (PARTITION BY flight_id ORDER BY ts, event_id)"
_TU = f"(SELECT *, track + sum(coalesce(CASE WHEN dd>180 THEN -360*ceil((dd-180)/360) WHEN dd<-180 THEN -360*floor((dd+180)/360) END,0)) OVER (PARTITION BY flight_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) tu FROM (SELECT *, track - lag(track) {_TW} dd FROM f))"
_TD = f"(SELECT *, tu - lag(tu) {_TW} td, make_timestamp(CAST(round_even(epoch_us(ts)/CAST({H6} AS DOUBLE),0) AS BIGINT)*{H6}) b FROM {_TU})"


@query(
    f'SELECT * FROM (WITH e AS (SELECT * FROM (SELECT *, max(vertical_rate) OVER (PARTITION BY flight_id, b) vm, median(td) OVER (PARTITION BY flight_id, b) tm FROM {_TD}) WHERE vm > 2 AND abs(tm) > 5), {runs("e", "flight_id", H6)} SELECT flight_id, seg_idx, "start", "stop", n FROM seg)'
)
def thermals(spark, d):
    return detectors.thermals(flights(spark, d), BY, freq="6 h", gap="6 h").select("flight_id", "seg_idx", "start", "stop", "n")


@query(f'SELECT * FROM (WITH e AS (SELECT * FROM f WHERE groundspeed > 200), {runs("e", "flight_id", H6, min_us=30000000)} SELECT flight_id, min("start") AS "start", max("stop") AS "stop" FROM seg GROUP BY flight_id)')
def start_moving(spark, d):
    return detectors.moving(flights(spark, d), BY, 200, "6 h", "30 s")


@query(f'SELECT * FROM (WITH e AS (SELECT *, CASE WHEN dm <= 180 THEN dm ELSE 360-dm END da FROM (SELECT *, ((track - lag(track) {_TW}) % 360 + 360) % 360 dm FROM f WHERE groundspeed BETWEEN 0.5 AND 300)) SELECT flight_id, min(ts) AS "start" FROM e WHERE da >= 90 GROUP BY flight_id)')
def pushback(spark, d):
    f = flights(spark, d).withColumn("groundspeed", F.col("groundspeed") / 20)
    return detectors.pushback(f, BY)


@query(f'SELECT * FROM (WITH st AS (SELECT f.*, q.name point, {_BD} distance FROM f, pts q), e AS (SELECT * FROM (SELECT *, abs(distance - lag(distance) OVER (PARTITION BY flight_id, point ORDER BY ts, event_id)) sd FROM st) WHERE sd < 40), {runs("e", "flight_id, point", H12, ", avg(distance) dmean", "", 90000000)} SELECT flight_id, point, seg_idx, "start", "stop", n, round(dmean,6) distance_mean FROM seg)')
def point_merge(spark, d):
    return detectors.point_merge(flights(spark, d), beacons(spark, d), BY, 40, "12 h", "90 s").select("flight_id", "point", "seg_idx", "start", "stop", "n", r6("distance_mean"))


_T20 = "(SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY flight_id) z FROM f) WHERE epoch_us(ts) > epoch_us(z)-43200000000)"
_PR = f"(SELECT flight_id, max(ts) t, avg(groundspeed) gs, avg(vertical_rate) vr, arg_max(latitude,(ts,event_id)) la, arg_max(longitude,(ts,event_id)) lo, arg_max(altitude,(ts,event_id)) al, arg_max(track,(ts,event_id)) tr FROM {_T20} GROUP BY flight_id)"
_S = "(gs*(300000000/3.6e9)/(6371000.0/1852.0))"
_OUT = f"asin(sin(radians(la))*cos({_S})+cos(radians(la))*sin({_S})*cos(radians(tr)))"


@query(f"SELECT flight_id, round(degrees({_OUT}),6) latitude, round(al+vr*(300000000/3.6e9)*60,6) altitude FROM {_PR}")
def predict_straight(spark, d):
    return detectors.predict_straight(flights(spark, d), BY, "5 min", "12 h").select("flight_id", r6("latitude"), r6("altitude"))


_PW = "OVER (PARTITION BY flight_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND 21600000000 FOLLOWING)"
_PM = f"(SELECT event_id, avg(altitude) {_PW} a, avg(groundspeed) {_PW} g, avg(vertical_rate) {_PW} v FROM f)"


def _bell(x, c, s):
    return f"exp(-pow(({x} - {c}) / {s}, 2) / 2)"


def _low(x, a, b):
    return f"greatest(0.0, least(1.0, ({b} - {x}) / CAST({b - a} AS DOUBLE)))"


_LO, _MD, _FLAT = _bell("a", 10000, 10000), _bell("g", 300, 100), _bell("v", 0, 100)
_MEMBERS = {
    "GROUND": f"least({_low('a', 0, 200)}, {_bell('g', 0, 50)}, {_FLAT})", "CLIMB": f"least({_LO}, {_MD}, 1 - {_low('v', 10, 1000)})", "DESCENT": f"least({_LO}, {_MD}, {_low('v', -1000, -10)})",
    "CRUISE": f"least({_bell('a', 35000, 20000)}, {_bell('g', 600, 100)}, {_FLAT})", "LEVEL": f"least({_LO}, {_MD}, {_FLAT})",
}
_EACH = " UNION ALL ".join(f"SELECT event_id, {m} m, '{k}' k FROM {_PM}" for k, m in _MEMBERS.items())


@query(f"SELECT event_id, CASE WHEN max(m) > 0 THEN arg_max(k, (m, k)) ELSE 'NA' END phase FROM ({_EACH}) GROUP BY event_id")
def flight_phases(spark, d):
    return detectors.phases(flights(spark, d), BY, "12 h").select(E, "phase")


_RD, _RB = dist("q.latitude", "q.longitude", "f.latitude", "f.longitude"), brg("q.latitude", "q.longitude", "f.latitude", "f.longitude")
_OFF = f"(SELECT f.*, q.name runway, {_RD} dd, radians(((({_RB} - q.bearing + 180) % 360 + 360) % 360) - 180) aa FROM f, pts q WHERE altitude < 500)"


@query(
    f"SELECT * FROM (WITH e AS (SELECT * FROM {_OFF} WHERE dd*cos(aa) BETWEEN 0 AND 60 AND abs(dd*sin(aa)) <= 20 + dd*cos(aa)*tan(radians(5.0))), {runs('e', 'flight_id, runway', H12, ', max(groundspeed) gmax', 'AND gmax >= 140')} "
    'SELECT flight_id, runway, seg_idx, "start", "stop", n, gmax gs_max FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY epoch_us("stop")-epoch_us("start") DESC, runway, "start") k FROM seg) WHERE k = 1)'
)
def takeoff_runway(spark, d):
    return detectors.takeoff_runs(flights(spark, d), beacons(spark, d), BY, ceiling=500, length_nm=60, half_width_nm=20, gap="12 h")


_HW = "OVER (PARTITION BY flight_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)"


@query(f"SELECT * FROM (WITH e AS (SELECT * FROM (SELECT *, max(tu) {_HW} - min(tu) {_HW} turned FROM {_TU}) WHERE turned >= 330), {runs('e', 'flight_id', DAY)} SELECT flight_id, seg_idx, \"start\", \"stop\", n FROM seg)")
def holding_pattern(spark, d):
    return detectors.holding(flights(spark, d), BY, "1 d", 330).select("flight_id", "seg_idx", "start", "stop", "n")


_SEEN = f"(SELECT f.event_id, q.name, {_BD} d, {_BB} b FROM f, pts q WHERE {_BD} <= 200)"
_DME = f"""(SELECT x.event_id, x.name||'_'||y.name pair, least(((x.b-y.b)%360+360)%360, 360-((x.b-y.b)%360+360)%360) an,
 2*sqrt(pow(greatest(0.085, 0.00125*x.d),2)+pow(greatest(0.085, 0.00125*y.d),2)+2*pow(CAST(0.05 AS DOUBLE),2)) e FROM {_SEEN} x JOIN {_SEEN} y ON x.event_id=y.event_id AND x.name<y.name)"""


@query(f'SELECT f.event_id, round(m,6) "NSE", pair "NSE_idx" FROM f LEFT JOIN (SELECT event_id, min(e/sin(radians(an))) m, arg_min(pair, (e/sin(radians(an)), pair)) pair FROM {_DME} WHERE an BETWEEN 30 AND 150 GROUP BY event_id) z ON z.event_id=f.event_id')
def dme_error(spark, d):
    return joins.dme_error(flights(spark, d), beacons(spark, d)).select(E, r6("NSE"), "NSE_idx")


@query(f"SELECT event_id, CAST(i AS BIGINT) index_ FROM (WITH e AS (SELECT * FROM f WHERE altitude > 60), {runs('e', 'flight_id', H6)} SELECT f.event_id, seg_idx i FROM f JOIN seg ON seg.flight_id=f.flight_id AND f.ts BETWEEN \"start\" AND \"stop\")")
def all_segments(spark, d):
    f = flights(spark, d)
    return segments.rows_of(f, segments.segments(f.filter("altitude > 60"), BY, "6 h"), BY).select(E, "index_")
