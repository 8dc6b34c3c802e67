"""Queries: clipping, segment choice, plans, Mode S, filters by name, landing and take-off variants, ground networks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import Trajectories
from ..functions import codec, ellipsoid
from ..operators import aggregates, clip, detectors, faults, flightplan, graphs, matching, ml, resample, segments, slicing, splines, windows
from ..sources import aeronautical, files, modes, registers, replies
from ..streaming import flows
from .base import TABLES, beacons, brg, dist, flights, points, query, runs, table

BY = ["flight_id"]
E = "event_id"
H6, H12 = 21600000000, 43200000000


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


# Clipping: boxes as polygons, so that SQL can cut legs by slabs

_ZB = "zb AS (SELECT n_name zone, 1.0013+(n_nationkey%4) w, 2.5017+(n_nationkey%4) e, 43.00031+(n_nationkey%5) s, 44.50037+(n_nationkey%5) n2, CAST((n_nationkey%5)*0.5 AS DOUBLE) lo, CAST((n_nationkey%5)*0.5+1 AS DOUBLE) hi FROM nation)"


def _boxes(spark, d):
    k = F.col("n_nationkey")
    w, e, s, n = 1.0013 + k % 4, 2.5017 + k % 4, 43.00031 + k % 5, 44.50037 + k % 5
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(corner(w, s), corner(e, s), corner(e, n), corner(w, n))
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), ring.alias("ring"), (k % 5 * 0.5).cast("double").alias("lower"), (k % 5 * 0.5 + 1).cast("double").alias("upper"))


def _slab(d, a, lo, hi):
    return f"CASE WHEN {d}>0 THEN ({lo}-{a})/{d} WHEN {d}<0 THEN ({hi}-{a})/{d} WHEN {a}>{lo} AND {a}<{hi} THEN -1e9 ELSE 1e9 END", f"CASE WHEN {d}>0 THEN ({hi}-{a})/{d} WHEN {d}<0 THEN ({lo}-{a})/{d} WHEN {a}>{lo} AND {a}<{hi} THEN 1e9 ELSE -1e9 END"


_XI, _XO = _slab("dx", "x0", "w", "e")
_YI, _YO = _slab("dy", "y0", "s", "n2")
_NEXT = "OVER (PARTITION BY flight_id ORDER BY ts, event_id)"
_PARTS = f"""{_ZB}, lg AS (SELECT *, x1-x0 dx, y1-y0 dy FROM (SELECT flight_id, event_id, longitude x0, latitude y0, altitude z0, epoch_us(ts) t0, lead(longitude) {_NEXT} x1, lead(latitude) {_NEXT} y1, lead(altitude) {_NEXT} z1, lead(epoch_us(ts)) {_NEXT} t1 FROM f) WHERE t1 IS NOT NULL),
pa AS (SELECT *, greatest(0.0, {_XI}, {_YI}) a, least(1.0, {_XO}, {_YO}) b FROM lg, zb),
pt AS (SELECT *, CAST(round_even(t0+(t1-t0)*a, 0) AS BIGINT) ta, CAST(round_even(t0+(t1-t0)*b, 0) AS BIGINT) tb, z0+(z1-z0)*a za, z0+(z1-z0)*b zz FROM pa WHERE a < b),
pm AS (SELECT *, max(tb) OVER (PARTITION BY flight_id, zone ORDER BY ta, tb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) top FROM pt),
pg AS (SELECT *, sum(CASE WHEN top IS NULL OR ta>top THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id, zone ORDER BY ta, tb ROWS UNBOUNDED PRECEDING) g FROM pm),
cx AS (SELECT flight_id, zone, CAST(g-1 AS BIGINT) seg_idx, min(ta) ta, max(tb) tb FROM pg GROUP BY flight_id, zone, g)"""


@query(f"SELECT * FROM (WITH {_PARTS} SELECT flight_id, zone, seg_idx, CAST(ta//10000000 AS BIGINT) start_10s, CAST(tb//10000000 AS BIGINT) stop_10s FROM cx)")
def clip_crossings(spark, d):
    from ..functions.timeunits import us

    c = clip.crossings(flights(spark, d), _boxes(spark, d), BY)
    ten = lambda t, n: F.floor(us(t) / 10_000_000).cast("long").alias(n)
    return c.select("flight_id", "zone", "seg_idx", ten("start", "start_10s"), ten("stop", "stop_10s"))


@query(f"SELECT * FROM (WITH {_PARTS} SELECT f.flight_id, zone, event_id FROM f JOIN cx ON cx.flight_id=f.flight_id AND epoch_us(ts) > ta AND epoch_us(ts) < tb)")
def clip_rows(spark, d):
    return clip.clip(flights(spark, d), _boxes(spark, d), BY).select("flight_id", "zone", E)


@query(f"SELECT * FROM (WITH {_PARTS} SELECT DISTINCT flight_id, zone FROM pt WHERE greatest(za, zz) > 100*lo AND least(za, zz) < 100*hi)")
def intersects_layers(spark, d):
    return clip.intersects(flights(spark, d), _boxes(spark, d), BY)


# Segments

_SEG = runs("p", "icao24", H6)


def _split(spark, d):
    return Trajectories(points(spark, d), ["icao24"]).split("6 h")


@query(f'SELECT * FROM (WITH {_SEG} SELECT icao24, seg_idx, "start", "stop" FROM seg WHERE seg_idx=1)')
def segment_by_index(spark, d):
    return _split(spark, d)[1].segs.select("icao24", "seg_idx", "start", "stop")


@query(f'SELECT * FROM (WITH {_SEG} SELECT icao24, seg_idx, "start" FROM seg WHERE seg_idx >= 1 AND seg_idx < 6 AND (seg_idx-1)%2=0)')
def segment_slice(spark, d):
    return _split(spark, d)[1:6:2].segs.select("icao24", "seg_idx", "start")


@query(f'SELECT * FROM (WITH {_SEG} SELECT icao24, seg_idx, \'next\' which FROM seg WHERE seg_idx=0 UNION ALL SELECT icao24, max(seg_idx), \'final\' FROM seg GROUP BY icao24 UNION ALL SELECT icao24, arg_min(seg_idx, (epoch_us("stop")-epoch_us("start"), seg_idx)), \'min\' FROM seg GROUP BY icao24)')
def segment_ends(spark, d):
    s = _split(spark, d)
    named = lambda x, n: x.segs.select("icao24", "seg_idx", F.lit(n).alias("which"))
    return named(s.next(), "next").unionByName(named(s.final(), "final")).unionByName(named(s.min(), "min"))


@query(f'SELECT * FROM (WITH {_SEG} SELECT a.icao24, coalesce(n, 0) n FROM (SELECT DISTINCT icao24 FROM p) a LEFT JOIN (SELECT icao24, count(*) n FROM seg GROUP BY icao24) b ON a.icao24=b.icao24)')
def segment_count(spark, d):
    return _split(spark, d).sum()


@query(f'SELECT * FROM (WITH {_SEG}, r AS (SELECT p.icao24, seg_idx, max(altitude) m FROM p JOIN seg ON p.icao24=seg.icao24 AND ts BETWEEN "start" AND "stop" GROUP BY p.icao24, seg_idx) SELECT icao24, arg_min(seg_idx, (-m, seg_idx)) seg_idx FROM r GROUP BY icao24)')
def segment_max_feature(spark, d):
    return _split(spark, d).max("altitude_max").segs.select("icao24", "seg_idx")


@query(f'SELECT * FROM (WITH {_SEG} SELECT event_id, p.icao24||\'-\'||lpad(CAST(seg_idx AS VARCHAR),2,\'0\') flight_id FROM p JOIN seg ON p.icao24=seg.icao24 AND ts BETWEEN "start" AND "stop")')
def segment_all_named(spark, d):
    return _split(spark, d).all("{self.icao24}-{i:02d}").df.select(E, "flight_id")


@query(f'SELECT * FROM (WITH {_SEG} SELECT p.icao24, seg_idx index_, max(altitude) altitude_max FROM p JOIN seg ON p.icao24=seg.icao24 AND ts BETWEEN "start" AND "stop" GROUP BY p.icao24, seg_idx)')
def segment_map(spark, d):
    return _split(spark, d).map(lambda t: t.summary("altitude_max"))


@query(f"SELECT icao24, CAST(g AS BIGINT) g, n FROM (SELECT icao24, g, count(*) n FROM (SELECT icao24, CASE WHEN true THEN sum(o) OVER (PARTITION BY icao24 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END g FROM (SELECT icao24, ts, event_id, CASE WHEN epoch_us(ts)-epoch_us(pt) > {H6} AND abs(altitude-pa) > 100 THEN 1 ELSE 0 END o FROM (SELECT *, lag(ts) OVER (PARTITION BY icao24 ORDER BY ts, event_id) pt, lag(altitude) OVER (PARTITION BY icao24 ORDER BY ts, event_id) pa FROM p))) GROUP BY icao24, g) WHERE n >= 2")
def split_condition(spark, d):
    s = segments.split(points(spark, d), ["icao24"], "6 h", lambda before, here: F.abs(here("altitude") - before("altitude")) > 100)
    # Pieces of one row vanish, so a piece is known by the number of cuts before it.
    p = points(spark, d)
    from pyspark.sql import Window as W

    from ..functions.timeunits import us

    w = W.partitionBy("icao24").orderBy("timestamp", E)
    cut = (us("timestamp") - us(F.lag("timestamp").over(w)) > H6) & (F.abs(F.col("altitude") - F.lag("altitude").over(w)) > 100)
    g = p.withColumn("o", F.when(cut, 1).otherwise(0)).withColumn("g", F.sum("o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    starts = g.groupBy("icao24", "g").agg(F.min("timestamp").alias("start"))
    return s.join(starts, ["icao24", "start"]).select("icao24", "g", "n")


# Plans

def _plans(spark, d):
    k = F.col("n_nationkey").cast("string")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    letters = lambda x: F.translate(x, "0123456789", "ABCDEFGHIJ")
    after = ((F.col("n_nationkey") + 3) % 25).cast("string")
    route = text("N0450F340 SIDX1A ", "X", letters(k), " UL", k, " X", letters(after), "/N0460F360 DCT 43N005E STARY2B")
    return table(spark, d, "nation").select("n_nationkey", route.alias("route"))


_KINDS = "(VALUES (0,'speed_level'),(1,'sid'),(2,'point'),(3,'airway'),(4,'speed_level_change'),(5,'direct'),(6,'coordinate'),(7,'star')) t(i, kind)"


@query(f"PLAIN SELECT n_nationkey, CAST(i AS BIGINT) i, kind, CAST(CASE i WHEN 0 THEN 450 WHEN 4 THEN 460 END AS INTEGER) speed, CASE WHEN i=6 THEN 43.0 END latitude FROM nation, {_KINDS}")
def plan_decompose(spark, d):
    return flightplan.tokens(_plans(spark, d), "n_nationkey").select("n_nationkey", "i", "kind", "speed", "latitude")


_LET = "'X'||translate(CAST({} AS VARCHAR),'0123456789','ABCDEFGHIJ')"


@query(
    f"PLAIN WITH w AS (SELECT n_nationkey, i, (n_nationkey+i)%25 m FROM nation, range(4) r(i)) SELECT n_nationkey, CAST(i AS BIGINT) n, {_LET.format('m')} AS name, round(43+m*0.2,6) latitude FROM w "
    "UNION ALL SELECT n_nationkey, 4, '43N005E', 43.0 FROM nation"
)
def plan_points(spark, d):
    b = beacons(spark, d)
    letters = lambda x: F.concat(F.lit("X"), F.translate(x.cast("string"), "0123456789", "ABCDEFGHIJ"))
    k = F.regexp_extract("name", r"(\d+)", 1).cast("int")
    fixes = b.select(letters(k).alias("name"), "latitude", "longitude")
    # Far fixes of the same names: the near ones must win.
    fixes = fixes.unionByName(fixes.select("name", (F.col("latitude") - 80).alias("latitude"), (F.col("longitude") + 100).alias("longitude")))
    n = F.col("n_nationkey")
    routes = table(spark, d, "nation").select(F.concat(F.lit("UL"), n.cast("string")).alias("route"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: letters((n + i) % 25)).alias("points"))
    t = flightplan.tokens(_plans(spark, d), "n_nationkey")
    return flightplan.points(t, "n_nationkey", fixes, routes, True).select("n_nationkey", "n", "name", r6("latitude"))


# Mode S: messages made from events, then read back


def _message(icao, me):
    """A long squitter with the right check sum from an address (hex) and a payload of 56 bits."""
    head = F.concat(F.lit("8D"), icao, F.lpad(F.hex(me.cast("long")), 14, "0"))
    return modes.once(head, lambda h: F.concat(h, F.lpad(F.hex(modes.checksum(F.concat(h, F.lit("000000")))), 6, "0")))


def _bits(*parts):
    me, used = F.lit(0).cast("long"), 0
    for value, n in parts:
        value = F.lit(value) if isinstance(value, int) else value
        used += n
        me = me.bitwiseOR(F.shiftleft(value.cast("long"), 56 - used))
    return me


def _icao(p):
    return p.withColumn("_icao", F.lpad(F.upper(F.hex(F.col("icao24"))), 6, "0"))


@query("SELECT event_id, lpad(lower(printf('%x', icao24)),6,'0') icao24, CAST(event_id%1000 AS DOUBLE)*25-1000 altitude FROM p")
def modes_altitude(spark, d):
    n = F.col(E) % 1000
    height = F.shiftleft(F.shiftright(n, 4), 5).bitwiseOR(F.lit(16).cast("long")).bitwiseOR(n.bitwiseAND(F.lit(15).cast("long")))
    p = _icao(points(spark, d)).withColumn("rawmsg", _message(F.col("_icao"), _bits((11, 5), (0, 3), (height, 12), (0, 1), (0, 1), (F.col(E) % 100, 17), (F.col(E) % 77, 17))))
    return modes.decode(p).select(E, "icao24", "altitude")


_VX, _VY = "((event_id*7)%900-450)", "((event_id*13)%900-450)"


@query(f"SELECT event_id, round(sqrt({_VX}*{_VX}+{_VY}*{_VY}),6) groundspeed, CASE WHEN {_VX}=0 AND {_VY}=0 THEN 0.0 ELSE round(((degrees(atan2(CAST({_VX} AS DOUBLE), CAST({_VY} AS DOUBLE)))%360)+360)%360,6) END track, CAST((event_id%200-100)*64 AS DOUBLE) vertical_rate FROM p")
def modes_velocity(spark, d):
    vx, vy, vr = F.col(E) * 7 % 900 - 450, F.col(E) * 13 % 900 - 450, F.col(E) % 200 - 100
    sign = lambda v: F.when(v < 0, 1).otherwise(0)
    me = _bits((19, 5), (1, 3), (0, 5), (sign(vx), 1), (F.abs(vx) + 1, 10), (sign(vy), 1), (F.abs(vy) + 1, 10), (0, 1), (sign(vr), 1), (F.abs(vr) + 1, 9), (0, 10))
    p = _icao(points(spark, d)).withColumn("rawmsg", _message(F.col("_icao"), me))
    return modes.decode(p).select(E, r6("groundspeed"), F.round(F.col("track") + 0.0, 6).alias("track"), (F.col("vertical_rate") + 0.0).alias("vertical_rate"))


@query("SELECT event_id, true near FROM p")
def modes_position(spark, d):
    # Each report is sent as an even frame and, a second later, as an odd one.
    p = points(spark, d)
    lat, lon = F.col("latitude"), F.col("longitude")
    both = p.select(E, "timestamp", "latitude", "longitude", F.explode(F.array(F.lit(0), F.lit(1))).alias("odd"))
    # Step by step, as each one is read several times.
    d_lat, yz, d_lon, xz = (F.col(c) for c in ("_d_lat", "_yz", "_d_lon", "_xz"))
    steps = both.withColumn("_d_lat", 360.0 / (60 - F.col("odd"))).withColumn("_yz", F.pmod(F.floor(131072 * F.pmod(lat, d_lat) / d_lat + 0.5), F.lit(131072)))
    steps = steps.withColumn("_r_lat", d_lat * (yz / 131072.0 + F.floor(lat / d_lat))).withColumn("_d_lon", 360.0 / F.greatest(F.lit(1), modes.zones(F.col("_r_lat")) - F.col("odd")))
    steps = steps.withColumn("_xz", F.pmod(F.floor(131072 * F.pmod(lon, d_lon) / d_lon + 0.5), F.lit(131072)))
    me = _bits((11, 5), (0, 3), (16, 12), (0, 1), (F.col("odd"), 1), (yz, 17), (xz, 17))
    icao = F.lpad(F.hex(F.col(E)), 6, "0")
    # Exploded, so that the filter on valid messages is not moved below, where it would make each message again.
    sent = steps.select(F.col(E), F.timestamp_add("SECOND", F.col("odd"), "timestamp").alias("timestamp"), "latitude", "longitude", "odd", F.explode(F.array(_message(icao, me))).alias("rawmsg"))
    truth = sent.select(E, "odd", F.col("latitude").alias("lat0"), F.col("longitude").alias("lon0"))
    got = modes.decode(sent.select(E, "odd", "timestamp", "rawmsg")).filter("odd = 1").join(truth.filter("odd = 1").drop("odd"), E)
    near = (F.abs(F.col("latitude") - F.col("lat0")) < 0.0005) & (F.abs(F.col("longitude") - F.col("lon0")) < 0.0005)
    return got.select(E, F.coalesce(near, F.lit(False)).alias("near"))


@query("SELECT event_id, lower(printf('%06x', icao24)) icao24, CASE WHEN event_id%2=0 THEN CAST((event_id%1000)*25-1000 AS DOUBLE) END altitude, CASE WHEN event_id%2=1 THEN lpad(printf('%o', event_id%4096), 4, '0') END squawk FROM p")
def modes_replies(spark, d):
    # Even rows reply with an altitude in steps of 25 feet, odd rows with a squawk.
    n, e = F.col(E) % 1000, F.col(E)
    height = F.shiftleft(F.shiftright(n, 5), 7).bitwiseOR(F.shiftleft(F.shiftright(n, 4).bitwiseAND(F.lit(1).cast("long")), 5)).bitwiseOR(F.lit(16).cast("long")).bitwiseOR(n.bitwiseAND(F.lit(15).cast("long")))
    code = F.lit(0).cast("long")
    for digit, letter in enumerate("ABCD"):
        for bit in (4, 2, 1):
            at = 3 * (3 - digit) + bit // 2
            code = code.bitwiseOR(F.shiftleft(F.shiftright(e % 4096, at).bitwiseAND(F.lit(1).cast("long")), replies.PLACES[f"{letter}{bit}"]))
    head = F.concat(F.when(e % 2 == 0, "2000").otherwise("2800"), F.lpad(F.hex(F.when(e % 2 == 0, height).otherwise(code)), 4, "0"))
    p = points(spark, d).withColumn("_head", head)
    parity = modes.checksum("_head", 4).cast("long").bitwiseXOR(F.col("icao24").cast("long"))
    sent = p.select(E, F.concat("_head", F.lpad(F.hex(parity), 6, "0")).alias("rawmsg"))
    return replies.replies(sent).select(E, "icao24", "altitude", "squawk")


def _long_reply(p, code, me):
    """A long reply (format 20) from the row's address with an altitude code and a payload."""
    head = F.concat(F.lit("A000"), F.lpad(F.hex(code.cast("long")), 4, "0"), F.lpad(F.hex(me), 14, "0"))
    p = p.withColumn("_head", head)
    return p.withColumn("rawmsg", F.concat("_head", F.lpad(F.hex(modes.checksum("_head", 11).cast("long").bitwiseXOR(F.col("icao24").cast("long"))), 6, "0"))).drop("_head")


def _sent_registers(p):
    """Rows as replies: one of a selected altitude, a turn, a heading, or an empty register, by event_id % 4."""
    e = F.col(E)
    two = lambda v, n: F.pmod(v, F.lit(1 << n))
    neg = lambda v: F.when(v < 0, 1).otherwise(0)
    turn = lambda v: (F.floor(v * 512 / 90) % 2048)
    climb = F.floor(F.col("vertical_rate") / 32)
    mcp, qnh = e % 2000 + 60, 2000 + e % 200
    b40 = _bits((1, 1), (mcp, 12), (1, 1), (mcp, 12), (1, 1), (qnh, 12), (0, 8), (0, 1), (0, 3), (0, 2), (0, 1), (0, 2))
    roll, course = e % 60 - 30, turn(F.col("track"))
    b50 = _bits((1, 1), (neg(roll), 1), (two(roll, 9), 9), (1, 1), (F.floor(course / 1024), 1), (course % 1024, 10), (1, 1), (F.floor(F.col("groundspeed") / 2), 10), (0, 1), (0, 1), (0, 9), (1, 1), (F.floor(F.col("groundspeed") / 2) + 5, 10))
    head, ias = turn((F.col("track") + 4) % 360), F.floor(F.col("groundspeed")) - 8
    b60 = _bits((1, 1), (F.floor(head / 1024), 1), (head % 1024, 10), (1, 1), (ias, 10), (1, 1), (F.floor(ias * 100 / 265), 10), (1, 1), (neg(climb), 1), (two(climb, 9), 9), (1, 1), (neg(climb), 1), (two(climb, 9), 9))
    me = F.when(e % 4 == 0, b40).when(e % 4 == 1, b50).when(e % 4 == 2, b60).otherwise(F.lit(0).cast("long"))
    return _long_reply(p, F.lit(0x78), me)  # 0x78: 500 feet, in steps of 25


_TURN = lambda v: f"CAST(floor(({v})*512/90) AS BIGINT)%2048*(90/512.0)"


@query(f"""SELECT event_id, CASE event_id%4 WHEN 0 THEN '40' WHEN 1 THEN '50' WHEN 2 THEN '60' END bds,
CASE WHEN event_id%4=0 THEN CAST((event_id%2000+60)*16 AS DOUBLE) END selected_mcp, CASE WHEN event_id%4=0 THEN round(800+(2000+event_id%200)/10.0,6) END barometric_setting,
CASE WHEN event_id%4=1 THEN CAST(event_id%60-30 AS DOUBLE)*45/256 END roll, CASE WHEN event_id%4=1 THEN {_TURN('track')} END true_track, CASE WHEN event_id%4=1 THEN 2*floor(groundspeed/2) END ground_speed,
CASE WHEN event_id%4=1 THEN 2*floor(groundspeed/2)+10 END TAS, CASE WHEN event_id%4=2 THEN {_TURN('(track+4)%360')} END heading, CASE WHEN event_id%4=2 THEN groundspeed-8 END IAS,
CASE WHEN event_id%4=2 THEN round(floor((groundspeed-8)*100/265)*0.004,6) END Mach, CASE WHEN event_id%4=2 THEN floor(vertical_rate/32)*32 END vrate_barometric FROM p""")
def modes_registers(spark, d):
    # The state is each aircraft's own report; the replies have no register in them that names itself.
    p = points(spark, d)
    sent = _sent_registers(p).select(E, "timestamp", "rawmsg")
    flights = p.select(F.lower(F.lpad(F.hex(F.col("icao24")), 6, "0")).alias("icao24"), "timestamp", "groundspeed", "track", "vertical_rate")
    got = registers.decode(sent, flights)
    return got.select(E, "bds", "selected_mcp", r6("barometric_setting"), "roll", "true_track", "ground_speed", "TAS", "heading", "IAS", r6("Mach"), "vrate_barometric")


# Filters by name, resampling on a map, slices of time


@query()
def filter_default(spark, d):
    return Trajectories(points(spark, d), ["icao24"]).filter(altitude=17, track=(17, 53)).df.select(E, "altitude", "track")


@query()
def filter_aggressive(spark, d):
    p = points(spark, d).select("icao24", E, "timestamp", "altitude", "track")
    return windows.filtered(p, ["icao24"], "aggressive").select(E, "altitude", "track")


@query()
def resample_polynomial(spark, d):
    out = splines.resample_polynomial(points(spark, d), ["icao24"], "6 h", "altitude", order=2)
    return out.select("icao24", "timestamp", r6("altitude"))


@query()
def resample_projected(spark, d):
    out = resample.resample_projected(points(spark, d), ["icao24"], "6 h", 45.0, 3.0, (44.0, 46.0))
    return out.select("icao24", "timestamp", r6("latitude"), r6("longitude"))


@query(f"SELECT flight_id, arg_min(q.name, ({dist('f.latitude', 'f.longitude', 'q.latitude', 'q.longitude')}, q.name)) airport FROM (SELECT flight_id, arg_min(latitude, (ts, event_id)) latitude, arg_min(longitude, (ts, event_id)) longitude FROM f GROUP BY flight_id) f, pts q GROUP BY flight_id")
def takeoff_airport(spark, d):
    return Trajectories(flights(spark, d), BY).infer_airport(beacons(spark, d), method="takeoff").select("flight_id", "airport")


_FB = "(SELECT flight_id, arg_max(latitude, (ts, event_id)) latitude, arg_max(longitude, (ts, event_id)) longitude FROM f GROUP BY flight_id)"
_FD = dist("f.latitude", "f.longitude", "q.latitude", "q.longitude")


@query(f"SELECT event_id FROM f WHERE flight_id IN (SELECT flight_id FROM (SELECT flight_id, arg_min(q.name, ({_FD}, q.name)) a FROM {_FB} f, pts q GROUP BY flight_id) WHERE a='NATION_7')")
def landing_at(spark, d):
    return Trajectories(flights(spark, d), BY).landing_at("NATION_7", beacons(spark, d)).df.select(E)


_TD, _TB = dist("q.latitude", "q.longitude", "f.latitude", "f.longitude"), brg("q.latitude", "q.longitude", "f.latitude", "f.longitude")
_ANG = "least((((tr-bearing)%360)+360)%360, 360-(((tr-bearing)%360)+360)%360)"


@query(
    f"SELECT * FROM (WITH c AS (SELECT * FROM (SELECT f.*, q.name runway, q.bearing, {_TD} dd, abs({_TD}*sin(radians({_TB}-q.bearing))) off FROM f, pts q WHERE altitude < 400 AND vertical_rate > 257 AND groundspeed > 30) WHERE dd <= 100), "
    "e AS (SELECT flight_id, runway, bearing, count(*) n, median(track) tr, avg(off) off FROM c GROUP BY flight_id, runway, bearing HAVING count(*) >= 2), "
    f"t AS (SELECT *, {_ANG} turn FROM e), l AS (SELECT *, min(turn) OVER (PARTITION BY flight_id) least_turn FROM t), "
    'r AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY off, turn, runway) k FROM l WHERE turn <= least_turn + 10) SELECT flight_id, runway, n, round(off,6) "offset" FROM r WHERE k=1)'
)
def takeoff_by_track(spark, d):
    t = detectors.track_takeoffs(flights(spark, d), beacons(spark, d), BY, reach=100, ceiling=400, min_rows=2)
    return t.select("flight_id", "runway", "n", r6("offset"))


_LD, _LB = dist("f.latitude", "f.longitude", "q.latitude", "q.longitude"), brg("f.latitude", "f.longitude", "q.latitude", "q.longitude")
_LEGS = f"""lw AS (SELECT *, sum(CASE WHEN epoch_us(ts)-epoch_us(pt) > {H12} THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) lg0 FROM (SELECT *, lag(ts) OVER (PARTITION BY flight_id ORDER BY ts, event_id) pt FROM f WHERE altitude < 300)),
lk AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY flight_id, lg0) c0 FROM lw) WHERE c0 >= 2),
ap AS (SELECT flight_id, lg0, arg_min(q.name, ({_LD}, q.name)) airport FROM (SELECT flight_id, lg0, arg_min(latitude, (altitude, ts, event_id)) latitude, arg_min(longitude, (altitude, ts, event_id)) longitude FROM lk GROUP BY flight_id, lg0) f, pts q GROUP BY flight_id, lg0),
e AS (SELECT * FROM (SELECT f.*, q.name ILS, q.bearing tb, {_LD} distance, {_LB} bb FROM lk f, pts q) WHERE distance < 500 AND abs(distance*radians(bb-tb)) < 30 AND cos(radians(bb-track)) > 0)"""


@query(f"SELECT * FROM (WITH {_LEGS}, {runs('e', 'flight_id, lg0, ILS', H12, ', min(altitude) amin', 'AND amin < 400', 60000000)} SELECT seg.flight_id, CAST(seg.lg0 AS BIGINT) attempt, airport, ILS, \"start\", \"stop\" FROM seg JOIN ap ON ap.flight_id=seg.flight_id AND ap.lg0=seg.lg0 AND airport=ILS)")
def landing_attempts(spark, d):
    b = beacons(spark, d)
    return detectors.landing_attempts(flights(spark, d), b, b.withColumn("airport", F.col("name")), BY, below=300, gap="12 h", run_gap="12 h", angle=30, min_time="1 min", ceiling=400).select("flight_id", "attempt", "airport", "ILS", "start", "stop")


# Ground networks: a lattice of ways with a known answer


def _ways(spark, d):
    n = F.col("n_nationkey")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return table(spark, d, "nation").select(F.col("n_name").alias("way"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: at(F.floor(n / 5) * 1000 + i * 10, (n % 5) * 100 + i)).alias("points"), (n % 5).alias("row"), F.floor(n / 5).alias("block"))


def _linked(spark, d):
    """Ways of one block are joined at their first corners."""
    w = _ways(spark, d)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    link = w.filter("row < 4").select(F.concat("way", F.lit("-link")).alias("way"), F.array(at(F.col("block") * 1000, F.col("row") * 100), at(F.col("block") * 1000, (F.col("row") + 1) * 100)).alias("points"))
    return w.select("way", "points").unionByName(link)


@query("SELECT 5*count(*) nodes FROM nation GROUP BY n_nationkey//5")
def graph_components(spark, d):
    nodes, edges = graphs.from_ways(_linked(spark, d))
    return graphs.components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).select("nodes")


@query("SELECT CAST(0 AS BIGINT) kind, 5*count(*) n FROM nation UNION ALL SELECT 1, CAST(4*count(*)+count(CASE WHEN n_nationkey%5 < 4 THEN 1 END) AS BIGINT) FROM nation")
def graph_from_ways(spark, d):
    nodes, edges = graphs.from_ways(_linked(spark, d))
    return nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("kind"), "n").unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).cast("long").alias("kind"), "n"))


@query("SELECT event_id, CASE WHEN event_id%200 <= 50 THEN 'NATION_'||CAST(((event_id*7)%5)*5+(event_id%3) AS VARCHAR) END way, CASE WHEN event_id%200 <= 50 THEN CAST(event_id%200 AS DOUBLE) END way_distance FROM p")
def nearest_taxiway(spark, d):
    # Each report is beside the middle of a straight way, at a known distance.
    e = F.col(E)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n = F.col("n_nationkey")
    ways = table(spark, d, "nation").select(F.col("n_name").alias("way"), F.array(at(F.floor(n / 5) * 10000, n % 5 * 1000), at(F.floor(n / 5) * 10000 + 2000, n % 5 * 1000)).alias("points"))
    p = points(spark, d).select(E, ((e * 7 % 5) * 10000 + 1000).cast("double").alias("x"), ((e % 3) * 1000 + e % 200).cast("double").alias("y"))
    return graphs.nearest_edge(p, ways, 50.0).select(E, "way", "way_distance")


# Formats that need no file


@query("SELECT event_id, round((event_id%80)+((event_id*3)%60)/60.0,6) latitude, round(-((event_id%170)+((event_id*7)%60)/60.0),6) longitude FROM p")
def ns_pair(spark, d):
    e = F.col(E)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    lat, lon = codec.ns_pair(F.concat(F.lit("N"), pad(e % 80, 2), pad(e * 3 % 60, 2), F.lit("W"), pad(e % 170, 3), pad(e * 7 % 60, 2)))
    return points(spark, d).select(E, r6(lat, "latitude"), r6(lon, "longitude"))


@query("SELECT event_id, '@'||upper(lpad(printf('%x', (event_id%1000)*12000000),12,'0'))||'8D'||CAST(event_id AS VARCHAR) line FROM p")
def beast_line(spark, d):
    return points(spark, d).select(E, codec.beast_line(F.col(E) % 1000, F.concat(F.lit("8D"), F.col(E).cast("string"))).alias("line"))


_HL = "(SELECT *, CAST(floor(altitude/50) AS BIGINT) lp FROM p)"


@query(f"SELECT event_id, CASE WHEN lp = lag(lp) OVER (PARTITION BY icao24 ORDER BY ts, event_id) THEN NULL ELSE altitude END altitude FROM {_HL}")
def handle_last_position(spark, d):
    p = points(spark, d).withColumn("last_position", F.floor(F.col("altitude") / 50))
    return windows.handle_last_position(p, ["icao24"]).select(E, "altitude")


@query("SELECT lpad(lower(printf('%x', icao24)),6,'0') icao24, ts AS \"timestamp\", round(altitude,6) altitude, CASE WHEN event_id%4=0 THEN true ELSE false END onground FROM p")
def readsb_traces(spark, d):
    p = points(spark, d)
    from ..functions.timeunits import us

    t0 = F.lit(1_700_000_000.0)
    alt = F.when(F.col(E) % 4 == 0, F.lit("ground")).otherwise(F.col("altitude").cast("string"))
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    off = (us("timestamp") / F.lit(1e6) - t0).cast("decimal(20,6)").cast("string")
    row = F.concat(F.lit("["), F.concat_ws(",", text(off), text(F.col("latitude").cast("string")), text(F.col("longitude").cast("string")), text(alt), text(F.lit("400")), text(F.lit("90")), text(F.lit("0")), text(F.lit("64"))), F.lit("]"))
    body = p.select(F.concat(F.lit('{"icao":"'), F.lpad(F.lower(F.hex("icao24")), 6, "0"), F.lit('","timestamp":'), t0.cast("string"), F.lit(',"trace":['), row, F.lit("]}")).alias("value"), "altitude")
    out = files.readsb(body.select("value"))
    # Rows on the ground have no number for their height; the report's own is put back by its time and address.
    own = p.select(F.lpad(F.lower(F.hex("icao24")), 6, "0").alias("icao24"), F.col("timestamp").alias("t"), F.col("altitude").alias("own"))
    both = out.withColumn("t", F.col("timestamp").cast("timestamp_ntz")).join(own, ["icao24", "t"])
    return both.select("icao24", F.col("t").alias("timestamp"), F.round(F.coalesce("altitude", "own"), 6).alias("altitude"), F.coalesce("onground", F.lit(False)).alias("onground"))


@query('SELECT event_id%7 flight_id, event_id snapshot_id, lpad(lower(printf(\'%x\', CAST(event_id%7 AS BIGINT)*4097)),6,\'0\') icao24, CASE WHEN event_id%7 IN (2,5) THEN \'LFBO\' END diverted, CASE WHEN event_id%3=0 THEN CAST(event_id AS DOUBLE) END ias FROM p')
def fr24_archive(spark, d):
    e = F.col(E)
    pos = points(spark, d).select((e % 7).alias("flight_id"), e.alias("snapshot_id"))
    ems = points(spark, d).filter(e % 3 == 0).select((e % 7).alias("flight_id"), e.alias("snapshot_id"), e.cast("double").alias("ias"))
    k = F.col("id")
    meta = spark.range(7).select(k.alias("flight_id"), (k * 4097).alias("aircraft_id"), F.lit("LFPG").alias("schd_to"), F.when(k.isin(2, 5), "LFBO").otherwise("LFPG").alias("real_to"))
    return files.fr24_archive(meta, pos, ems).select("flight_id", "snapshot_id", "icao24", "diverted", "ias")


@query("PLAIN SELECT CAST(n_nationkey AS BIGINT) poly, CAST(4 AS BIGINT) corners, CAST(n_nationkey AS DOUBLE) x0, CAST(n_nationkey+1 AS DOUBLE) y0 FROM nation")
def are_sections(spark, d):
    n = F.col("n_nationkey")
    text = lambda i, j: F.concat_ws(" ", ((n + 1 + j) * 60).cast("string"), ((n + i) * 60).cast("string"))
    parts = F.array(F.concat(F.lit("4 0 0 "), n.cast("string")), text(0, 0), text(1, 0), text(1, 1), text(0, 1))
    lines = table(spark, d, "nation").select(F.lit("one").alias("file"), F.posexplode(parts).alias("i", "value"), n.alias("k")).select("file", (F.col("k") * 10 + F.col("i")).alias("line"), "value")
    a = aeronautical.are_polygons(lines)
    return a.select(F.col("name").cast("long").alias("poly"), F.size("ring").cast("long").alias("corners"), F.col("ring")[0]["x"].alias("x0"), F.col("ring")[0]["y"].alias("y0"))


# Streams, run here as batches: the same functions take a stream


@query("SELECT icao24, make_timestamp(epoch_us(ts)//3600000000*3600000000) bucket, count(*) n, round(avg(altitude),6) altitude_mean, max(altitude) altitude_max FROM p GROUP BY 1, 2")
def stream_buckets(spark, d):
    out = flows.bucket_stats(points(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")), "1 hour")
    return out.select("icao24", F.col("window.start").cast("timestamp_ntz").alias("bucket"), "n", r6("altitude_mean"), "altitude_max")


@query(f"SELECT icao24, min(ts) AS \"start\", max(ts) AS \"stop\", count(*) n FROM (SELECT *, sum(o) OVER (PARTITION BY icao24 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) g FROM (SELECT *, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY icao24 ORDER BY ts, event_id)) > {H6} THEN 1 ELSE 0 END o FROM p)) GROUP BY icao24, g HAVING count(*) >= 2")
def stream_sessions(spark, d):
    out = flows.sessions(points(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp")), "6 hours")
    return out.select("icao24", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


# Wind


@query("SELECT event_id, round(5+2*(longitude-3)-(latitude-45)+altitude/100, 3)+0.0 wind_u FROM p")
def wind_plane(spark, d):
    # A wind that is a plane over the map by making is found again from the rows that know it, and filled in at all rows.
    lat, lon = F.col("latitude"), F.col("longitude")
    p = points(spark, d).withColumn("wind_u", 5 + 2 * (lon - 3) - (lat - 45) + F.col("altitude") / 100).withColumn("all", F.lit(0))
    model = ml.fit_field(p.filter("event_id % 3 <> 0"), ("wind_u",), ("longitude", "latitude", "altitude"), ["all"], ridge=1e-12)
    out = ml.interpolate_field(p.drop("wind_u"), model, ("wind_u",), ("longitude", "latitude", "altitude"), ["all"])
    return out.select(E, (F.round("wind_u", 3) + 0.0).alias("wind_u"))


_WIND_U = "(icao24%3-1)*(longitude-3)*(longitude-3)+2*(longitude-3)*altitude/500-altitude*altitude*CAST(2.000371e-5 AS DOUBLE)+icao24%3"


@query(f"SELECT event_id, round({_WIND_U}, 5)+0.0 wind_u, round(3*(longitude-3)-altitude/100, 5)+0.0 wind_v FROM p")
def wind_field(spark, d):
    # A wind of degree two, another one for each of three regions.
    x, h, region = F.col("longitude") - 3, F.col("altitude"), (F.col("icao24") % 3).alias("region")
    p = points(spark, d).select("*", region).withColumns({"wind_u": (F.col("region") - 1) * x * x + 2 * x * h / 500 - h * h * 2.000371e-5 + F.col("region"), "wind_v": 3 * x - h / 100})
    axes, names = ("longitude", "altitude"), ("wind_u", "wind_v")
    model = ml.fit_field(p.filter("event_id % 2 = 0"), names, axes, ["region"], ridge=1e-12)
    out = ml.interpolate_field(p.drop(*names), model, names, axes, ["region"])
    return out.select(E, *[(F.round(c, 5) + 0.0).alias(c) for c in names])


@query("SELECT icao24, count(DISTINCT event_type) kinds, CASE WHEN count(DISTINCT event_type)=1 THEN max(event_type) END only_kind FROM p GROUP BY icao24")
def unique_values(spark, d):
    return points(spark, d).groupBy("icao24").agg(F.count_distinct("event_type").alias("kinds"), aggregates.unique("event_type").alias("only_kind"))


@query('SELECT icao24, count(*) n FROM p GROUP BY icao24 HAVING epoch_us(max(ts))-epoch_us(min(ts)) < 2592000000000')
def filter_if(spark, d):
    return slicing.shorter_than(points(spark, d), "30 d", ["icao24"]).groupBy("icao24").agg(F.count(F.lit(1)).alias("n"))


# Matching along a network: suppliers as crossings of a grid of streets, flights driving over it


def _streets(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("node"))
    nodes = n.select("node", (F.col("node") % 10 * 100.0 + F.col("node") * 7 % 13).alias("x"), (F.floor(F.col("node") / 10) * 100.0 + F.col("node") * 5 % 11).alias("y"))
    to = lambda k, step, keep: n.filter(keep).select((F.col("node") * 2 + k).alias("edge"), F.col("node").alias("u"), (F.col("node") + step).alias("v"))
    edges = to(0, 1, "node % 10 < 9 AND node * 7 % 11 <> 0").unionByName(to(1, 10, "node * 3 % 13 <> 0"))
    return nodes, edges.join(n.select(F.col("node").alias("v")), "v", "left_semi")


def _drives(spark, d):
    """Flights' rows on a way from crossing to crossing, with noise."""
    i = F.row_number().over(W.partitionBy("flight_id").orderBy("timestamp", E)) - 1
    f = flights(spark, d).select("flight_id", E, "timestamp", (i * 37 + F.col("icao24") * 100).alias("s"))
    along, street = F.col("s") % 900, F.floor(F.col("s") / 900) % 10
    return f.select("flight_id", E, "timestamp", (along + F.col(E) * 53 % 17 - 8 + F.col(E) % 1000 * 0.0013).alias("x"), (street * 100.0 + F.col(E) * 29 % 23 - 11 + F.col(E) % 777 * 0.0017).alias("y"))


_STREETS = """s AS (SELECT CAST(s_suppkey AS BIGINT) node FROM supplier),
nd AS (SELECT node, node%10*CAST(100 AS DOUBLE)+node*7%13 x, CAST(node//10 AS DOUBLE)*100+node*5%11 y FROM s),
e0 AS (SELECT node*2 edge, node u, node+1 v FROM s WHERE node%10<9 AND node*7%11<>0 UNION ALL SELECT node*2+1, node, node+10 FROM s WHERE node*3%13<>0),
ed AS (SELECT edge, u, v, a.x x1, a.y y1, b.x x2, b.y y2, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) len FROM e0 JOIN nd a ON a.node=u JOIN nd b ON b.node=v),
st AS (SELECT u a, v b, len d FROM ed UNION ALL SELECT v, u, len FROM ed),
hops AS (SELECT node a, node b, CAST(0 AS DOUBLE) d, 0 h FROM nd UNION ALL SELECT hops.a, st.b, hops.d+st.d, h+1 FROM hops JOIN st ON st.a=hops.b WHERE hops.d+st.d <= 250 AND h < 4),
nr AS (SELECT a, b, min(d) d FROM hops GROUP BY a, b),
ends AS (SELECT edge, u n, 0 t FROM ed UNION ALL SELECT edge, v, 1 FROM ed),
gap AS (SELECT p.edge e, q.edge f, p.t s, q.t t, nr.d FROM nr JOIN ends p ON p.n=nr.a JOIN ends q ON q.n=nr.b)"""
_DRIVES = """fi AS (SELECT flight_id, event_id, ts, (row_number() OVER (PARTITION BY flight_id ORDER BY ts, event_id)-1)*37+icao24*100 s FROM f),
dr AS (SELECT flight_id, event_id, ts, s%900+event_id*53%17-8+event_id%1000*CAST(0.0013 AS DOUBLE) x, CAST((s//900)%10 AS DOUBLE)*100+event_id*29%23-11+event_id%777*CAST(0.0017 AS DOUBLE) y FROM fi)"""


@query(
    f"PLAIN WITH RECURSIVE {TABLES}, {_STREETS}, {_DRIVES}, "
    "ft AS (SELECT flight_id, event_id, ts, x, y, edge, u, v, x1, y1, x2, y2, len, greatest(0.0, least(1.0, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/(len*len))) t FROM dr, ed WHERE x BETWEEN least(x1,x2)-30 AND greatest(x1,x2)+30 AND y BETWEEN least(y1,y2)-30 AND greatest(y1,y2)+30), "
    "cd AS (SELECT *, t*len f0, (1-t)*len f1, sqrt((x-x1-t*(x2-x1))*(x-x1-t*(x2-x1))+(y-y1-t*(y2-y1))*(y-y1-t*(y2-y1))) away FROM ft), "
    "c AS (SELECT *, dense_rank() OVER (PARTITION BY flight_id ORDER BY ts, event_id) r FROM cd WHERE away <= 30), "
    "w AS (SELECT a.flight_id, b.r, a.edge e, b.edge f, a.edge=b.edge same, abs(a.f0-b.f0) along, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) far, b.event_id, "
    "min(CASE s WHEN 0 THEN a.f0 ELSE a.f1 END + g.d + CASE g.t WHEN 0 THEN b.f0 ELSE b.f1 END) road, any_value(b.away) away "
    "FROM c a JOIN c b ON a.flight_id=b.flight_id AND b.r=a.r+1 LEFT JOIN gap g ON g.e=a.edge AND g.f=b.edge AND a.edge<>b.edge GROUP BY ALL), "
    "m AS (SELECT *, CASE WHEN (CASE WHEN same THEN along ELSE road END) <= 250 THEN CAST(round(1e6*least(25.0, abs((CASE WHEN same THEN along ELSE road END)-far)/20)) AS BIGINT) ELSE 25000000 END mv FROM w), "
    "vt AS (SELECT flight_id, r, edge, CAST(round(1e6*(away/10)*(away/10)/2) AS BIGINT) cost, [{'id': event_id, 'edge': edge}] path FROM c WHERE r=1 UNION ALL "
    "SELECT flight_id, r, edge, cost, path FROM (SELECT m.flight_id, m.r, m.f edge, vt.cost+m.mv+CAST(round(1e6*(m.away/10)*(m.away/10)/2) AS BIGINT) cost, list_append(vt.path, {'id': m.event_id, 'edge': m.f}) path, "
    "row_number() OVER (PARTITION BY m.flight_id, m.f ORDER BY vt.cost+m.mv, m.e) k FROM vt JOIN m ON m.flight_id=vt.flight_id AND m.r=vt.r+1 AND m.e=vt.edge) WHERE k=1), "
    "best AS (SELECT flight_id, arg_min(path, (-r, cost, edge)) path FROM vt GROUP BY flight_id), "
    "got AS (SELECT unnest(path) p FROM best) "
    "SELECT f.event_id, coalesce(got.p.edge, -1) edge, round(cd.f0,6) edge_offset FROM f LEFT JOIN got ON got.p.id=f.event_id LEFT JOIN cd ON cd.event_id=f.event_id AND cd.edge=got.p.edge"
)
def match_edges(spark, d):
    nodes, edges = _streets(spark, d)
    out = matching.match(_drives(spark, d), BY, nodes, edges, reach=30.0, limit=250.0)
    return out.select(E, F.coalesce("edge", F.lit(-1)).alias("edge"), r6("edge_offset"))


@query()
def kalman_on_network(spark, d):
    # Speeds come from the course along the streets; a test compares the filter with plain loops.
    nodes, edges = _streets(spark, d)
    drives = _drives(spark, d).withColumns({"groundspeed": F.lit(20.0), "track": F.lit(90.0)})
    return matching.kalman_network(drives, BY, nodes, edges, reach=60.0).select(E, r6("x"), r6("y"))


@query("SELECT event_id, groundspeed*1000 metres, track FROM p")
def geodesic_roundtrip(spark, d):
    # Each report's course is followed for a kilometre a knot, and the way back is asked for its length and course.
    p = points(spark, d).withColumn("to", ellipsoid.direct("latitude", "longitude", "track", F.col("groundspeed") * 1000))
    p = p.withColumn("line", ellipsoid.inverse("latitude", "longitude", "to.latitude", "to.longitude"))
    return p.select(E, F.round("line.distance", 2).alias("metres"), F.pmod(F.round("line.azimuth", 5), F.lit(360.0)).alias("track"))


# Flights whose function fails


@query("SELECT flight_id, count(*) n, CAST(NULL AS VARCHAR) error, CAST(NULL AS VARCHAR) message FROM f GROUP BY flight_id HAVING count(*) % 5 <> 0 UNION ALL SELECT flight_id, NULL, 'ValueError', 'rows: ' || count(*) FROM f GROUP BY flight_id HAVING count(*) % 5 = 0")
def guarded_flights(spark, d):
    def count(pdf):
        if len(pdf) % 5 == 0:
            raise ValueError(f"rows: {len(pdf)}")
        return pdf.head(1)[BY].assign(n=len(pdf))

    good, bad = faults.guarded(flights(spark, d).select("flight_id", E, "timestamp"), BY, count, "flight_id string, n long")
    return good.unionByName(bad.select(*BY, "error", "message"), allowMissingColumns=True)
