"""Event detectors: each returns segments (key, seg_idx, start, stop, ..)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells, geo
from ..functions.timeunits import micros, us
from .joins import near, small
from .keys import TIME, ordered
from .segments import segments


#: Cells (degrees) in which rows and areas meet.
AREA_CELL = 0.5


def _inside_boxes(df: DataFrame, areas: DataFrame, prefix: str, west, south, east, north) -> DataFrame:
    """Each row with the areas whose box covers its cell, by equal cells; area columns get the prefix."""
    box = cells.box_cells(west, south, east, north, AREA_CELL)
    t = areas.select(*[F.col(c).alias(f"{prefix}{c}") for c in areas.columns], F.explode(box).alias("_cell"))
    return df.withColumn("_cell", cells.plane_cell("latitude", "longitude", AREA_CELL)).join(small(t), "_cell").drop("_cell")


def _ring_box(ring: str) -> tuple:
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")


def beacon_aligned(df: DataFrame, points: DataFrame, by: list[str], precision: float = 1, gap="2 min", min_time="30 s", min_distance: float = 80, wrap: bool = False, reach: float = 500) -> DataFrame:
    """Runs with the track on the bearing to a point within ``reach`` NM: navaid, shift_mean, distance_min."""
    j = near(df, points, "p_", reach)
    j = j.withColumns({"distance": geo.distance("latitude", "longitude", "p_latitude", "p_longitude"), "bearing": geo.bearing("latitude", "longitude", "p_latitude", "p_longitude")})
    off = geo.angle_between("bearing", "track") if wrap else F.abs(F.col("bearing") - F.col("track"))
    j = j.withColumn("shift", off).filter((F.col("shift") < precision) & (F.col("distance") < reach)).withColumn("navaid", F.col("p_name"))
    extra = {"distance_min": F.min("distance"), "shift_mean": F.avg("shift")}
    return segments(j, [*by, "navaid"], gap, min_time, F.col("distance_min") < min_distance, extra)


def ils_rows(df: DataFrame, thresholds: DataFrame, angle: float = 0.1, wrap: bool = False, reach: float = 500) -> DataFrame:
    """Rows on the extended centre line, within ``reach`` NM, of a runway threshold (name, latitude, longitude, bearing): ILS."""
    j = near(df, thresholds, "t_", reach)
    j = j.withColumns({"distance": geo.distance("latitude", "longitude", "t_latitude", "t_longitude"), "bearing": geo.bearing("latitude", "longitude", "t_latitude", "t_longitude")})
    off = F.radians(F.col("bearing") - F.col("t_bearing"))
    if wrap:
        off = F.radians(geo.angle_between("bearing", "t_bearing"))
    ok = (F.col("distance") < reach) & (F.abs(F.col("distance") * off) < angle) & (F.cos(F.radians(F.col("bearing") - F.col("track"))) > 0)
    return j.filter(ok).withColumn("ILS", F.col("t_name"))


def ils_aligned(df: DataFrame, thresholds: DataFrame, by: list[str], angle: float = 0.1, gap="20 s", min_time="1 min", ceiling: float = 5000, field: float = 0.0, wrap: bool = False, reach: float = 500) -> DataFrame:
    """Runs of ils_rows() that come below ``ceiling`` over the field."""
    j = ils_rows(df, thresholds, angle, wrap, reach)
    return segments(j, [*by, "ILS"], gap, min_time, F.col("altitude_min") < field + ceiling, {"altitude_min": F.min("altitude")})


def go_around(landings: DataFrame, climbs: DataFrame, by: list[str]) -> DataFrame:
    """A landing attempt, the next one, and a climb (key, start, stop) that starts between them."""
    w = W.partitionBy(*by).orderBy("start", "ILS")
    pairs = landings.select(*by, "start", "stop", "ILS", F.lead("start").over(w).alias("next_start"), F.lead("ILS").over(w).alias("next_ILS")).filter("next_start is not null")
    c = climbs.select(*by, F.col("start").alias("c_start"))
    same = pairs.join(c, by).filter((F.col("c_start") >= F.col("stop")) & (F.col("c_start") <= F.col("next_start")))
    return same.groupBy(*by, "start", "stop", "ILS", "next_start", "next_ILS").agg(F.min("c_start").alias("climb_start"))


def runway_change(landings: DataFrame, climbs: DataFrame, by: list[str]) -> DataFrame:
    """Consecutive landing runs on different runways without a climb between them."""
    w = W.partitionBy(*by).orderBy("start", "ILS")
    pairs = landings.select(*by, "start", "stop", "ILS", F.lead("start").over(w).alias("next_start"), F.lead("ILS").over(w).alias("next_ILS")).filter("next_start is not null and ILS <> next_ILS")
    c = climbs.select(*[F.col(k).alias(f"c_{k}") for k in by], F.col("start").alias("c_start"))
    same = [F.col(k) == F.col(f"c_{k}") for k in by]
    return pairs.join(c, [*same, F.col("c_start") >= F.col("stop"), F.col("c_start") <= F.col("next_start")], "left_anti")


def zone_runs(df: DataFrame, zones: DataFrame, by: list[str], min_points: int = 3, min_time="5 s") -> DataFrame:
    """Runs of consecutive rows inside a zone (name, west, south, east, north)."""
    n = F.row_number().over(ordered(df, by))
    inside = _inside_boxes(df.withColumn("_n", n), zones, "z_", "west", "south", "east", "north").filter("longitude between z_west and z_east and latitude between z_south and z_north")
    k = W.partitionBy(*by, "z_name").orderBy("_n")
    runs = inside.withColumn("_grp", F.col("_n") - F.row_number().over(k)).groupBy(*by, F.col("z_name").alias("zone"), "_grp")
    out = runs.agg(F.min(TIME).alias("start"), F.max(TIME).alias("stop"), F.count(F.lit(1)).alias("n"))
    return out.filter((F.col("n") >= min_points) & (us("stop") - us("start") >= micros(min_time))).drop("_grp")


def polygon_runs(df: DataFrame, zones: DataFrame, by: list[str], gap="2 min", lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Runs of rows inside polygons (name, ring of struct x, y[, lower, upper in flight levels])."""
    j = _inside_boxes(df, zones, "z_", *_ring_box("ring")).filter(geo.in_ring("longitude", "latitude", "z_ring"))
    if lower and upper:
        j = j.filter((F.col("altitude") > 100 * F.col(f"z_{lower}")) & (F.col("altitude") < 100 * F.col(f"z_{upper}")))
    return segments(j.withColumn("zone", F.col("z_name")), [*by, "zone"], gap)


def takeoff_runs(df: DataFrame, runways: DataFrame, by: list[str], field: float = 0.0, ceiling: float = 2000, min_gs: float = 140, length_nm: float = 3.24, half_width_nm: float = 0.1, opening: float = 5, gap="2 min") -> DataFrame:
    """The longest low run inside the zone that opens from each runway's end (name, latitude, longitude, bearing)."""
    j = near(df.filter(F.col("altitude") < field + ceiling), runways, "r_", length_nm + half_width_nm + length_nm * math.tan(math.radians(opening)))
    d, b = geo.distance("r_latitude", "r_longitude", "latitude", "longitude"), geo.bearing("r_latitude", "r_longitude", "latitude", "longitude")
    a = F.radians(F.pmod(b - F.col("r_bearing") + 180.0, F.lit(360.0)) - 180.0)
    along, across = d * F.cos(a), F.abs(d * F.sin(a))
    j = j.filter((along >= 0) & (along <= length_nm) & (across <= half_width_nm + along * math.tan(math.radians(opening)))).withColumn("runway", F.col("r_name"))
    s = segments(j, [*by, "runway"], gap, None, F.col("gs_max") >= min_gs, {"gs_max": F.max("groundspeed")})
    w = W.partitionBy(*by).orderBy((us("stop") - us("start")).desc(), "runway", "start")
    return s.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def landing_attempts(df: DataFrame, airports: DataFrame, thresholds: DataFrame, by: list[str], below: float = 8000, gap="10 min", run_gap="20 s", **options) -> DataFrame:
    """Runs on the centre line of the airport nearest to the lowest point of each low part (attempt) of a flight: ILS, airport.

    airports: name, latitude, longitude; thresholds also have airport, the name
    of theirs.  ``gap`` parts the low parts of a flight, ``run_gap`` the runs.
    """
    from .joins import closest_point
    from .keys import legs

    low = legs(df.filter(F.col("altitude") < below), by, gap).withColumnRenamed("leg", "attempt")
    part = [*by, "attempt"]
    tie = F.struct("altitude", TIME, *[c for c in ("event_id",) if c in df.columns])
    lowest = low.groupBy(*part).agg(F.min_by("latitude", tie).alias("latitude"), F.min_by("longitude", tie).alias("longitude"))
    near_by = closest_point(lowest, airports, part).select(*[F.col(c).alias(f"_{c}") for c in part], F.col("point").alias("airport"))
    t = thresholds.select(F.struct("airport", "name").alias("name"), "latitude", "longitude", "bearing")
    runs = ils_aligned(low, t, part, gap=run_gap, **options).withColumns({"_apt": F.col("ILS.airport"), "ILS": F.col("ILS.name")})
    same = [F.col(c) == F.col(f"_{c}") for c in part]
    return runs.join(near_by, [*same, F.col("_apt") == F.col("airport")]).select(*part, "airport", "ILS", "seg_idx", "start", "stop", "n", "altitude_min")


def track_takeoffs(df: DataFrame, runways: DataFrame, by: list[str], reach: float = 5, field: float = 0.0, ceiling: float = 2000, min_vr: float = 257, min_gs: float = 30, min_rows: int = 4, parallel: float = 10) -> DataFrame:
    """The runway (name, latitude, longitude, bearing of its start) of each climb out: by the median track, of parallel ones by distance to the line.

    A climb out: at least ``min_rows`` rows within ``reach`` NM of a runway,
    low, climbing and fast.
    """
    j = near(df.filter((F.col("altitude") < field + ceiling) & (F.col("vertical_rate") > min_vr) & (F.col("groundspeed") > min_gs)), runways, "r_", reach)
    d, b = geo.distance("r_latitude", "r_longitude", "latitude", "longitude"), geo.bearing("r_latitude", "r_longitude", "latitude", "longitude")
    j = j.withColumns({"_d": d, "_off": F.abs(d * F.sin(F.radians(b - F.col("r_bearing"))))}).filter(F.col("_d") <= reach)
    each = j.groupBy(*by, F.col("r_name").alias("runway"), F.col("r_bearing").alias("bearing")).agg(
        F.min(TIME).alias("start"), F.max(TIME).alias("stop"), F.count(F.lit(1)).alias("n"), F.median("track").alias("_track"), F.avg("_off").alias("offset")
    )
    turned = each.filter(F.col("n") >= min_rows).withColumn("_turn", geo.angle_between("_track", "bearing"))
    w = W.partitionBy(*by)
    alike = turned.withColumn("_least", F.min("_turn").over(w)).filter(F.col("_turn") <= F.col("_least") + parallel)
    return alike.withColumn("_n", F.row_number().over(w.orderBy("offset", "_turn", "runway"))).filter("_n = 1").select(*by, "runway", "start", "stop", "n", "offset")


def slow_taxi(df: DataFrame, by: list[str], min_duration="60 s", max_diameter: float = 150) -> DataFrame:
    """Runs of at least ``min_duration`` in which each row's last ``min_duration`` stays within ``max_diameter`` metres (diagonal of the box)."""
    span = micros(min_duration)
    w = W.partitionBy(*by).orderBy("_us").rangeBetween(-span, 0)
    wide = lambda c: F.max(c).over(w) - F.min(c).over(w)
    m = df.withColumn("_us", us(TIME)).withColumns({"_h": wide("latitude") * 60 * 1852, "_w": wide("longitude") * 60 * 1852 * F.cos(F.radians("latitude")), "_long": F.col("_us") - F.min("_us").over(W.partitionBy(*by))})
    slow = m.filter((F.hypot("_h", "_w") < max_diameter) & (F.col("_long") >= span))
    return segments(slow.drop("_h", "_w", "_long", "_us"), by, min_duration)


def thermals(df: DataFrame, by: list[str], min_vr: float = 2, min_turn: float = 5, freq="1 min", gap="1 min") -> DataFrame:
    """Climbing turns of gliders: buckets with a high vertical rate and a high median turn."""
    from .aggregates import agg_time
    from .windows import diff, unwrap

    d = diff(unwrap(df, by, "track"), by, track_diff="track_unwrapped")
    b = agg_time(d, by, freq, True, vertical_rate="max", track_diff="median")
    return segments(b.filter((F.col("vertical_rate_max") > min_vr) & (F.abs("track_diff_median") > min_turn)), by, gap)


def phases(df: DataFrame, by: list[str], span="60 s") -> DataFrame:
    """phase of each row (GROUND, CLIMB, DESCENT, CRUISE, LEVEL) by fuzzy membership of means over ``span``.

    Bell and slope functions of altitude, speed and vertical rate; a phase is as
    likely as the least of its memberships.
    """
    half = micros(span) // 2
    w = W.partitionBy(*by).orderBy("_us").rangeBetween(-half, half)
    m = df.withColumn("_us", us(TIME)).withColumns({"_alt": F.avg("altitude").over(w), "_gs": F.avg("groundspeed").over(w), "_vr": F.avg("vertical_rate").over(w)})
    bell = lambda x, c, s: F.exp(-F.pow((F.col(x) - c) / s, 2) / 2)
    low = lambda x, a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (b - F.col(x)) / (b - a)))
    alt_gnd, alt_lo, alt_hi = low("_alt", 0, 200), bell("_alt", 10000, 10000), bell("_alt", 35000, 20000)
    spd_lo, spd_md, spd_hi = bell("_gs", 0, 50), bell("_gs", 300, 100), bell("_gs", 600, 100)
    flat, up, down = bell("_vr", 0, 100), 1 - low("_vr", 10, 1000), low("_vr", -1000, -10)
    rules = {
        "GROUND": F.least(alt_gnd, spd_lo, flat), "CLIMB": F.least(alt_lo, spd_md, up), "DESCENT": F.least(alt_lo, spd_md, down),
        "CRUISE": F.least(alt_hi, spd_hi, flat), "LEVEL": F.least(alt_lo, spd_md, flat),
    }
    best = F.array_max(F.array(*[F.struct(v.alias("m"), F.lit(k).alias("k")) for k, v in rules.items()]))
    return m.withColumn("phase", F.when(best["m"] > 0, best["k"]).otherwise("NA")).drop("_us", "_alt", "_gs", "_vr")


def moving(df: DataFrame, by: list[str], min_gs: float = 2, gap="1 min", min_time="30 s") -> DataFrame:
    """From the first start to the last stop of moving: one segment per flight."""
    s = segments(df.filter(F.col("groundspeed") > min_gs), by, gap, min_time)
    return s.groupBy(*by).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def parking(df: DataFrame, stands: DataFrame, by: list[str], gap="10 min") -> DataFrame:
    """The stand (a polygon) where a flight's longest run inside one lies."""
    s = polygon_runs(df, stands, by, gap)
    w = W.partitionBy(*by).orderBy((us("stop") - us("start")).desc(), "zone", "start")
    return s.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pushback(df: DataFrame, by: list[str], turn: float = 90) -> DataFrame:
    """First time that the track reverses by ``turn`` or more between rows of slow movement."""
    slow = df.filter(F.col("groundspeed").between(0.5, 15))
    d = geo.angle_between("track", F.lag("track").over(ordered(df, by)))
    return slow.withColumn("_d", d).filter(F.col("_d") >= turn).groupBy(*by).agg(F.min(TIME).alias("start"))


def point_merge(df: DataFrame, points: DataFrame, by: list[str], tolerance: float = 0.05, gap="5 s", min_time="90 s", secondary: DataFrame | None = None, precision: float = 2, reach: float = 500) -> DataFrame:
    """Arcs at a constant distance from a point, within ``reach`` NM.

    With ``secondary`` points an arc counts only for a flight that is aligned,
    later, on the point or on one of them.
    """
    j = near(df, points, "p_", reach).withColumn("point", F.col("p_name")).withColumn("distance", geo.distance("latitude", "longitude", "p_latitude", "p_longitude"))
    j = j.filter(F.col("distance") <= reach)
    step = F.abs(F.col("distance") - F.lag("distance").over(ordered(j, [*by, "point"])))
    arcs = segments(j.withColumn("_step", step).filter(F.col("_step") < tolerance), [*by, "point"], gap, min_time, None, {"distance_mean": F.avg("distance")})
    if secondary is None:
        return arcs
    names = ["name", "latitude", "longitude"]
    leaves = beacon_aligned(df, points.select(*names).unionByName(secondary.select(*names)).distinct(), by, precision, min_distance=reach)
    later = leaves.groupBy(*by).agg(F.max("stop").alias("_left"))
    return arcs.join(later, by).filter(F.col("_left") > F.col("start")).drop("_left")


def holding(df: DataFrame, by: list[str], span="6 min", turn: float = 330) -> DataFrame:
    """Runs whose track turns by ``turn`` degrees or more within ``span`` (a rule in place of a trained classifier)."""
    from .windows import unwrap

    u = unwrap(df, by, "track").withColumn("_us", us(TIME))
    w = W.partitionBy(*by).orderBy("_us").rangeBetween(-micros(span), 0)
    turned = F.max("track_unwrapped").over(w) - F.min("track_unwrapped").over(w)
    return segments(u.withColumn("_turn", turned).filter(F.col("_turn") >= turn), by, span)


def infer_flightplan(df: DataFrame, points: DataFrame, by: list[str], **options) -> DataFrame:
    """The point that best explains each stretch of aligned flight.

    Aligned runs that overlap form a group; of the runs within 30 s of a
    group's longest, the one with the least mean deviation is taken.
    """
    s = beacon_aligned(df, points, by, **options)
    order = W.partitionBy(*by).orderBy("start", "stop", "navaid")
    top = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    g = s.withColumn("_open", F.when(top.isNull() | (F.col("start") > top), 1).otherwise(0)).withColumn("_grp", F.sum("_open").over(order.rowsBetween(W.unboundedPreceding, 0)))
    d = us("stop") - us("start")
    near = g.withColumn("_d", d).withColumn("_max", F.max("_d").over(W.partitionBy(*by, "_grp"))).filter(F.col("_d") >= F.col("_max") - 30_000_000)
    best = W.partitionBy(*by, "_grp").orderBy("shift_mean", "navaid")
    return near.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_grp", "_open", "_d", "_max")


def nearest_airport(df: DataFrame, airports: DataFrame, by: list[str], which: str = "landing") -> DataFrame:
    """Airport nearest to each flight's last (or first) position."""
    from .joins import closest_point

    pick = F.max_by if which == "landing" else F.min_by
    tie = F.struct(TIME, *[c for c in ("event_id",) if c in df.columns])
    ends = df.groupBy(*by).agg(pick("latitude", tie).alias("latitude"), pick("longitude", tie).alias("longitude"))
    return closest_point(ends, airports, by).withColumnRenamed("point", "airport")


def predict_straight(df: DataFrame, by: list[str], ahead="5 min", history="20 s") -> DataFrame:
    """Position after ``ahead`` on the last track, at the mean speed and climb of the last ``history``."""
    from .slicing import last

    tail = last(df, history, by)
    tie = F.struct(TIME, *[c for c in ("event_id",) if c in df.columns])
    end = [F.max_by(c, tie).alias(c) for c in ("latitude", "longitude", "altitude", "track")]
    h = micros(ahead) / 3.6e9
    s = tail.groupBy(*by).agg(F.max(TIME).alias(TIME), F.avg("groundspeed").alias("gs"), F.avg("vertical_rate").alias("vr"), *end)
    lat, lon = geo.destination("latitude", "longitude", "track", F.col("gs") * h)
    return s.select(*by, F.timestamp_add("MICROSECOND", F.lit(micros(ahead)), TIME).alias(TIME), lat.alias("latitude"), lon.alias("longitude"), (F.col("altitude") + F.col("vr") * h * 60).alias("altitude"))
