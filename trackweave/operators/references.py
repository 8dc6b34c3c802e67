"""Reference tables: look-ups, runways, named points, routes, aircraft, airspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timeunits import micros, plus
from .joins import small
from .keys import TIME

#: Bits of an address inside one cell of the address ranges.
CELL_BITS = 12
# The range of privacy addresses and the call signs used with them.
PRIVACY = (0xA4D691, 0xA4F946)
PRIVACY_CALLSIGNS = ("DCM", "FFL")


def extent(df: DataFrame, west: float, south: float, east: float, north: float, buffer: float = 0.5) -> DataFrame:
    """Rows inside a box widened by ``buffer`` degrees, edges included."""
    return df.filter(F.col("longitude").between(west - buffer, east + buffer) & F.col("latitude").between(south - buffer, north + buffer))


def search(df: DataFrame, text: str, *cols: str) -> DataFrame:
    """Rows that contain ``text`` in any of the columns, whatever the case."""
    test = F.lit(False)
    for c in cols:
        test = test | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return df.filter(test)


def lookup(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """Rows with ``key`` as one of the codes in the columns, whatever the case."""
    test = F.lit(False)
    for c in cols:
        test = test | F.coalesce(F.upper(F.col(c).cast("string")) == key.upper(), F.lit(False))
    return df.filter(test)


def thresholds(runways: DataFrame, airport: str = "airport_ident") -> DataFrame:
    """Both ends of every runway (le_ and he_ columns): airport, name, latitude, longitude, bearing in (0, 360]."""

    def end(here: str, there: str) -> Column:
        b = geo.bearing(f"{here}_latitude_deg", f"{here}_longitude_deg", f"{there}_latitude_deg", f"{there}_longitude_deg")
        return F.struct(
            F.col(f"{here}_ident").alias("name"), F.col(f"{here}_latitude_deg").alias("latitude"), F.col(f"{here}_longitude_deg").alias("longitude"), F.when(b == 0, 360.0).otherwise(b).alias("bearing")
        )

    return runways.select(F.col(airport).alias("airport"), F.inline(F.array(end("le", "he"), end("he", "le"))))


def best_named(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """One row per name, the first by ``order`` (a priority chain of sources, say)."""
    w = W.partitionBy(name).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def nearest_named(df: DataFrame, name: str, latitude: float, longitude: float, *tie: str) -> DataFrame:
    """Of the points that share a name the one nearest to a position, with its distance."""
    d = geo.distance("latitude", "longitude", F.lit(float(latitude)), F.lit(float(longitude)))
    return best_named(df.withColumn("distance", d), name, "distance", *tie)


def routes(df: DataFrame, route: str, number: str, *cols: str) -> DataFrame:
    """One row per route with its points in the order of ``number``: route, points (structs of ``cols``)."""
    rows = F.array_sort(F.collect_list(F.struct(number, *cols)))
    return df.groupBy(route).agg(F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("points"))


def sub_route(names: Column, start: Column, stop: Column) -> Column:
    """The part of a route (array of names) between two of its points, in that direction; null if one is missing."""
    a, b = F.array_position(names, start).cast("int"), F.array_position(names, stop).cast("int")
    part = F.slice(names, F.least(a, b), F.abs(a - b) + 1)
    return F.when((a > 0) & (b > 0), F.when(a <= b, part).otherwise(F.reverse(part)))


def registered_in(df: DataFrame, ranges: DataFrame, address: str = "icao24") -> DataFrame:
    """Adds country to rows by address; ranges: first, last (both inside) and country, without overlaps.

    Ranges are cut into cells of 2**CELL_BITS addresses, so this is an equal join
    with at most a few ranges in each cell; addresses in no range keep null.
    """
    cell = lambda c: F.shiftright(F.col(c).cast("long"), CELL_BITS)
    r = ranges.select(F.col("first").alias("_first"), F.col("last").alias("_last"), "country").withColumn("_cell", F.explode(F.sequence(cell("_first"), cell("_last"))))
    same = (F.col("_at") == F.col("_cell")) & F.col(address).between(F.col("_first"), F.col("_last"))
    return df.withColumn("_at", cell(address)).join(small(r), same, "left").drop("_at", "_cell", "_first", "_last")


def operator_stats(aircraft: DataFrame, name: str) -> DataFrame:
    """Of one operator's aircraft (address once): typecode, model, count."""
    own = aircraft.filter(F.contains(F.col("operator"), F.lit(name)))
    one = own.groupBy("icao24").agg(F.min(F.struct("typecode", "model")).alias("a")).select("icao24", "a.*")
    return one.groupBy("typecode").agg(F.max("model").alias("model"), F.count("icao24").alias("count"))


def privacy_candidates(df: DataFrame) -> DataFrame:
    """Rows with an address of the privacy range (as a number) and a call sign used with it."""
    prefix = F.substring("callsign", 1, 3).isin(list(PRIVACY_CALLSIGNS))
    return df.filter(F.col("icao24").between(*PRIVACY) & prefix)


# Airspaces: one row per layer, with lower and upper in flight levels; null means unbounded.


def at_level(layers: DataFrame, level: float) -> DataFrame:
    """Layers with lower <= level <= upper."""
    return layers.filter((F.col("lower") <= level) & (F.col("upper") >= level))


def above(layers: DataFrame, level: float) -> DataFrame:
    """Layers that reach ``level`` or higher."""
    return layers.filter(F.col("upper") >= level)


def below(layers: DataFrame, level: float) -> DataFrame:
    """Layers that start at ``level`` or lower."""
    return layers.filter(F.col("lower") <= level)


def slabs(layers: DataFrame, by: list[str], name: str) -> DataFrame:
    """Each airspace cut at all its bounds: lower, upper and the sorted names of the layers in between.

    Neighbouring slabs of the same layers are one.  A layer is compared with the
    bounds of its own airspace only.
    """
    cuts = layers.select(*by, F.explode(F.array("lower", "upper")).alias("_lo")).distinct()
    w = W.partitionBy(*by).orderBy("_lo")
    cuts = cuts.withColumn("_hi", F.lead("_lo").over(w)).filter("_hi is not null")
    inside = cuts.join(layers.hint("merge"), by).filter("lower <= _lo and upper >= _hi")
    each = inside.groupBy(*by, "_lo", "_hi").agg(F.array_sort(F.collect_set(name)).alias("layers"))
    new = F.when((F.lag("layers").over(w) == F.col("layers")) & (F.lag("_hi").over(w) == F.col("_lo")), 0).otherwise(1)
    run = each.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*by, "_run").agg(F.min("_lo").alias("lower"), F.max("_hi").alias("upper"), F.first("layers").alias("layers")).drop("_run")


# Shapes of flights


def bounds(df: DataFrame, by: list[str]) -> DataFrame:
    """west, south, east and north of each flight."""
    return df.groupBy(*by).agg(F.min("longitude").alias("west"), F.min("latitude").alias("south"), F.max("longitude").alias("east"), F.max("latitude").alias("north"))


def follow_plan(df: DataFrame, plan: DataFrame, by: list[str], horizon="15 min") -> DataFrame:
    """Waypoints that each flight reaches within ``horizon``, and when, at its mean speed.

    plan: number, name, latitude, longitude, followed in the order of number from
    the flight's last position; a flight that stands still reaches none.
    """
    tie = F.struct(TIME, *[c for c in ("event_id",) if c in df.columns])
    ends = df.groupBy(*by).agg(F.max(TIME).alias("_t"), F.avg("groundspeed").alias("_gs"), F.max_by("latitude", tie).alias("_lat"), F.max_by("longitude", tie).alias("_lon"))
    w = W.orderBy("number")
    p = plan.select("number", "name", "latitude", "longitude")
    p = p.withColumn("_leg", geo.distance(F.lag("latitude").over(w), F.lag("longitude").over(w), "latitude", "longitude"))
    p = p.withColumn("_along", F.sum(F.coalesce("_leg", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    start = p.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(F.lit(1).alias("_one"), F.col("latitude").alias("_lat0"), F.col("longitude").alias("_lon0"))
    j = ends.withColumn("_one", F.lit(1)).join(F.broadcast(start), "_one")  # one row
    j = j.withColumn("_to_first", geo.distance("_lat", "_lon", "_lat0", "_lon0")).join(small(p.withColumn("_one", F.lit(1))), "_one")
    took = F.floor((F.col("_to_first") + F.col("_along")) / F.col("_gs") * 3.6e9)
    out = j.filter("_gs > 0").withColumn("_took", took).filter(F.col("_took") <= micros(horizon))
    return out.select(*by, "number", "name", "latitude", "longitude", plus("_t", "_took").alias(TIME))
