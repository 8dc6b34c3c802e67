"""Aeronautical reference files: AIXM (XML), DDR (text in blocks, semicolons), FAA and FIR GeoJSON, SCAT, all-flight lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cells, codec, geo


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, ignoreNamespace="true", attributePrefix="_", valueTag="_VALUE").schema(schema).load(path)


def _pair(text: Column) -> tuple[Column, Column]:
    p = F.split(F.trim(text), r"\s+")
    return F.get(p, 0).try_cast("double"), F.get(p, 1).try_cast("double")


def aixm_airports(spark: SparkSession, path: str) -> DataFrame:
    """identifier, icao, iata, name, city, type, latitude, longitude, altitude; airports without a code or a place are left out."""
    apt = "name: string, locationIndicatorICAO: string, designatorIATA: string, controlType: string, servedCity: struct<City: struct<name: string>>, ARP: struct<ElevatedPoint: struct<pos: string, elevation: string>>"
    x = _xml(spark, path, "AirportHeliport", f"identifier string, timeSlice struct<AirportHeliportTimeSlice: struct<{apt}>>")
    a = x.select("identifier", "timeSlice.AirportHeliportTimeSlice.*")
    lat, lon = _pair(F.col("ARP.ElevatedPoint.pos"))
    out = a.select(
        "identifier", F.col("locationIndicatorICAO").alias("icao"), F.col("designatorIATA").alias("iata"), "name", F.col("servedCity.City.name").alias("city"), F.col("controlType").alias("type"),
        lat.alias("latitude"), lon.alias("longitude"), F.col("ARP.ElevatedPoint.elevation").try_cast("double").alias("altitude"),
    )
    return out.filter("icao is not null and latitude is not null and longitude is not null and altitude is not null")


def aixm_points(spark: SparkSession, path: str) -> DataFrame:
    """id, name, type, latitude, longitude and roles (with airspace) of designated points."""
    use = "array<struct<PointUsage: struct<role: string, reference_airspace: struct<_href: string>>>>"
    ts = f"designator: string, type: string, name: string, location: struct<Point: struct<pos: string>>, extension: struct<DesignatedPointExtension: struct<pointUsage: {use}>>"
    p = _xml(spark, path, "DesignatedPoint", f"identifier string, timeSlice struct<DesignatedPointTimeSlice: struct<{ts}>>").select("identifier", "timeSlice.DesignatedPointTimeSlice.*")
    lat, lon = _pair(F.col("location.Point.pos"))
    roles = F.transform("extension.DesignatedPointExtension.pointUsage", lambda u: F.struct(u["PointUsage"]["role"].alias("role"), F.substring_index(u["PointUsage"]["reference_airspace"]["_href"], ":", -1).alias("airspace")))
    return p.select(F.col("identifier").alias("id"), F.coalesce("designator", "name").alias("name"), "type", lat.alias("latitude"), lon.alias("longitude"), roles.alias("roles")).filter("latitude is not null")


def free_route_points(points: DataFrame) -> DataFrame:
    """Points of aixm_points() with their roles in free-route airspaces: one row per role."""
    each = points.select("id", "name", "latitude", "longitude", F.inline("roles"))
    return each.filter(F.col("role").startswith("FRA"))


def aixm_routes(spark: SparkSession, routes: str, segments: str) -> tuple[DataFrame, DataFrame]:
    """(routes: identifier, route; segments: route_id, start_id, end_id, lower, upper) of the two files."""
    r = "designatorPrefix: string, designatorSecondLetter: string, designatorNumber: string, multipleIdentifier: string"
    names = _xml(spark, routes, "Route", f"identifier string, timeSlice struct<RouteTimeSlice: struct<{r}>>").select("identifier", "timeSlice.RouteTimeSlice.*")
    parts = ["designatorPrefix", "designatorSecondLetter", "designatorNumber", "multipleIdentifier"]
    end = "struct<EnRouteSegmentPoint: struct<pointChoice_fixDesignatedPoint: struct<_href: string>, pointChoice_navaidSystem: struct<_href: string>>>"
    s = f"lowerLimit: string, upperLimit: string, routeFormed: struct<_href: string>, start: {end}, end: {end}"
    segs = _xml(spark, segments, "RouteSegment", f"identifier string, timeSlice struct<RouteSegmentTimeSlice: struct<{s}>>").select("timeSlice.RouteSegmentTimeSlice.*")
    ref = lambda c: F.substring_index(c, ":", -1)
    point = lambda e: ref(F.coalesce(f"{e}.EnRouteSegmentPoint.pointChoice_fixDesignatedPoint._href", f"{e}.EnRouteSegmentPoint.pointChoice_navaidSystem._href"))
    named = names.select("identifier", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("route"))
    lim = lambda c: F.col(c).try_cast("double")
    return named, segs.select(ref(F.col("routeFormed._href")).alias("route_id"), point("start").alias("start_id"), point("end").alias("end_id"), lim("lowerLimit").alias("lower"), lim("upperLimit").alias("upper"))


def _ranked(s: DataFrame) -> DataFrame:
    """Adds _root (struct a, b), _n (segments before) and _least of segments (route_id, a, b, _up: the segment before or null).

    Pointers are doubled: each round takes every segment twice as far back, so
    their number is the logarithm of the longest route's segments.  Segments of
    a ring keep their _up; _least is the ring's smallest point.
    """
    from ..operators.scratch import discard, materialize

    me = F.struct("a", "b")
    state = materialize(s.select("route_id", "a", "b", "_up", F.when(F.col("_up").isNull(), me).alias("_root"), F.when(F.col("_up").isNull(), 0).otherwise(1).cast("long").alias("_n"), F.col("a").alias("_least")))
    most = state.groupBy("route_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        before = state.select(F.col("route_id").alias("_r"), me.alias("_seg"), F.col("_up").alias("_far"), F.col("_root").alias("_found"), F.col("_n").alias("_more"), F.col("_least").alias("_low"))
        j = state.join(before, (state["route_id"] == before["_r"]) & (state["_up"] == before["_seg"]), "left")
        new = j.select("route_id", "a", "b", F.col("_far").alias("_up"), F.coalesce("_root", "_found").alias("_root"), (F.col("_n") + F.coalesce("_more", F.lit(0))).alias("_n"), F.least("_least", "_low").alias("_least"))
        new = materialize(new)
        discard(state)
        state = new
    return state


def chain(segments: DataFrame, points: DataFrame) -> DataFrame:
    """route_id, stretch, n, id, name, latitude, longitude: the points of each route in the order in which its segments follow each other.

    A stretch goes on through a point where one segment ends and one begins.
    It ends at forks and at meeting points, from where each branch is a stretch
    of its own, so such points come once for each; stretches are numbered by
    their first segments.  A ring starts at its smallest point, which comes
    once.  Repeated segments count once, those without two ends not at all.
    """
    s = segments.select("route_id", F.col("start_id").alias("a"), F.col("end_id").alias("b")).filter("a <> b").distinct()
    into = s.groupBy("route_id", F.col("b").alias("p")).agg(F.count("*").alias("i"), F.max(F.struct("a", "b")).alias("_up"))
    out = s.groupBy("route_id", F.col("a").alias("p")).agg(F.count("*").alias("o"))
    through = into.join(out, ["route_id", "p"]).filter("i = 1 and o = 1").select("route_id", F.col("p").alias("a"), "_up")
    linked = s.join(through, ["route_id", "a"], "left").select("route_id", "a", "b", "_up")
    ranked = _ranked(linked)
    open_ = ranked.filter("_root is not null").select("route_id", "a", "b", "_root", "_n", F.lit(False).alias("_ring"))
    rings = linked.join(ranked.filter("_root is null").select("route_id", "a", "b", "_least"), ["route_id", "a", "b"])
    cut = _ranked(rings.withColumn("_up", F.when(F.col("a") != F.col("_least"), F.col("_up"))).drop("_least"))
    every = open_.unionByName(cut.select("route_id", "a", "b", "_root", "_n", F.lit(True).alias("_ring")))
    w = W.partitionBy("route_id")
    every = every.withColumns({"stretch": (F.dense_rank().over(w.orderBy("_root")) - 1).cast("long"), "_last": F.max("_n").over(W.partitionBy("route_id", "_root"))})
    both = F.array(F.struct(F.col("_n").alias("n"), F.col("a").alias("id")), F.when((F.col("_n") == F.col("_last")) & ~F.col("_ring"), F.struct((F.col("_n") + 1).alias("n"), F.col("b").alias("id"))))
    at = every.select("route_id", "stretch", F.inline(F.array_compact(both)))
    return at.join(points.select("id", "name", "latitude", "longitude"), "id").select("route_id", "stretch", "n", "id", "name", "latitude", "longitude")


def aixm_airspaces(spark: SparkSession, path: str, points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(shapes: identifier, designator, name, type, lower, upper, ring; parts: identifier, lower, upper, component) of airspaces.

    Limits that are no numbers are 0 below and unbounded above.  A ring's
    corners are positions, or points named by reference if ``points`` is given.
    """
    ring = "struct<Surface: struct<patches: struct<PolygonPatch: array<struct<exterior: struct<LinearRing: struct<pos: array<string>, pointProperty: array<struct<_href: string>>>>>>>>>"
    vol = f"upperLimit: string, lowerLimit: string, horizontalProjection: {ring}, contributorAirspace: struct<AirspaceVolumeDependency: struct<theAirspace: struct<_href: string>>>"
    comp = f"array<struct<AirspaceGeometryComponent: struct<theAirspaceVolume: struct<AirspaceVolume: struct<{vol}>>>>>"
    x = _xml(spark, path, "Airspace", f"identifier string, timeSlice array<struct<AirspaceTimeSlice: struct<designator: string, type: string, name: string, geometryComponent: {comp}>>>")
    ts = x.select("identifier", F.explode("timeSlice").alias("t")).select("identifier", "t.AirspaceTimeSlice.*")
    v = ts.select("identifier", "designator", "name", "type", F.explode("geometryComponent").alias("g")).select("identifier", "designator", "name", "type", "g.AirspaceGeometryComponent.theAirspaceVolume.AirspaceVolume.*")
    number = lambda c: F.col(c).try_cast("double")
    v = v.withColumns({"lower": F.when(F.col("lowerLimit").isNotNull(), F.coalesce(number("lowerLimit"), F.lit(0.0))), "upper": number("upperLimit")})
    patch = v.select("identifier", "designator", "name", "type", "lower", "upper", F.monotonically_increasing_id().alias("_v"), F.posexplode("horizontalProjection.Surface.patches.PolygonPatch").alias("_k", "_p"))
    line = F.col("_p.exterior.LinearRing")
    corner = lambda p: F.struct(_pair(p)[1].alias("x"), _pair(p)[0].alias("y"))
    inline = F.transform(line["pos"], corner)
    shapes = patch.withColumn("ring", inline)
    if points is not None:
        refs = patch.select("identifier", "_k", "lower", "upper", F.posexplode(F.transform(line["pointProperty"], lambda r: F.substring_index(r["_href"], ":", -1))).alias("i", "id"))
        at = refs.join(points.select("id", "latitude", "longitude"), "id").groupBy("identifier", "_k", "lower", "upper").agg(F.array_sort(F.collect_list(F.struct("i", F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y")).alias("p")))).alias("_r"))
        at = at.withColumn("_r", F.transform("_r", lambda e: e["p"])).withColumnsRenamed({"identifier": "_i", "_k": "_j", "lower": "_lo", "upper": "_up"})
        same = (F.col("identifier") == F.col("_i")) & (F.col("_k") == F.col("_j")) & F.col("lower").eqNullSafe(F.col("_lo")) & F.col("upper").eqNullSafe(F.col("_up"))
        shapes = shapes.join(at, same, "left").withColumn("ring", F.when(F.size("ring") > 0, F.col("ring")).otherwise(F.col("_r")))
    parts = v.select("identifier", "lower", "upper", F.substring_index("contributorAirspace.AirspaceVolumeDependency.theAirspace._href", ":", -1).alias("component")).filter("component is not null")
    return shapes.select("identifier", "designator", "name", "type", "lower", "upper", "ring"), parts


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, each read whole so that lines keep their order; such files are small."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).filter(F.trim("value") != "")


def are_polygons(lines: DataFrame) -> DataFrame:
    """name and ring of area lines: a header (number of corners, .., name), then latitude and longitude in minutes."""
    from .files import sections

    words = F.split(F.trim("value"), r"\s+")
    s = sections(lines.withColumn("_w", words).withColumn("_head", F.when(F.size("_w") > 2, "head").otherwise("row")), "^head$", "_head")
    name = F.max(F.when(F.col("_head") == "head", F.element_at("_w", -1)))
    corner = F.when(F.col("_head") == "row", F.struct("line", (F.get("_w", 1).try_cast("double") / 60).alias("x"), (F.get("_w", 0).try_cast("double") / 60).alias("y")))
    g = s.groupBy("file", "section").agg(name.alias("name"), F.array_sort(F.collect_list(corner)).alias("_c"))
    return g.select("name", F.transform("_c", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("ring"))


def sls_layers(lines: DataFrame) -> DataFrame:
    """designator, polygon, lower, upper of layer lines; 999 is unbounded."""
    w = F.split(F.trim("value"), r"\s+")
    num = lambda i: F.get(w, i).try_cast("double")
    return lines.select(F.get(w, 0).alias("designator"), F.get(w, 2).alias("polygon"), num(3).alias("lower"), F.when(num(4) < 999, num(4)).alias("upper"))


def spc_composition(lines: DataFrame) -> DataFrame:
    """designator, component, name, type: each airspace (A;code;name;type) with the sectors under it (S;code;type), and each sector with itself."""
    from .files import sections

    w = F.split("value", ";")
    s = sections(lines.withColumns({"_k": F.get(w, 0), "_code": F.get(w, 1), "_a": F.trim(F.get(w, 2)), "_b": F.trim(F.get(w, 3))}), "^A;")
    a = s.filter("_k = 'A'").select("file", "section", F.col("_code").alias("designator"), F.col("_a").alias("name"), F.col("_b").alias("type"))
    parts = s.filter("_k = 'S'").select("file", "section", F.col("_code").alias("component"), F.col("_a").alias("own_type"))
    under = a.join(parts, ["file", "section"]).select("designator", "component", "name", "type")
    own = parts.select(F.col("component").alias("designator"), "component", F.lit(None).cast("string").alias("name"), F.col("own_type").alias("type"))
    return under.unionByName(own)


def ddr_airspaces(areas: DataFrame, layers: DataFrame, composition: DataFrame) -> DataFrame:
    """designator, component, name, type, lower, upper, ring: composition with its layers (left); rows of a sector without a shape go."""
    shaped = layers.join(areas.withColumnRenamed("name", "polygon"), "polygon").select(F.col("designator").alias("component"), "lower", "upper", "ring")
    return composition.join(shaped, "component", "left").filter("designator <> component or ring is not null").select("designator", "component", "name", "type", "lower", "upper", "ring")


def nm_navaids(spark: SparkSession, path: str) -> DataFrame:
    """name, type, latitude, longitude, description of a point file."""
    return spark.read.csv(path, sep=";", header=True, enforceSchema=True, schema="name string, type string, latitude double, longitude double, description string")


def nm_routes(spark: SparkSession, path: str, navaids: DataFrame) -> DataFrame:
    """route, id, navaid, type, latitude, longitude, description of a route file, joined with the points."""
    cols = "_ string, route string, kind string, _1 string, _2 string, navaid string, _3 string, id long"
    r = spark.read.csv(path, sep=";", header=True, enforceSchema=True, schema=cols).select("route", "navaid", "id")
    return r.join(navaids.withColumnRenamed("name", "navaid"), "navaid")


def free_route_lines(lines: DataFrame, navaids: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """fra, type, name, latitude, longitude, airport of free-route lines.

    A line's own coordinates come first, then those that another line of the
    same point has (of the same area first), then those of the points file.
    Points of one name are told apart: with ``areas`` (name, ring of struct
    x, y) only points inside one count, those inside the line's own area
    first; then the nearest to the middle of the area's lines with coordinates
    counts, and last the smallest place.  Lines of airport connections (AD, A,
    D) give a row per airport of four letters.
    """
    w = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    b = lines.select(F.get(w, 0).alias("fra"), F.get(w, 1).alias("type"), F.get(w, 2).alias("name"), F.slice(w, 4, 100).alias("_rest"))
    link = F.col("type").isin("AD", "A", "D")
    lat, lon = codec.ns_pair(F.array_join(F.slice("_rest", 1, 2), ""))
    b = b.withColumns({"_lat": F.when(~link, lat), "_lon": F.when(~link, lon)})
    told = b.filter("_lat is not null")
    place = F.min(F.struct("_lat", "_lon"))
    here = told.groupBy("fra", "name").agg(place.alias("_h"))
    elsewhere = told.groupBy("name").agg(place.alias("_o"))
    # Longitudes are averaged as directions, so that an area across the date line has its middle there.
    x, y = F.avg(F.cos(F.radians("_lon"))), F.avg(F.sin(F.radians("_lon")))
    middle = told.groupBy("fra").agg(F.avg("_lat").alias("m_lat"), F.degrees(F.atan2(y, x)).alias("m_lon"))
    wanted = b.filter("_lat is null").select("fra", "name").distinct().join(middle, "fra", "left")
    found = wanted.join(navaids.select("name", "latitude", "longitude").filter("latitude is not null and longitude is not null"), "name")
    if areas is not None:
        at = found.select("latitude", "longitude").distinct()
        side = lambda f, k: f(F.transform("ring", lambda p: p[k]))
        boxed = areas.select("name", "ring", side(F.array_min, "x").alias("_w"), side(F.array_min, "y").alias("_s"), side(F.array_max, "x").alias("_e"), side(F.array_max, "y").alias("_n"))
        boxed = boxed.withColumn("_area", F.monotonically_increasing_id())
        size = 1.0
        cell = boxed.select("_area", F.explode(cells.box_cells("_w", "_s", "_e", "_n", size)).alias("_cell"))
        met = at.withColumn("_cell", cells.plane_cell("latitude", "longitude", size)).join(cell, "_cell").join(boxed.select("_area", F.col("name").alias("_in"), "ring"), "_area")
        inside = met.filter(geo.in_ring("longitude", "latitude", "ring")).groupBy("latitude", "longitude").agg(F.collect_set("_in").alias("_in"))
        found = found.join(inside, ["latitude", "longitude"])
    else:
        found = found.withColumn("_in", F.array().cast("array<string>"))
    rank = F.struct((~F.array_contains("_in", F.col("fra"))).alias("o"), F.coalesce(geo.distance("latitude", "longitude", "m_lat", "m_lon"), F.lit(0.0)).alias("d"), "latitude", "longitude")
    nav = found.groupBy("fra", "name").agg(F.min(rank).alias("_n"))
    j = b.join(here, ["fra", "name"], "left").join(elsewhere, "name", "left").join(nav, ["fra", "name"], "left")
    airports = F.when(link, F.regexp_extract_all(F.array_join("_rest", ""), F.lit(r"(\w{4})"), 1)).otherwise(F.array(F.lit(None).cast("string")))
    latitude, longitude = F.coalesce("_lat", "_h._lat", "_o._lat", "_n.latitude"), F.coalesce("_lon", "_h._lon", "_o._lon", "_n.longitude")
    return j.select("fra", "type", "name", latitude.alias("latitude"), longitude.alias("longitude"), F.explode(airports).alias("airport")).filter("latitude is not null")


# GeoJSON


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Properties (a DDL of fields), kind and coordinates (as JSON text) of a GeoJSON file's features."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def _ring(coordinates: str = "coordinates") -> Column:
    outer = F.from_json(coordinates, "array<array<array<double>>>")[0]
    return F.transform(F.slice(outer, 1, F.greatest(F.size(outer) - 1, F.lit(0))), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def faa_airspaces(spark: SparkSession, path: str) -> DataFrame:
    """designator, name, type, lower, upper, ring; -9998 is the ground below and unbounded above."""
    f = features(spark, path, "NAME: string, LOWER_VAL: double, UPPER_VAL: double, TYPE_CODE: string, IDENT: string").filter("kind = 'Polygon'")
    lower, upper = F.when(F.col("LOWER_VAL") == -9998, 0.0).otherwise(F.col("LOWER_VAL")), F.when(F.col("UPPER_VAL") != -9998, F.col("UPPER_VAL"))
    return f.select(F.col("IDENT").alias("designator"), F.trim("NAME").alias("name"), F.col("TYPE_CODE").alias("type"), lower.alias("lower"), upper.alias("upper"), _ring().alias("ring"))


def fir_shapes(spark: SparkSession, path: str) -> DataFrame:
    """designator, name, lower, upper, ring of flight information regions; 999 is unbounded."""
    f = features(spark, path, "AV_AIRSPAC: string, AV_NAME: string, MIN_FLIGHT: double, MAX_FLIGHT: double").filter("kind = 'Polygon'")
    upper = F.when(F.col("MAX_FLIGHT") < 999, F.col("MAX_FLIGHT"))
    return f.select(F.col("AV_AIRSPAC").alias("designator"), F.col("AV_NAME").alias("name"), F.col("MIN_FLIGHT").alias("lower"), upper.alias("upper"), _ring().alias("ring"))


# Kinds of navaids by code.
NAV_TYPES = ((1, "NDB"), (2, "DME"), (3, "VOR"), (4, "TACAN"))


def faa_navaids(spark: SparkSession, path: str) -> DataFrame:
    """name, type, latitude, longitude, altitude, frequency, magnetic_variation, description, global_id."""
    f = features(spark, path, "IDENT: string, NAME: string, NAV_TYPE: int, ELEVATION: double, FREQUENCY: double, MAGVAR: double, GLOBAL_ID: string")
    at = F.from_json("coordinates", "array<double>")
    kinds = F.broadcast(spark.createDataFrame(list(NAV_TYPES), "NAV_TYPE int, type string"))  # four rows
    return f.join(kinds, "NAV_TYPE").select(
        F.col("IDENT").alias("name"), "type", at[1].alias("latitude"), at[0].alias("longitude"), F.col("ELEVATION").alias("altitude"), F.col("FREQUENCY").alias("frequency"),
        F.col("MAGVAR").alias("magnetic_variation"), F.col("NAME").alias("description"), F.col("GLOBAL_ID").alias("global_id"),
    )


def faa_points(spark: SparkSession, path: str) -> DataFrame:
    """name, type, latitude, longitude, magnetic_variation, global_id of designated points that have a place."""
    f = features(spark, path, "IDENT: string, TYPE_CODE: string, MAGVAR: double, GLOBAL_ID: string").filter("coordinates is not null")
    at = F.from_json("coordinates", "array<double>")
    return f.select(F.col("IDENT").alias("name"), F.col("TYPE_CODE").alias("type"), at[1].alias("latitude"), at[0].alias("longitude"), F.col("MAGVAR").alias("magnetic_variation"), F.col("GLOBAL_ID").alias("global_id"))


# Flights


def web_json(spark: SparkSession, path: str) -> DataFrame:
    """One flight per JSON file of a tracking site: its track and, where there are any, its EMS rows, in one table."""
    ems = "struct<ts: long, ias: double, tas: double, mach: double, trueTrack: double, rollAngle: double, altGPS: double>"
    point = f"array<struct<latitude: double, longitude: double, altitude: struct<feet: double>, speed: struct<kts: double>, verticalSpeed: struct<fpm: double>, heading: double, timestamp: long, ems: {ems}>>"
    code = "struct<code: struct<icao: string>>"
    flight = f"identification: struct<id: string, callsign: string>, airport: struct<origin: {code}, destination: {code}>, aircraft: struct<identification: struct<modes: string>, model: struct<code: string>>, track: {point}"
    schema = f"result struct<response: struct<data: struct<flight: struct<{flight}>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select("result.response.data.flight.*")
    head = [
        F.col("identification.id").alias("flight_id"), F.col("identification.callsign").alias("callsign"), F.col("airport.origin.code.icao").alias("origin"), F.col("airport.destination.code.icao").alias("destination"),
        F.lower("aircraft.identification.modes").alias("icao24"), F.col("aircraft.model.code").alias("typecode"),
    ]
    p = f.select(*head, F.explode("track").alias("p"))
    names = ["flight_id", "callsign", "origin", "destination", "icao24", "typecode"]
    at = p.select(*names, F.timestamp_seconds("p.timestamp").alias("timestamp"), "p.latitude", "p.longitude", F.col("p.altitude.feet").alias("altitude"), F.col("p.speed.kts").alias("groundspeed"), F.col("p.verticalSpeed.fpm").alias("vertical_rate"), F.col("p.heading").alias("track"))
    e = p.filter("p.ems is not null")
    extra = e.select(*names, F.timestamp_seconds("p.ems.ts").alias("timestamp"), F.col("p.ems.ias").alias("IAS"), F.col("p.ems.tas").alias("TAS"), (F.col("p.ems.mach") / 1000).alias("Mach"), F.col("p.ems.trueTrack").alias("track"), F.col("p.ems.rollAngle").alias("roll"), F.col("p.ems.altGPS").alias("geoaltitude"))
    return at.unionByName(extra, allowMissingColumns=True)


def scat_flights(spark: SparkSession, path: str) -> DataFrame:
    """Positions of surveillance JSON files, one flight each: track and ground speed from the velocity vector, altitude from flight levels."""
    plot = "array<struct<I062_105: struct<lat: double, lon: double>, I062_136: struct<measured_flight_level: double>, I062_185: struct<vx: double, vy: double>, I062_220: struct<rocd: double>, time_of_track: string>>"
    base = "array<struct<adep: string, ades: string, aircraft_type: string, callsign: string>>"
    d = spark.read.schema(f"id string, fpl struct<fpl_base: {base}>, plots {plot}").json(path, multiLine=True)
    b = F.col("fpl.fpl_base")[0]
    p = d.select(F.col("id").alias("flight_id"), b["callsign"].alias("callsign"), b["adep"].alias("origin"), b["ades"].alias("destination"), b["aircraft_type"].alias("typecode"), F.explode("plots").alias("p"))
    vx, vy = F.col("p.I062_185.vx"), F.col("p.I062_185.vy")
    return p.select(
        "flight_id", "callsign", "origin", "destination", "typecode", F.to_timestamp("p.time_of_track").alias("timestamp"), F.col("p.I062_105.lat").alias("latitude"), F.col("p.I062_105.lon").alias("longitude"),
        (100 * F.col("p.I062_136.measured_flight_level")).alias("altitude"), F.col("p.I062_220.rocd").alias("vertical_rate"), F.pmod(90 - F.degrees(F.atan2(vy, vx)), F.lit(360.0)).alias("track"), (F.hypot(vx, vy) / 0.514444).alias("groundspeed"),
    )


def scat_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """name, type, latitude, longitude, description of the fixes of control centres, each once."""
    d = spark.read.schema("name string, points array<struct<name: string, lat: double, lon: double>>").json(path, multiLine=True)
    p = d.select(F.concat(F.lit("Center: "), "name").alias("description"), F.inline("points"))
    return p.select("name", F.lit("FIX").alias("type"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "description").distinct()


def scat_weather(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, latitude, longitude, altitude, temperature, wind_direction, wind_speed of gridded weather files."""
    d = spark.read.schema("alt double, lat double, lon double, temp double, time string, wind_dir double, wind_spd double").json(path, multiLine=True)
    return d.select(F.to_timestamp("time").alias("timestamp"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt").alias("altitude"), F.col("temp").alias("temperature"), F.col("wind_dir").alias("wind_direction"), F.col("wind_spd").alias("wind_speed"))


# Places, counted from 0, of the fields of all-flight lists that are read.
ALLFT = {
    "origin": 0, "destination": 1, "callsign": 2, "operator": 3, "typecode": 4, "AOBT": 5, "ifpsId": 6, "IOBT": 7, "COBT": 16, "EOBT": 17, "arcAddr": 56,
    "ftfmAllFtPointProfile": 85, "rtfmAllFtPointProfile": 99, "ctfmAllFtPointProfile": 113,
}


def all_flights(spark: SparkSession, path: str) -> DataFrame:
    """Flights of a headless list of 181 fields after one line of title: ids, airports, block times (UTC), packed profiles."""
    rows = spark.read.csv(path, sep=";", header=False, schema=", ".join(f"_c{i} string" for i in range(181)))
    rows = rows.filter(F.col("_c1").isNotNull())  # the title has one field
    out = rows.select(*[F.col(f"_c{i}").alias(n) for n, i in ALLFT.items()])
    stamp = lambda c: F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyyMMddHHmmss", "yyyyMMddHHmm")])
    return out.withColumns({c: stamp(c) for c in ("AOBT", "IOBT", "COBT", "EOBT")}).withColumn("icao24", F.lower("arcAddr"))


def find_flight(flights: DataFrame, key: str | tuple[str, str]) -> DataFrame:
    """Flights by plan id, address or call sign, or by (origin, destination)."""
    if isinstance(key, tuple):
        return flights.filter((F.col("origin") == key[0]) & (F.col("destination") == key[1]))
    return flights.filter((F.col("ifpsId") == key) | (F.col("icao24") == key) | (F.col("callsign") == key))


def history(spark: SparkSession, path: str, start, stop, bounds: tuple[float, float, float, float] | None = None, columns: tuple[str, ...] = (), **equal) -> DataFrame:
    """State vectors of a partitioned store in [start, stop): by day and hour, box (west, south, east, north) and equal values or lists.

    The store has partition columns day (date) and hour (hours since 1970, a
    long); both are compared with literals, so files of other hours are not
    opened, and the rest reaches the scan.
    """
    import datetime as dt

    def utc(t):
        t = dt.datetime.fromisoformat(t) if isinstance(t, str) else t
        return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)

    a, z = utc(start), utc(stop)
    rows = spark.read.parquet(path)
    hour = lambda t: int(t.timestamp()) // 3600
    rows = rows.filter(F.col("day").between(F.lit(a.date()), F.lit(z.date())) & F.col("hour").between(hour(a), hour(z)))
    rows = rows.filter((F.col("timestamp") >= F.lit(a.replace(tzinfo=None)).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(z.replace(tzinfo=None)).cast("timestamp_ntz")))
    if bounds is not None:
        west, south, east, north = bounds
        rows = rows.filter(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))
    for c, v in equal.items():
        rows = rows.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return rows.select(*columns) if columns else rows


def history_flights(rows: DataFrame) -> DataFrame:
    """One row per aircraft, call sign and day of state vectors: firstseen and lastseen, with origin and destination where there are any."""
    extra = [F.max(c).alias(c) for c in ("origin", "destination") if c in rows.columns]
    return rows.groupBy("icao24", "callsign", "day").agg(F.min("timestamp").alias("firstseen"), F.max("timestamp").alias("lastseen"), *extra)
