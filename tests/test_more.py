"""Fixed points, cells, files and models against brute force and hand vectors."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave import Trajectories
from trackweave.functions import cells
from trackweave.operators import clip, graphs, grouped, joins, ml, resample, sets, splines, windows
from trackweave.plans import catalog_more
from trackweave.sources import aeronautical, modes, replies

T0 = dt.datetime(2024, 1, 1, 12)


def nm(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371000 / 1852 * math.asin(min(1, math.sqrt(h)))


def reports(spark, at):
    rows = [(str(i), i, T0, float(y), float(x), 30000.0) for i, (y, x) in enumerate(at)]
    return spark.createDataFrame(rows, "icao24 string, event_id long, timestamp timestamp_ntz, latitude double, longitude double, altitude double")


@pytest.mark.parametrize("lateral", [0.5, 5, 40, 400])
def test_close_pairs_everywhere(spark, lateral):
    """All pairs within a distance are found: across the date line, at the poles and elsewhere."""
    rng = np.random.default_rng(1)
    at = [(10, 179.999), (10, -179.999), (89.9, 0), (89.9, 180), (89.95, -90), (-89.99, 10), (-89.99, -170), (90, 0), (90, 77), (-90, 5), (0, 180), (0, -180), (60, 0), (60, 359.99)]
    for _ in range(60):
        y, x = rng.uniform(-90, 90), rng.uniform(-180, 180)
        at += [(y, x), (min(90, max(-90, y + rng.normal() * lateral / 60)), (x + rng.normal() * lateral / 60 / max(0.05, math.cos(math.radians(y))) + 180) % 360 - 180)]
    want = {(i, j) for i, a in enumerate(at) for j, b in enumerate(at) if i != j and nm(*a, *b) <= lateral}
    got = [(r.event_id_x, r.event_id_y) for r in joins.closest_approach(reports(spark, at), lateral, 1000, "1 h").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_point_by_growing_reach(spark, monkeypatch):
    monkeypatch.setattr(joins, "LISTED", 7)
    rng = np.random.default_rng(2)
    pts = [(f"p{i:02d}", float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(60)]
    at = [(float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for _ in range(80)] + [(pts[3][1], pts[3][2]), (89.9, 10.0)]
    table = spark.createDataFrame(pts, "name string, latitude double, longitude double")
    got = {r.icao24: (r.point, r.distance) for r in joins.closest_point(reports(spark, at), table, ["icao24"]).collect()}
    for i, a in enumerate(at):
        d, name = min((nm(*a, y, x), n) for n, y, x in pts)
        assert got[str(i)][0] == name and math.isclose(got[str(i)][1], d, abs_tol=1e-6)


def test_cells_have_what_is_near(spark):
    rng = np.random.default_rng(3)
    a = [(float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for _ in range(300)]
    rows = []
    for y, x in a:
        b, d = rng.uniform(0, 2 * math.pi), rng.uniform(0, 60 / 60)
        y2 = math.degrees(math.asin(math.sin(math.radians(y)) * math.cos(math.radians(d)) + math.cos(math.radians(y)) * math.sin(math.radians(d)) * math.cos(b)))
        x2 = x + math.degrees(math.atan2(math.sin(b) * math.sin(math.radians(d)) * math.cos(math.radians(y)), math.cos(math.radians(d)) - math.sin(math.radians(y)) * math.sin(math.radians(y2))))
        rows.append((y, x, y2, x2))
    df = spark.createDataFrame(rows, "y double, x double, y2 double, x2 double")
    assert df.filter(~F.array_contains(cells.cells_around("y", "x", 1.0, 60.0), cells.cell("y2", "x2", 1.0))).count() == 0


def test_density_clusters(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([np.column_stack([np.arange(70) * 0.009, np.zeros(70)]), rng.normal(3, 0.02, (30, 2)), rng.uniform(5, 9, (20, 2))])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(p)], "k long, features array<double>")
    got = {r.k: r.cluster for r in ml.dbscan(df, 0.01, 3, "k").collect()}
    near = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) <= 0.01
    core = near.sum(1) >= 3
    label = np.where(core, np.arange(len(p)), -1)
    for _ in range(len(p)):
        for i in np.flatnonzero(core):
            label[i] = min(label[j] for j in np.flatnonzero(near[i] & core))
    for i in np.flatnonzero(~core):
        c = label[near[i] & core]
        label[i] = c.min() if len(c) else -1
    assert [got[i] for i in range(len(p))] == label.tolist() and got[69] == got[1] == got[0]
    line = spark.createDataFrame([(i, [i * 0.001]) for i in range(10)] + [(99, [50.0])], "k long, features array<double>")
    assert sorted(r.cluster for r in ml.dbscan(line, 0.1, 3, "k").collect()) == [-1] + [0] * 10


def test_deep_compositions(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 5)], "parent long, child long")
    got = joins.compositions(edges, spark.createDataFrame([(20,)], "leaf long")).collect()
    assert sorted(r.root for r in got) == list(range(21))


def test_smoother_is_the_least_squares_path():
    """Without rejections the smoothed states minimise all squared errors at once."""
    rng = np.random.default_rng(5)
    n, m = 40, 6
    z = np.cumsum(rng.normal(size=(n, m)), 0)
    got = grouped.kalman(z, smooth=True, reject=1e9)
    f = np.eye(m)
    f[:3, 3:] = np.eye(3)
    frame = pd.DataFrame(z)
    r = (frame - frame.rolling(17, min_periods=1).mean()).var().to_numpy() + 1e-6
    rows, right = [], []

    def add(blocks, value, weight):
        line = np.zeros((m, n * m))
        for k, b in blocks:
            line[:, k * m : (k + 1) * m] = b
        rows.append(weight[:, None] * line)
        right.append(weight * value)

    add([(0, np.eye(m))], z[0], 1 / np.sqrt(10 * r))  # where the filter starts
    for k in range(n):
        add([(k, np.eye(m))], z[k], 1 / np.sqrt(r))
        if k:
            add([(k, np.eye(m)), (k - 1, -f)], np.zeros(m), np.ones(m))
    want = np.linalg.lstsq(np.concatenate(rows), np.concatenate(right), rcond=None)[0].reshape(n, m)
    assert np.allclose(got, want, atol=1e-6)


def test_extended_filter_follows_a_turn():
    rng = np.random.default_rng(6)
    t = np.arange(120.0)
    head, v = 0.3 + 0.01 * t, 200.0
    x, y = np.cumsum(v * np.cos(head)), np.cumsum(v * np.sin(head))
    truth = np.column_stack([x, y, 1000 + 5 * t, head, np.full(120, v), np.full(120, 5.0)])
    noise = rng.normal(size=truth.shape) * [20, 20, 20, 0.1, 3, 3]
    z = truth + noise
    z[50] = [1e6, 1e6, 9e5, 0, 0, 0]  # an outlier
    out = {s: np.abs(grouped.ekf(z, np.ones(120), smooth=s)[10:, :2] - truth[10:, :2]).mean() for s in (False, True)}
    assert out[True] < out[False] < np.abs(np.delete(noise, 50, 0)[:, :2]).mean() * 1.2 and out[True] < 20


def test_draws_have_the_covariance(spark, tmp_path):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(3, 3))
    x = rng.normal(size=(4000, 3)) @ a.T + [1, 2, 3]
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "features array<double>")
    g = ml.Generation.fit(df)
    assert np.allclose(g.cov, np.cov(x.T), atol=1e-6) and np.allclose(g.mean, x.mean(0))
    path = (tmp_path / "model").as_uri()
    g.save(spark, path)
    again = ml.Generation.from_file(spark, path)
    d = np.array([r.features for r in again.sample(spark, 4000, 3).orderBy("sample_id").collect()])
    assert np.allclose(np.cov(d.T), g.cov, atol=0.25 * np.abs(g.cov).max()) and again.sample(spark, 5, 3).collect() == again.sample(spark, 5, 3).collect()
    flights = ml.Generation(np.array([90.0, 90, 360, 360]), np.eye(4) * 1e-9).build(spark, 2, 0.0, 10.0, 600).orderBy("sample_id", "i").collect()
    assert len(flights) == 4 and math.isclose(flights[1].longitude, 10 + 0.99, abs_tol=1e-3)


def test_clusters_and_their_model(spark):
    rows = [(f"f{i}", i, T0 + dt.timedelta(minutes=m), float((i % 2) * 50 + m)) for i in range(12) for m in range(5)]
    df = spark.createDataFrame(rows, "flight_id string, event_id long, timestamp timestamp_ntz, altitude double")
    for method in ("kmeans", "mixture"):
        for scaler in (None, "standard", "minmax"):
            c = Trajectories(df).clustering("altitude", nb_samples=3, method=method, scaler=scaler, k=2).fit(df)
            got = {r.flight_id: r.cluster for r in c.predict(df).collect()}
            assert len({got[f"f{i}"] for i in range(0, 12, 2)}) == 1 and got["f0"] != got["f1"]
    with pytest.raises(ValueError):
        Trajectories(df).clustering("altitude", method="other")
    labels = Trajectories(df).clustering("altitude", nb_samples=3, method="dbscan", eps=0.5, min_samples=3).fit_predict(df).select("cluster").distinct().count()
    assert labels == 2


def test_sample_of_flights(spark):
    df = spark.createDataFrame([(f"f{i}", k) for i in range(30) for k in range(3)], "flight_id string, event_id long")
    a, b = (sorted(r.flight_id for r in sets.sample(df, ["flight_id"], 7, seed).collect()) for seed in (1, 1))
    assert a == b and len(a) == 21 and len(set(a)) == 7


def test_named_filters(spark):
    rng = np.random.default_rng(8)
    n = 150
    y = np.cumsum(rng.normal(size=n)) * 10 + 5000
    y[[30, 31, 90]] += 4000
    rows = [("f", i, T0 + dt.timedelta(seconds=5 * i), float(v), bool(i % 2)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "flight_id string, event_id long, timestamp timestamp_ntz, altitude double, onground boolean")

    def medfilt(v, k):
        p = np.concatenate([np.zeros(k // 2), v, np.zeros(k // 2)])
        return np.array([np.median(p[i : i + k]) for i in range(len(v))])

    m = medfilt(y, 17)
    e = (y - m) ** 2
    want = pd.Series(np.where(e > np.sqrt(medfilt(e, 17)), np.nan, y)).bfill().ffill()
    got = Trajectories(df).filter(altitude=17).df.orderBy("event_id").collect()
    assert np.allclose([r.altitude for r in got], want) and [r.onground for r in got] == [bool(i % 2) for i in range(n)]
    left = Trajectories(df).filter("default", strategy=None, altitude=17).df
    assert left.filter("altitude is null").count() == int((e > np.sqrt(medfilt(e, 17))).sum())
    hard = Trajectories(df).filter("aggressive").df.orderBy("event_id").collect()
    assert len(hard) == n and max(r.altitude for r in hard) < 6000
    with pytest.raises(KeyError):
        windows.filtered(df, ["flight_id"], "other")


def test_resampling_on_a_map(spark):
    rows = [("f", T0, 44.0, 0.0, 100.0), ("f", T0 + dt.timedelta(hours=1), 44.0, 8.0, None), ("f", T0 + dt.timedelta(hours=2), 45.0, 8.0, 300.0)]
    df = spark.createDataFrame(rows, "flight_id string, timestamp timestamp_ntz, latitude double, longitude double, altitude double")
    r = resample.resample_projected(df, ["flight_id"], "30 min", 45.0, 4.0, (44.0, 46.0), ("altitude",)).orderBy("timestamp").collect()
    assert len(r) == 5 and math.isclose(r[2].longitude, 8.0, abs_tol=1e-9) and r[1].latitude > 44.05  # the straight line runs north of the parallel
    s = resample.resample_sparse(df, ["flight_id"], "30 min", "40 min", altitude="interpolate", latitude="ffill").orderBy("timestamp").collect()
    assert [x.altitude for x in s] == [100, 150, None, None, 300] and [x.latitude for x in s] == [44, 44, 44, 44, 45]


def test_squitters(spark):
    rows = [
        ("8D4840D6202CC371C32CE0576098", 0), ("8D40621D58C382D690C8AC2863A7", 0), ("8D40621D58C386435CC412692AD6", 1), ("8D485020994409940838175B284F", 2), ("8D4840D6202CC371C32CE0576099", 3), ("zz", 4), (None, 5),
    ]
    df = spark.createDataFrame([(m, i, T0 + dt.timedelta(seconds=i)) for m, i in rows], "rawmsg string, event_id long, timestamp timestamp_ntz")
    got = {r.rawmsg: r for r in modes.decode(df).collect()}
    assert len(got) == 4
    assert (got[rows[0][0]].callsign, got[rows[0][0]].icao24) == ("KLM1023", "4840d6")
    odd = got[rows[2][0]]
    assert math.isclose(odd.latitude, 52.26578, abs_tol=1e-4) and math.isclose(odd.longitude, 3.93891, abs_tol=1e-4) and odd.altitude == 38000
    v = got[rows[3][0]]
    assert math.isclose(v.groundspeed, 159.20, abs_tol=0.01) and math.isclose(v.track, 182.88, abs_tol=0.01) and v.vertical_rate == -832


def test_clip_by_hand(spark):
    rows = [("f", i, T0 + dt.timedelta(seconds=60 * i), 0.5, float(x), 1000.0 * i) for i, x in enumerate([-1, 1, 3, 5])]
    df = spark.createDataFrame(rows, "flight_id string, event_id long, timestamp timestamp_ntz, latitude double, longitude double, altitude double")
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (4.0, 1.0), (4.0, 0.0), (4.5, 0.0), (4.5, 2.0), (0.0, 2.0)]  # a bridge over x from 2 to 4
    zones = spark.createDataFrame([("z", [{"x": a, "y": b} for a, b in ring], 20.0, 24.0), ("far", [{"x": a + 50, "y": b} for a, b in ring], 0.0, 900.0)], "name string, ring array<struct<x: double, y: double>>, lower double, upper double")
    got = clip.crossings(df, zones, ["flight_id"]).orderBy("start").collect()
    sec = lambda t: (t - T0).total_seconds()
    assert [(r.zone, r.seg_idx, sec(r.start), sec(r.stop)) for r in got] == [("z", 0, 30.0, 90.0), ("z", 1, 150.0, 165.0)]
    assert [r.event_id for r in clip.clip(df, zones, ["flight_id"]).collect()] == [1]
    assert clip.intersects(df, zones, ["flight_id"]).count() == 0  # inside at 500 to 1500 ft and at 2500 to 2750 ft
    assert clip.intersects(df, zones.drop("lower"), ["flight_id"]).count() == 1
    assert len(Trajectories(df).clip_iterate(zones)) == 2


def test_merged_nodes(spark):
    at = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    ways = spark.createDataFrame([("a", at((0, 0), (10, 0))), ("b", at((10.5, 0), (20, 0))), ("c", at((100, 0), (110, 0)))], "way string, points array<struct<x: double, y: double>>")
    nodes, edges = graphs.from_ways(ways)
    assert nodes.count() == 6
    n2, e2 = graphs.merge_nodes(nodes, edges, 1.0)
    assert n2.count() == 5 and e2.count() == 3
    n3, e3 = graphs.largest(n2, e2)
    assert n3.count() == 3 and e3.count() == 2


AIXM = """<?xml version="1.0"?><m:AIXMBasicMessage xmlns:m="u1" xmlns:aixm="u2" xmlns:gml="u3" xmlns:xlink="u4" xmlns:adrext="u5">{}</m:AIXMBasicMessage>"""


def test_aeronautical_xml(spark, tmp_path):
    def write(name, *members):
        (tmp_path / name).write_text(AIXM.format("".join(f"<m:hasMember>{x}</m:hasMember>" for x in members)))
        return str(tmp_path / name)

    airport = lambda i, code: f"<aixm:AirportHeliport><gml:identifier>{i}</gml:identifier><aixm:timeSlice><aixm:AirportHeliportTimeSlice><aixm:name>N</aixm:name>{code}<aixm:servedCity><aixm:City><aixm:name>C</aixm:name></aixm:City></aixm:servedCity><aixm:ARP><aixm:ElevatedPoint><gml:pos>43.6 1.4</gml:pos><aixm:elevation>499</aixm:elevation></aixm:ElevatedPoint></aixm:ARP></aixm:AirportHeliportTimeSlice></aixm:timeSlice></aixm:AirportHeliport>"
    a = aeronautical.aixm_airports(spark, write("a.xml", airport("i1", "<aixm:locationIndicatorICAO>LFBO</aixm:locationIndicatorICAO>"), airport("i2", ""))).collect()
    assert [(r.identifier, r.icao, r.latitude, r.longitude, r.altitude, r.city) for r in a] == [("i1", "LFBO", 43.6, 1.4, 499.0, "C")]
    use = '<aixm:extension><adrext:DesignatedPointExtension><adrext:pointUsage><adrext:PointUsage><adrext:role>FRA_ENTRY</adrext:role><adrext:reference_airspace xlink:href="urn:uuid:z9"/></adrext:PointUsage></adrext:pointUsage></adrext:DesignatedPointExtension></aixm:extension>'
    point = lambda i, y, x: f"<aixm:DesignatedPoint><gml:identifier>{i}</gml:identifier><aixm:timeSlice><aixm:DesignatedPointTimeSlice><aixm:designator>P{i}</aixm:designator><aixm:type>ICAO</aixm:type><aixm:location><aixm:Point><gml:pos>{y} {x}</gml:pos></aixm:Point></aixm:location>{use if i == 'b' else ''}</aixm:DesignatedPointTimeSlice></aixm:timeSlice></aixm:DesignatedPoint>"
    pts = aeronautical.aixm_points(spark, write("p.xml", point("a", 1, 2), point("b", 3, 4), point("c", 5, 6)))
    assert {r.id: (r.name, r.latitude, r.longitude) for r in pts.collect()} == {"a": ("Pa", 1, 2), "b": ("Pb", 3, 4), "c": ("Pc", 5, 6)}
    assert [(r.name, r.role, r.airspace) for r in aeronautical.free_route_points(pts).collect()] == [("Pb", "FRA_ENTRY", "z9")]
    route = "<aixm:Route><gml:identifier>r</gml:identifier><aixm:timeSlice><aixm:RouteTimeSlice><aixm:designatorPrefix>U</aixm:designatorPrefix><aixm:designatorSecondLetter>N</aixm:designatorSecondLetter><aixm:designatorNumber>8</aixm:designatorNumber></aixm:RouteTimeSlice></aixm:timeSlice></aixm:Route>"
    end = lambda tag, i: f'<aixm:{tag}><aixm:EnRouteSegmentPoint><aixm:pointChoice_fixDesignatedPoint xlink:href="urn:uuid:{i}"/></aixm:EnRouteSegmentPoint></aixm:{tag}>'
    seg = lambda a, b: f'<aixm:RouteSegment><gml:identifier>s{a}</gml:identifier><aixm:timeSlice><aixm:RouteSegmentTimeSlice><aixm:lowerLimit>195</aixm:lowerLimit><aixm:upperLimit>UNL</aixm:upperLimit><aixm:routeFormed xlink:href="urn:uuid:r"/>{end("start", a)}{end("end", b)}</aixm:RouteSegmentTimeSlice></aixm:timeSlice></aixm:RouteSegment>'
    names, segs = aeronautical.aixm_routes(spark, write("r.xml", route), write("s.xml", seg("b", "c"), seg("a", "b")))
    assert [(r.identifier, r.route) for r in names.collect()] == [("r", "UN8")]
    assert [(r.n, r.name) for r in aeronautical.chain(segs, pts).orderBy("n").collect()] == [(0, "Pa"), (1, "Pb"), (2, "Pc")]
    surface = "<aixm:horizontalProjection><aixm:Surface><gml:patches><gml:PolygonPatch><gml:exterior><gml:LinearRing>{}</gml:LinearRing></gml:exterior></gml:PolygonPatch></gml:patches></aixm:Surface></aixm:horizontalProjection>"
    dep = '<aixm:contributorAirspace><aixm:AirspaceVolumeDependency><aixm:theAirspace xlink:href="urn:uuid:x1"/></aixm:AirspaceVolumeDependency></aixm:contributorAirspace>'
    space = lambda i, body: f"<aixm:Airspace><gml:identifier>{i}</gml:identifier><aixm:timeSlice><aixm:AirspaceTimeSlice><aixm:type>FIR</aixm:type><aixm:designator>D{i}</aixm:designator><aixm:geometryComponent><aixm:AirspaceGeometryComponent><aixm:theAirspaceVolume><aixm:AirspaceVolume><aixm:upperLimit>UNL</aixm:upperLimit><aixm:lowerLimit>GND</aixm:lowerLimit>{body}</aixm:AirspaceVolume></aixm:theAirspaceVolume></aixm:AirspaceGeometryComponent></aixm:geometryComponent></aixm:AirspaceTimeSlice></aixm:timeSlice></aixm:Airspace>"
    inline, refs = "".join(f"<gml:pos>{p}</gml:pos>" for p in ("1 2", "3 4", "5 9")), "".join(f'<gml:pointProperty xlink:href="urn:uuid:{p}"/>' for p in "abc")
    shapes, parts = aeronautical.aixm_airspaces(spark, write("x.xml", space("x1", surface.format(inline)), space("x2", surface.format(refs)), space("x3", dep)), pts)
    got = {r.identifier: (r.designator, r.lower, r.upper, [(p.x, p.y) for p in r.ring]) for r in shapes.collect()}
    assert got == {"x1": ("Dx1", 0.0, None, [(2, 1), (4, 3), (9, 5)]), "x2": ("Dx2", 0.0, None, [(2, 1), (4, 3), (6, 5)])}
    assert [(r.identifier, r.component) for r in parts.collect()] == [("x3", "x1")]


def test_block_files(spark, tmp_path):
    (tmp_path / "a.are").write_text("3 0 0 POLY\n60 120\n60 180\n120 180\n4 0 0 OTHER\n0 0\n0 60\n60 60\n60 0\n")
    (tmp_path / "a.sls").write_text("SEC + POLY 0 999\nSEC + OTHER 100 200\n")
    (tmp_path / "a.spc").write_text("A;AREA;Big area;FIR\nS;SEC;ES\nS;LOST;ES\n")
    read = lambda n: aeronautical.lines_of(spark, str(tmp_path / n))
    out = aeronautical.ddr_airspaces(aeronautical.are_polygons(read("a.are")), aeronautical.sls_layers(read("a.sls")), aeronautical.spc_composition(read("a.spc")))
    got = sorted((r.designator, r.component, r.lower, r.upper, len(r.ring or [])) for r in out.collect() if r.ring) + sorted((r.designator, r.component) for r in out.collect() if not r.ring)
    assert got == sorted([("AREA", "SEC", 0.0, None, 3), ("AREA", "SEC", 100.0, 200.0, 4), ("SEC", "SEC", 0.0, None, 3), ("SEC", "SEC", 100.0, 200.0, 4)], key=str) + [("AREA", "LOST")]
    (tmp_path / "p.nnpt").write_text("head\nTOU;VOR;43.68;1.31;TOULOUSE\nFJR;VOR;43.58;3.98;_\n")
    (tmp_path / "r.routes").write_text("head\nL;UN1;AR;x;x;TOU;x;1\nL;UN1;AR;x;x;FJR;x;2\nL;UN1;AR;x;x;NONE;x;3\n")
    nav = aeronautical.nm_navaids(spark, str(tmp_path / "p.nnpt"))
    assert [(r.route, r.id, r.navaid, r.latitude) for r in aeronautical.nm_routes(spark, str(tmp_path / "r.routes"), nav).orderBy("id").collect()] == [("UN1", 1, "TOU", 43.68), ("UN1", 2, "FJR", 43.58)]
    (tmp_path / "f.frp").write_text("FRA1 E  PT1 N4330 E00130\nFRA1 X PT1\nFRA1 EX TOU\nFRA1 AD PT1 LFBO LFPG\nFRA1 E GONE\n")
    f = aeronautical.free_route_lines(read("f.frp"), nav).collect()
    assert sorted((r.type, r.name, round(r.latitude, 2), r.airport or "") for r in f) == [("AD", "PT1", 43.5, "LFBO"), ("AD", "PT1", 43.5, "LFPG"), ("E", "PT1", 43.5, ""), ("EX", "TOU", 43.68, ""), ("X", "PT1", 43.5, "")]


def test_json_files(spark, tmp_path):
    def write(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    poly = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    a = aeronautical.faa_airspaces(spark, write("f.json", {"features": [{"properties": {"NAME": " X ", "LOWER_VAL": -9998, "UPPER_VAL": -9998, "TYPE_CODE": "C", "IDENT": "I"}, "geometry": poly}]})).collect()
    assert [(r.name, r.lower, r.upper, len(r.ring)) for r in a] == [("X", 0.0, None, 3)]
    e = aeronautical.fir_shapes(spark, write("e.json", {"features": [{"properties": {"AV_AIRSPAC": "LFBB", "AV_NAME": "B", "MIN_FLIGHT": 0, "MAX_FLIGHT": 999}, "geometry": poly}]})).collect()
    assert [(r.designator, r.upper) for r in e] == [("LFBB", None)]
    at = {"type": "Point", "coordinates": [5.0, 6.0]}
    n = aeronautical.faa_navaids(spark, write("n.json", {"features": [{"properties": {"IDENT": "A", "NAV_TYPE": 3}, "geometry": at}, {"properties": {"IDENT": "B", "NAV_TYPE": 9}, "geometry": at}]})).collect()
    assert [(r.name, r.type, r.latitude, r.longitude) for r in n] == [("A", "VOR", 6.0, 5.0)]
    p = aeronautical.faa_points(spark, write("p.json", {"features": [{"properties": {"IDENT": "A"}, "geometry": at}, {"properties": {"IDENT": "B"}, "geometry": None}]})).collect()
    assert [(r.name, r.latitude) for r in p] == [("A", 6.0)]
    track = [{"latitude": 1, "longitude": 2, "altitude": {"feet": 100}, "speed": {"kts": 5}, "verticalSpeed": {"fpm": 0}, "heading": 90, "timestamp": 1000, "ems": None}, {"latitude": 1, "longitude": 3, "altitude": {"feet": 200}, "timestamp": 1010, "ems": {"ts": 1011, "mach": 800, "ias": 250}}]
    flight = {"identification": {"id": "i1", "callsign": "CS"}, "airport": {"origin": {"code": {"icao": "AAAA"}}, "destination": {"code": {"icao": "BBBB"}}}, "aircraft": {"identification": {"modes": "AB12"}, "model": {"code": "A320"}}, "track": track}
    w = aeronautical.web_json(spark, write("w.json", {"result": {"response": {"data": {"flight": flight}}}})).orderBy("timestamp").collect()
    assert [(r.icao24, r.altitude, r.Mach) for r in w] == [("ab12", 100.0, None), ("ab12", 200.0, None), ("ab12", None, 0.8)]
    s = aeronautical.scat_flights(spark, write("s.json", {"id": "9", "fpl": {"fpl_base": [{"adep": "A", "ades": "B", "aircraft_type": "T", "callsign": "C"}]}, "plots": [{"I062_105": {"lat": 1, "lon": 2}, "I062_136": {"measured_flight_level": 300}, "I062_185": {"vx": 0, "vy": 51.4444}, "time_of_track": "2024-01-01T00:00:00"}]})).collect()
    assert [(r.altitude, round(r.track, 6), round(r.groundspeed, 6)) for r in s] == [(30000.0, 0.0, 100.0)]
    assert aeronautical.scat_waypoints(spark, write("c.json", [{"name": "E", "points": [{"name": "P", "lat": 1, "lon": 2}, {"name": "P", "lat": 1, "lon": 2}]}])).count() == 1
    assert aeronautical.scat_weather(spark, write("g.json", [{"alt": 1, "lat": 2, "lon": 3, "temp": 4, "time": "2024-01-01T00:00:00", "wind_dir": 5, "wind_spd": 6}])).first().temperature == 4


def test_flight_lists_and_history(spark, tmp_path):
    row = [""] * 181
    row[0:7] = ["LFBO", "EGLL", "AFR1", "AFR", "A320", "20240101120000", "AT001"]
    row[16:18] = ["20240101121000", "202401011215"]
    row[56] = "3944EF"
    (tmp_path / "all.csv").write_text("title\n" + ";".join(row) + "\n")
    f = aeronautical.all_flights(spark, str(tmp_path / "all.csv"))
    r = aeronautical.find_flight(f, ("LFBO", "EGLL")).first()
    assert (r.icao24, r.callsign, str(r.AOBT), str(r.EOBT), r.IOBT) == ("3944ef", "AFR1", "2024-01-01 12:00:00", "2024-01-01 12:15:00", None)
    assert aeronautical.find_flight(f, "3944ef").count() == aeronautical.find_flight(f, "AT001").count() == 1
    base = dt.datetime(2024, 1, 1)
    rows = [(f"a{i % 3}", "C", base + dt.timedelta(minutes=20 * i), 45.0, float(i)) for i in range(100)]
    t = spark.createDataFrame(rows, "icao24 string, callsign string, timestamp timestamp_ntz, latitude double, longitude double")
    t.withColumns({"day": F.to_date("timestamp"), "hour": F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / 3600)}).write.partitionBy("day", "hour").parquet(str(tmp_path / "store"))
    got = aeronautical.history(spark, str(tmp_path / "store"), "2024-01-01T03:00:00", "2024-01-01T05:00:00", (0, 0, 12, 90), icao24=["a0", "a1"])
    assert sorted(r.longitude for r in got.collect()) == [9.0, 10.0, 12.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "hour" in plan.split("PartitionFilters")[1].split("]")[0]
    assert aeronautical.history_flights(got).count() == 2


def test_names_of_methods(spark):
    rows = [("f", i, T0 + dt.timedelta(seconds=60 * i), 45.0, 3.0, 1000.0, 5.0) for i in range(5)]
    t = Trajectories(spark.createDataFrame(rows, "flight_id string, event_id long, timestamp timestamp_ntz, latitude double, longitude double, altitude double, groundspeed double"))
    assert len(t) == 1 and len(t.movement()) == 1 and len(t.movement(method="slow_taxi")) == 1
    assert t.has("movement").df.count() == 5 and t.next("movement").df.count() == 5 and t.sum("movement").first().n == 1
    with pytest.raises(ValueError):
        t.movement(method="unknown")
    assert t.eval().df.count() == 5 and t.start_time == T0


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_splines_by_powers(order):
    """Splines equal those of truncated powers with the same knots, and polynomials come back."""
    rng = np.random.default_rng(order)
    x = np.cumsum(rng.integers(1, 4, 14)).astype(float)
    y, at = rng.normal(size=14), np.linspace(x[0], x[-1], 50)
    inner = splines.knots(x, order)[order + 1 : -order - 1]
    powers = lambda v: np.column_stack([*[(v / 10) ** p for p in range(order + 1)], *[np.maximum((v - k) / 10, 0) ** order for k in inner]])
    assert np.allclose(splines.through(x, y, order, at), powers(at) @ np.linalg.solve(powers(x), y), atol=1e-6)
    assert np.allclose(splines.through(x, x**order, order, at), at**order)
    assert np.isnan(splines.through(x, y, order, np.array([x[0] - 1, x[-1] + 1]))).all()
    assert np.isnan(splines.through(x[:order], y[:order], order, at)).all()


def test_resample_polynomial(spark):
    """A parabola comes back between its samples; nothing is made outside of them; few samples stay as they are."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", at(s), None if s in (0, 40) else float(s * s)) for s in (0, 2, 5, 11, 20, 31, 40)] + [("b", at(0), 1.0), ("b", at(3), 2.0), ("c", at(0), None)]
    df = spark.createDataFrame(rows, "icao24 string, timestamp timestamp_ntz, altitude double")
    got = splines.resample_polynomial(df, ["icao24"], "1 s", "altitude").collect()
    a = {(r.timestamp - T0).seconds: r.altitude for r in got if r.icao24 == "a"}
    assert sorted(a) == list(range(41)) and all(a[s] is None for s in (0, 1, *range(32, 41)))
    assert all(abs(a[s] - s * s) < 1e-6 for s in range(2, 32))
    assert [r.altitude for r in sorted(got) if r.icao24 == "b"] == [1.0, None, None, 2.0]
    assert [r.altitude for r in got if r.icao24 == "c"] == [None]


def test_replies_and_surface(spark):
    """Altitudes of both kinds, squawks and addresses of replies; a squitter from the ground."""
    code = lambda *on: sum(1 << replies.PLACES[b] for b in on)
    # By hand: C4 is the lowest height; B4 with C1 is step 1 of 500 feet, counted downwards from 6, less 5.
    want = {0: None, 0x40: None, code("C4"): -1200.0, code("B4", "C1"): -700.0}
    heights = {r.c: r.h for r in spark.createDataFrame([(c,) for c in want], "c int").select("c", replies.altitude(F.col("c")).alias("h")).collect()}
    assert heights == want
    # Steps of 100 feet: every code that is used gives another altitude, without a gap from -1200 on.
    every = spark.range(1 << 13).filter(f"id & {0x50} = 0").select(replies.altitude(F.col("id")).alias("h")).filter("h is not null").collect()
    assert sorted(r.h for r in every) == [100.0 * k for k in range(-12, len(every) - 12)]
    text = spark.createDataFrame([("A02014B400000000000000F9D514",), ("A800292DFFBBA9383FFCEB903D01",), ("A0001839CA3800315800007448D9",), ("zz",), (None,)], "rawmsg string")
    got = {r.rawmsg[:4]: r for r in replies.replies(text).collect()}
    assert len(got) == 3 and got["A000"].icao24 == "400940" and got["A020"].altitude == 32300.0 and got["A020"].squawk is None and got["A800"].squawk == "1346"
    known = spark.createDataFrame([(got["A800"].icao24,)], "icao24 string")
    assert [r.squawk for r in replies.replies(text, known=known).collect()] == ["1346"]
    ground = spark.createDataFrame([("8C4841753A9A153237AEF0F275BE",)], "rawmsg string")
    (r,) = replies.surface(ground, 51.990, 4.375).collect()
    assert (r.icao24, r.groundspeed, round(r.track, 1)) == ("484175", 17.0, 92.8)
    # Positions are packed by hand, from all quarters of the earth, and come back by a place some miles off.
    for lat, lon in ((52.3, 4.75), (-43.48, 172.54), (-0.01, -0.02), (64.1, -21.9), (33.9, -118.4)):
        for odd in (0, 1):
            pack = lambda v, step: math.floor(131072 * (v % step) / step + 0.5) % 131072
            d_lat = 90 / (60 - odd)
            y = pack(lat, d_lat)
            seen = d_lat * (y / 131072 + math.floor(lat / d_lat))
            zones = math.floor(2 * math.pi / math.acos(1 - (1 - math.cos(math.pi / 30)) / math.cos(math.radians(abs(seen))) ** 2))
            me = 7 << 51 | 20 << 44 | 1 << 43 | 33 << 36 | odd << 34 | y << 17 | pack(lon, 90 / max(1, zones - odd))
            sent = spark.range(1).select(catalog_more._message(F.lit("ABCDEF"), F.lit(me)).alias("rawmsg"))
            (r,) = replies.surface(sent, lat + 0.2, lon - 0.3).collect()
            assert abs(r.latitude - lat) < 2e-5 and abs(r.longitude - lon) < 4e-5 and r.groundspeed == 5.5


def test_dense_clusters_are_those_of_all_pairs(spark):
    """Dense and thin cells, copies, a null and places below zero: the cells' way and pair by pair give the same."""
    rng = np.random.default_rng(8)
    p = np.round(np.concatenate([rng.normal(0, 0.05, (500, 2)), rng.uniform(-1, 1, (250, 2)), rng.normal((-0.6, 0.4), 0.01, (150, 2))]), 3)
    p = np.concatenate([p, p[:40], p[500:520]])
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(p)]
    df = spark.createDataFrame(rows, "k long, features array<double>")
    for eps, least in ((0.02, 3), (0.05, 8), (0.3, 2)):
        near = np.array([[(a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= eps * eps for b in p] for a in p])
        core = near.sum(1) >= least
        label, old = np.where(core, np.arange(len(p)), len(p)), None
        while old is None or (old != label).any():
            old = label
            label = np.where(core, np.where(near & core[None], label[None], len(p)).min(1), len(p))
        label = np.where(near & core[None], label[None], len(p)).min(1)
        got = {r.k: r.cluster for r in ml.dbscan(df, eps, least, "k").collect()}
        assert [got[i] for i in range(len(p))] == np.where(label == len(p), -1, label).tolist()
    assert ml._core_cells(df.limit(0).selectExpr("k _node", "features[0] _x", "features[1] _y"), 0.1, 3).count() == 0


def test_a_crowd_is_not_listed_pair_by_pair(spark, monkeypatch):
    """Rows within reach of each other give one row each, not one for each pair."""
    def refuse(*_, **__):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(ml, "neighbours", refuse)
    df = spark.range(3000).selectExpr("id k", "array(id % 100 * 1e-5, id div 100 * 1e-5) features")
    assert ml.dbscan(df, 0.02, 3, "k").filter("cluster = 0").count() == 3000
