"""Points of route chains, free-route points of one name, synonyms of columns."""

import random

import pytest

from trackweave import schema
from trackweave.sources import aeronautical


def plain_chains(segments):
    """Stretches by walking; a point with one way in and one way out is passed."""
    segs = sorted({s for s in segments if None not in s and s[0] != s[1]})
    into, out = {}, {}
    for a, b in segs:
        into.setdefault(b, []).append(a)
        out.setdefault(a, []).append(b)
    passed = {p for p in into if len(into[p]) == 1 and len(out.get(p, [])) == 1}
    stretches, used = [], set()
    for a, b in segs:
        if a in passed:
            continue
        way = [a, b]
        used.add((a, b))
        while way[-1] in passed:
            used.add((way[-1], out[way[-1]][0]))
            way.append(out[way[-1]][0])
        stretches.append(way)
    for a, b in segs:  # what is left are rings
        if (a, b) not in used:
            way = [a]
            while (way[-1], out[way[-1]][0]) not in used:
                used.add((way[-1], out[way[-1]][0]))
                way.append(out[way[-1]][0])
            stretches.append(way[:-1])
    return sorted(stretches, key=lambda w: (w[0], w[1]))


SHAPES = {
    "two stretches": [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z")],
    "fork": [("a", "b"), ("b", "c"), ("b", "d"), ("d", "e")],
    "meeting": [("a", "c"), ("b", "c"), ("c", "d")],
    "ring": [("q", "r"), ("r", "p"), ("p", "q")],
    "ring and line": [("q", "r"), ("r", "p"), ("p", "q"), ("s", "t")],
    "repeated, loops, no end": [("a", "b"), ("a", "b"), ("b", "b"), ("b", None), (None, "a")],
    "long": [(f"n{i:03}", f"n{i + 1:03}") for i in range(300)],
}


def test_every_point_of_every_stretch(spark):
    rng = random.Random(2)
    shapes = dict(SHAPES)
    for k in range(8):
        shapes[f"random {k}"] = [(rng.choice("abcdefghij"), rng.choice("abcdefghij")) for _ in range(rng.randint(1, 12))]
    rows = [(r, a, b) for r, segs in shapes.items() for a, b in segs]
    rng.shuffle(rows)
    ids = sorted({p for segs in shapes.values() for s in segs for p in s if p})
    points = spark.createDataFrame([(p, p.upper(), 1.0, 2.0) for p in ids], "id string, name string, latitude double, longitude double")
    got = {}
    for r in aeronautical.chain(spark.createDataFrame(rows, "route_id string, start_id string, end_id string"), points).collect():
        got.setdefault(r.route_id, {}).setdefault(r.stretch, {})[r.n] = r.id
    for name, segs in shapes.items():
        ours = [[p[n] for n in range(len(p))] for _, p in sorted(got.get(name, {}).items())]
        assert ours == plain_chains(segs), name
    none = spark.createDataFrame([], "route_id string, start_id string, end_id string")
    assert aeronautical.chain(none, points).count() == 0


@pytest.mark.parametrize("with_areas", [False, True])
def test_points_of_one_name(spark, with_areas):
    lines = spark.createDataFrame([("FRN X ONE N480000 E0020000",), ("FRN X HOMO",), ("FRS X HOMO",), ("FRS X TWO N400000 E0020000",), ("FRN AD ONE LFPG EGLL",), ("FRN X ONE",), ("FRS X AWAY",)], "value string")
    nav = spark.createDataFrame([("HOMO", -30.0, 2.0), ("HOMO", 47.0, 3.0), ("HOMO", 41.0, 1.0), ("AWAY", 10.0, 10.0), ("ONE", 1.0, 1.0)], "name string, latitude double, longitude double")
    box = lambda n, w, s, e, u: (n, [(w, s), (e, s), (e, u), (w, u)])
    areas = spark.createDataFrame([box("FRN", 0.0, 45.0, 5.0, 50.0), box("FRS", 0.0, 38.0, 5.0, 43.0)], "name string, ring array<struct<x:double,y:double>>") if with_areas else None
    got = {(r.fra, r.type, r.name, r.airport): (r.latitude, r.longitude) for r in aeronautical.free_route_lines(lines, nav, areas).collect()}
    assert got["FRN", "X", "HOMO", None] == (47.0, 3.0) and got["FRS", "X", "HOMO", None] == (41.0, 1.0)
    assert got["FRN", "X", "ONE", None] == (48.0, 2.0) and got["FRN", "AD", "ONE", "LFPG"] == got["FRN", "AD", "ONE", "EGLL"] == (48.0, 2.0)
    assert (("FRS", "X", "AWAY", None) in got) != with_areas


def test_synonyms_of_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "baro_altitude double, altitude double, ias double, tas double, mach double, geo_altitude double")
    assert schema.normalise(df).first().asDict() == {"altitude": 1.0, "geoaltitude": 2.0, "IAS": 3.0, "TAS": 4.0, "Mach": 5.0}
    df = spark.createDataFrame([(1.0, 2.0)], "baroaltitude double, geo_altitude double")
    assert schema.normalise(df).first().asDict() == {"altitude": 1.0, "geoaltitude": 2.0}
