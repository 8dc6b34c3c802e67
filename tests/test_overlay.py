"""Union of polygons against sampled points, counted areas and shapes known by hand."""

import math
import random

import pytest

from trackweave.operators import overlay

SCHEMA = "k long, ring array<struct<x:double,y:double>>, area string"


def box(w, s, e, n):
    return [(float(x), float(y)) for x, y in ((w, s), (e, s), (e, n), (w, n))]


def star(rng, x, y, size):
    n = rng.randint(3, 12)
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    reach = [size * rng.uniform(0.3, 1) for _ in turns]
    return [(x + r * math.cos(a), y + r * math.sin(a)) for a, r in zip(turns, reach)]


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def tuples(ring):
    return [(p.x, p.y) for p in ring]


SHAPES = {
    1: [box(0, 0, 2, 2), box(1, 1, 3, 3)],  # overlap
    2: [box(0, 0, 1, 1), box(1, 0, 2, 1)],  # a shared side
    3: [box(0, 0, 1, 1), box(1, 1, 2, 2)],  # a shared corner
    4: [box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 0, 1, 3), box(2, 0, 3, 3)],  # a frame
    5: [box(0, 0, 4, 4), box(1, 1, 2, 2)],  # one inside
    6: [box(0, 0, 1, 1), box(0, 0, 1, 1), list(reversed(box(0, 0, 1, 1)))],  # the same one
    7: [box(0, 0, 1, 1), box(5, 5, 6, 6)],  # apart
    8: [box(0, 0, 2, 2), [(1.0, -1.0), (3.0, 1.0), (1.0, 1.5)], box(0, 0, 2, 2) + [(0.0, 0.0)]],
    9: [box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 0, 1, 3), box(2, 0, 3, 3), box(1.25, 1.25, 1.75, 1.75)],  # an island in a hole
}


def test_known_shapes(spark):
    rows = [(k, ring, "x") for k, rings in SHAPES.items() for ring in rings] + [(10, None, "x"), (11, [(0.0, 0.0), (1.0, 1.0)], "x"), (11, [], "x"), (None, box(0, 0, 1, 1), "x")]
    got = {}
    for r in overlay.union(spark.createDataFrame(rows, SCHEMA), ["k"]).collect():
        got.setdefault(r.k, []).append(r)
        assert r.loose == 0
    area = {k: sum(r.area for r in rs) for k, rs in got.items()}
    assert {k: round(a, 9) for k, a in area.items() if k != 8} == {1: 7, 2: 2, 3: 2, 4: 8, 5: 16, 6: 1, 7: 2, 9: 8.25, None: 1}
    assert {k: (len(rs), sum(len(r.holes) for r in rs)) for k, rs in got.items()} == {1: (1, 0), 2: (1, 0), 3: (2, 0), 4: (1, 1), 5: (1, 0), 6: (1, 0), 7: (2, 0), 8: (1, 0), 9: (2, 1), None: (1, 0)}
    assert sorted(tuples(got[2][0].ring)) == [(0, 0), (0, 1), (2, 0), (2, 1)]
    assert sorted(tuples(got[4][0].holes[0])) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert overlay.union(spark.createDataFrame([], SCHEMA), ["k"]).count() == 0


@pytest.mark.parametrize("cell", [0.25, 3.0])
def test_random_polygons_against_points(spark, cell):
    rng = random.Random(11)
    groups = {k: [star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0.3, 3)) for _ in range(rng.randint(1, 9))] for k in range(14)}
    df = spark.createDataFrame([(k, r, "x") for k, rs in groups.items() for r in rs], SCHEMA)
    parts = {}
    for r in overlay.union(df, ["k"], cell=cell).collect():
        assert r.loose == 0 and r.area > 0
        parts.setdefault(r.k, []).append((tuples(r.ring), [tuples(h) for h in r.holes]))
    for k, rings in groups.items():
        for _ in range(1500):
            x, y = rng.uniform(-6, 6), rng.uniform(-6, 6)
            ours = sum(inside(x, y, ring) and not any(inside(x, y, h) for h in holes) for ring, holes in parts[k])
            assert ours == any(inside(x, y, r) for r in rings), (k, x, y)


def test_polygons_with_holes_and_levels(spark):
    holed = spark.createDataFrame([(1, box(0, 0, 9, 9), [box(1, 1, 4, 4), list(reversed(box(5, 5, 8, 8)))]), (1, box(2, 2, 3, 3), None), (1, box(4, 0, 6, 6), [])], "k long, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    (r,) = [r for r in overlay.union(holed, ["k"]).collect() if r.part == 0]
    assert len(r.holes) == 2 and abs(r.area - (81 - 9 - 9 + 1)) < 1e-9
    layers = spark.createDataFrame([("a", box(0, 0, 2, 2), 0.0, 100.0), ("a", box(1, 0, 3, 2), 50.0, 150.0), ("a", box(0, 0, 1, 1), 150.0, None)], "k string, ring array<struct<x:double,y:double>>, lower double, upper double")
    got = {(r.lower, r.upper): round(r.area, 9) for r in overlay.union_levels(layers, ["k"]).collect()}
    assert got == {(0.0, 50.0): 4, (50.0, 100.0): 6, (100.0, 150.0): 4, (150.0, math.inf): 1}


def test_distance_to_a_zone(spark):
    """Against the boundary, cut into short pieces and measured on the sphere."""
    from trackweave import Trajectories

    rng = random.Random(4)
    ring = star(rng, 2.0, 44.0, 0.8)
    fine = [(a[0] + (b[0] - a[0]) * k / 400, a[1] + (b[1] - a[1]) * k / 400) for a, b in zip(ring, ring[1:] + ring[:1]) for k in range(400)]

    def metres(x1, y1, x2, y2):
        h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    rows = [(i, 44 + rng.uniform(-1, 1), 2 + rng.uniform(-1, 1)) for i in range(120)] + [(900, None, 1.0)]
    t = Trajectories(spark.createDataFrame(rows, "flight_id long, latitude double, longitude double"), ["flight_id"])
    zones = spark.createDataFrame([("z", ring), ("other", ring[:3])], "name string, ring array<struct<x:double,y:double>>")
    got = {r.flight_id: r.distance for r in t.distance_to_zone(zones, "z").df.collect()}
    assert len(got) == 121 and got[900] is None
    for i, lat, lon in rows[:-1]:
        want = min(metres(lon, lat, x, y) for x, y in fine) * (-1 if inside(lon, lat, ring) else 1)
        assert abs(got[i] - want) < 0.003 * abs(want) + 300, (i, got[i], want)
    assert {r.distance for r in t.distance_to_zone(zones, "no such").df.collect()} == {None}


def test_no_side_of_a_join_is_gathered(spark):
    """Spark guesses exploded sides to be small; none may be broadcast from the driver."""
    df = spark.createDataFrame([("a", box(0, 0, 2, 2), 0.0, 100.0)], "k string, ring array<struct<x:double,y:double>>, lower double, upper double")
    for u in (overlay.union(df, ["k"]), overlay.union_levels(df, ["k"])):
        assert "Broadcast" not in u._jdf.queryExecution().executedPlan().toString()


def test_keys_in_arrays_give_what_the_cluster_gives(spark, monkeypatch):
    """Before, every side was sent to its cells and bands and back, whatever the key's size (F2, F3)."""
    rng = random.Random(2)
    pick = lambda: rng.choice([star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0.3, 2)), box(w := rng.randrange(6) / 2, s := rng.randrange(6) / 2, w + rng.randrange(1, 4) / 2, s + rng.randrange(1, 4) / 2)])
    rows = [(k, pick(), rng.choice([[], None, [box(0.25, 0.25, 0.75, 0.75)]]), rng.choice([0.0, 1.0, None]), rng.choice([2.0, 3.0, None])) for k in [*range(8), None] for _ in range(1 + 4 * (k or 0))]
    rows += [*rows[:30], (20, None, [box(0, 0, 1, 1)], 0.0, 1.0), (21, [(0.0, 0.0), (None, 1.0), (1.0, 0.0)], None, 0.0, 1.0), (22, box(0, 0, 1, 1), None, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "k long, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, lower double, upper double")
    monkeypatch.setattr(overlay, "SIDES_AT_ONCE", 60, raising=False)
    monkeypatch.setattr(overlay, "PAIRS_AT_ONCE", 50, raising=False)
    for of in (overlay.union, overlay.union_levels):
        found = []
        for corners in (5_000, 40, 0):
            monkeypatch.setattr(overlay, "TOGETHER", corners, raising=False)
            u = of(df, ["k"])
            assert corners != 5_000 or "Join" not in u._jdf.queryExecution().executedPlan().toString()
            found.append(sorted((str(r[:-4]), [(round(p.x, 9), round(p.y, 9)) for p in r.ring], [[(round(p.x, 9), round(p.y, 9)) for p in h] for h in r.holes], round(r.area, 9), r.loose) for r in u.collect()))
        assert found[0] == found[1] == found[2] and len(found[0]) > 9
