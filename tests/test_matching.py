"""Matching along a network against search over all chains; the bound filter against plain loops."""

import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from trackweave.operators import grouped, matching

T0 = datetime(2024, 1, 1)
NODES = [(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 200.0, 5.0), (3, 0.0, 90.0), (4, 100.0, 100.0), (5, 210.0, 100.0), (6, 1000.0, 0.0), (7, 1100.0, 0.0)]
EDGES = [(10, 0, 1), (11, 1, 2), (12, 0, 3), (13, 1, 4), (14, 2, 5), (15, 3, 4), (16, 6, 7)]


@pytest.fixture(scope="module")
def network(spark):
    return spark.createDataFrame(NODES, "node long, x double, y double"), spark.createDataFrame(EDGES, "edge long, u long, v long")


def walks(limit):
    d = {(a, b): 0.0 if a == b else math.inf for a, *_ in NODES for b, *_ in NODES}
    at = {n: (x, y) for n, x, y in NODES}
    for _, u, v in EDGES:
        d[u, v] = d[v, u] = math.dist(at[u], at[v])
    for k, a, b in itertools.product(at, at, at):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return {k: v for k, v in d.items() if v <= limit}, at


def candidates(x, y, at, reach):
    out = []
    for e, u, v in EDGES:
        (x1, y1), (x2, y2) = at[u], at[v]
        size = math.dist(at[u], at[v])
        t = min(1, max(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / size**2))
        away = math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))
        if away <= reach:
            out.append((e, u, v, t * size, size - t * size, away))
    return out


def cheapest(rows, limit, reach, sigma, beta, lost):
    """The best of all chains, tried one by one; ties for the smaller candidates from the end."""
    d, at = walks(limit)
    steps = [(x, y, c) for x, y in rows if x is not None and (c := candidates(x, y, at, reach))]
    best = None
    for chain in itertools.product(*[s[2] for s in steps]):
        cost = sum(round(1e6 * (c[5] / sigma) ** 2 / 2) for c in chain)
        for (x, y, _), (x2, y2, _), p, c in zip(steps, steps[1:], chain, chain[1:]):
            road = abs(p[3] - c[3]) if p[0] == c[0] else min((p[3 + i] + d.get((p[1 + i], c[1 + j]), math.inf) + c[3 + j] for i in (0, 1) for j in (0, 1)))
            cost += round(1e6 * (min(lost, abs(road - math.hypot(x - x2, y - y2)) / beta) if road <= limit else lost))
        key = (cost, [c[0] for c in reversed(chain)])
        if best is None or key < best[0]:
            best = key, [c[0] for c in chain]
    kept = iter(best[1] if best else [])
    return [next(kept) if x is not None and candidates(x, y, at, reach) else None for x, y in rows]


def test_node_distances(spark, network):
    nodes, edges = network
    got = {(r.a, r.b): r.d for r in matching.node_distances(matching.placed(nodes, edges), 250.0).collect()}
    want, _ = walks(250.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("reach, limit", [(60.0, 150.0), (80.0, 400.0)])
def test_match_equals_exhaustive_search(spark, network, reach, limit):
    rng = random.Random(5)
    rows, flights = [], {}
    for f in range(25):
        x, y = rng.uniform(-20, 220), rng.uniform(-20, 120)
        for k in range(5):
            x, y = x + rng.uniform(-60, 70), y + rng.uniform(-50, 60)
            place = (None, None) if rng.random() < 0.1 else (1050.0 + k, 3.0) if rng.random() < 0.1 else (x, y)
            flights.setdefault(f if f else None, []).append(place)
            rows.append((f if f else None, 100 * f + k, T0 + timedelta(seconds=k), *place, "same name"))
    df = spark.createDataFrame(rows, "flight long, event_id long, timestamp timestamp, x double, y double, length string")
    out = matching.match(df, ["flight"], *network, reach=reach, limit=limit)
    assert out.columns == [*df.columns, "edge", "edge_offset", "edge_distance"]
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.event_id):
        got.setdefault(r.flight, []).append(r.edge)
    assert got == {f: cheapest(p, limit, reach, 10.0, 20.0, 25.0) for f, p in flights.items()}
    assert matching.match(df.limit(0), ["flight"], *network).count() == 0


def plain_filter(t, z, pieces, bind=1.0):
    """The filter without smoothing, one value at a time: measured values follow each other, which gives the same for independent noise."""
    x, p = None, None
    out, near = [], []
    for k in range(len(t)):
        if k == 0:
            x = [0.0 if math.isnan(v) else v for v in z[0]]
            p = [[0.0] * 4 for _ in range(4)]
            for i in range(4):
                p[i][i] = 1e6 if math.isnan(z[0][i]) else [16.0, 16.0, 4.0, 4.0][i]
            before = list(x)
        else:
            h = t[k] - t[k - 1]
            f = [[1, 0, h, 0], [0, 1, 0, h], [0, 0, 1, 0], [0, 0, 0, 1]]
            x = [sum(f[i][j] * x[j] for j in range(4)) for i in range(4)]
            fp = [[sum(f[i][m] * p[m][j] for m in range(4)) for j in range(4)] for i in range(4)]
            p = [[sum(fp[i][m] * f[j][m] for m in range(4)) for j in range(4)] for i in range(4)]
            for i in (0, 1):
                p[i][i] += 0.25 * h**3 / 3 + 0.05 * h
                p[i][i + 2] += 0.25 * h**2 / 2
                p[i + 2][i] += 0.25 * h**2 / 2
                p[i + 2][i + 2] += 0.25 * h
            before = list(x)

        def update(row, seen, variance):
            nonlocal x, p
            ph = [sum(p[i][j] * row[j] for j in range(4)) for i in range(4)]
            s = sum(row[i] * ph[i] for i in range(4)) + variance
            e = seen - sum(row[i] * x[i] for i in range(4))
            x = [x[i] + ph[i] / s * e for i in range(4)]
            p = [[p[i][j] - ph[i] * ph[j] / s for j in range(4)] for i in range(4)]

        for i in range(4) if k else ():
            if not math.isnan(z[k][i]):
                update([1.0 if j == i else 0.0 for j in range(4)], z[k][i], [16.0, 16.0, 4.0, 4.0][i])
        near = pieces[k] if len(pieces[k]) else near
        if len(near):
            def foot(w, s):
                dx, dy = s[2] - s[0], s[3] - s[1]
                u = min(1, max(0, ((w[0] - s[0]) * dx + (w[1] - s[1]) * dy) / (dx * dx + dy * dy)))
                return s[0] + u * dx, s[1] + u * dy, u

            at = z[k][:2] if not any(map(math.isnan, z[k][:2])) else before[:2]
            s = min(near, key=lambda s: math.dist(at, foot(at, s)[:2]))
            *to, u = foot(x[:2], s)
            away = [x[0] - to[0], x[1] - to[1]]
            n = [s[1] - s[3], s[2] - s[0]] if 0 < u < 1 else away
            size = math.hypot(*n)
            if size > 1e-9:
                n = [n[0] / size, n[1] / size, 0.0, 0.0]
                update(n, sum(n[i] * x[i] for i in range(4)) - n[0] * away[0] - n[1] * away[1], bind**2)
        out.append(list(x))
    return np.array(out)


def drive(seed, n=120):
    """A noisy drive along two streets at 10 m/s: true places, measured states, times."""
    rng = np.random.default_rng(seed)
    t = np.arange(n, dtype=float)
    s = t * 10
    true = np.column_stack([np.minimum(s, 600), np.maximum(s - 600, 0)])
    speed = np.where(s[:, None] < 600, [[10.0, 0.0]], [[0.0, 10.0]])
    z = np.column_stack([true + rng.normal(0, 8, (n, 2)), speed + rng.normal(0, 2, (n, 2))])
    z[rng.random(n) < 0.1, :2] = np.nan
    return t, true, z


def test_filter_equals_plain_loops():
    street = np.array([[0.0, 0, 600, 0], [600, 0, 600, 800], [0, 300, 900, 300]])
    for seed in range(3):
        t, _, z = drive(seed)
        t[60:] += 4.0
        z[0, 2] = np.nan
        pieces = [street if k % 7 else street[:0] for k in range(len(t))]
        a, b = matching.network_filter(t, z, pieces, smooth=False), plain_filter(t, z.tolist(), pieces)
        assert np.abs(a - b).max() < 1e-4, (seed, np.abs(a - b).max())


def test_network_makes_the_error_smaller(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 600.0, 0.0), (2, 600.0, 800.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "edge long, u long, v long")
    t, true, z = drive(9)
    rows = [(1, T0 + timedelta(seconds=float(a)), *(None if math.isnan(v) else float(v) for v in p[:2]), 0.0, float(np.hypot(*p[2:])) * 3600 / 1852, float(np.degrees(np.arctan2(p[2], p[3])) % 360), 0.0) for a, p in zip(t, z)]
    df = spark.createDataFrame(rows, "flight long, timestamp timestamp, x double, y double, altitude double, groundspeed double, track double, vertical_rate double")
    error = lambda out: float(np.sqrt(np.mean([(r.x - a) ** 2 + (r.y - b) ** 2 for r, (a, b) in zip(sorted(out.collect(), key=lambda r: r.timestamp), true)])))
    bound, free = error(matching.kalman_network(df, ["flight"], nodes, edges)), error(grouped.kalman6d(df, ["flight"], smooth=True))
    assert bound < 3.0 and bound < 0.7 * free
    assert matching.kalman_network(df.limit(0), ["flight"], nodes, edges).count() == 0


def test_flights_side_by_side_are_those_alone():
    """Flights of different lengths with unknown values and rows without pieces, filtered together and one by one."""
    from trackweave.operators.matching import network_filter, network_filters

    rng = np.random.default_rng(6)
    flights = []
    for n in (1, 7, 3, 3, 20):
        z = rng.normal(0, 30, (n, 4))
        z[rng.random((n, 4)) < 0.2] = np.nan
        flights.append((np.cumsum(rng.integers(0, 9, n)).astype(float), z, [rng.normal(0, 50, (rng.integers(0, 4), 4)) for _ in range(n)]))
    ends = np.cumsum([0] + [len(t) for t, _, _ in flights])
    pieces = [p for f in flights for p in f[2]]
    for smooth in (False, True):
        got = network_filters(*(np.concatenate([f[k] for f in flights]) for k in (0, 1)), np.concatenate(pieces), np.array([len(p) for p in pieces]), ends, smooth=smooth)
        want = np.concatenate([network_filter(*f, smooth=smooth) for f in flights])
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9) and np.isfinite(got).all()
