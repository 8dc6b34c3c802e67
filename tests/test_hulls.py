"""Hulls and calipers against brute force over points and directions."""

import math
import random

import numpy as np
import pytest

from trackweave.operators import hulls


def clouds():
    rng = random.Random(6)
    yield [(1.0, 2.0)]
    yield [(1.0, 2.0), (1.0, 2.0), (4.0, 6.0)]
    yield [(float(k), 2.0 * k) for k in range(6)]
    yield [(float(a), float(b)) for a in range(4) for b in range(3)]
    for n in (3, 4, 7, 30, 400):
        for _ in range(6):
            yield [(rng.gauss(0, 3), rng.gauss(0, 1)) for _ in range(n)]
            yield [(float(rng.randint(0, 5)), float(rng.randint(0, 5))) for _ in range(n)]


def test_hull_and_calipers():
    for p in clouds():
        p = np.array(p)
        h = hulls.hull(p)
        if len(h) > 2:
            turn = [np.cross([*(h[(i + 1) % len(h)] - h[i]), 0], [*(h[(i + 2) % len(h)] - h[i]), 0])[2] for i in range(len(h))]
            assert min(turn) > 0
            for i in range(len(h)):  # all points lie left of each side
                e = h[(i + 1) % len(h)] - h[i]
                assert (e[0] * (p[:, 1] - h[i][1]) - e[1] * (p[:, 0] - h[i][0])).min() > -1e-9
        length, width, diagonal, far = hulls.calipers(h)
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
        assert math.isclose(far, d.max(), abs_tol=1e-9)
        assert math.isclose(diagonal, math.hypot(length, width))
        best = math.inf
        for a in np.linspace(0, math.pi / 2, 2000):
            u = np.array([math.cos(a), math.sin(a)])
            best = min(best, np.ptp(p @ u) * np.ptp(p @ np.array([-u[1], u[0]])))
        assert length * width <= best + 1e-9 and best <= length * width + 0.01 * max(1.0, far**2)


@pytest.mark.parametrize("parts", [1, 5])
def test_hulls_of_a_table(spark, parts):
    rows = [(k if k else None, x, y) for k, p in enumerate(clouds()) for x, y in p] + [(500, None, 1.0), (3, 1.0, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "flight long, x double, y double").repartition(parts)
    got = {r.flight: r for r in hulls.hulls(df, ["flight"]).collect()}
    assert 500 not in got
    for k, p in enumerate(clouds()):
        r, h = got[k if k else None], hulls.hull(np.array(p))
        assert r.n == len(p) and np.allclose([(c.x, c.y) for c in r.corners], h)
        assert np.allclose([r.length, r.width, r.diagonal, r.diameter], hulls.calipers(h))
    assert hulls.hulls(df.limit(0), ["flight"]).count() == 0


def test_short_keys_are_merged_in_few_steps(spark, monkeypatch):
    """Keys that are spread over all batches: one hull each in the merge, none before, and the same measures."""
    df = spark.range(4000).selectExpr("id % 500 k", "id * 37 % 101 * 1.0 x", "id * id % 97 * 1.0 y").repartition(7)
    want = {r.k: (r.n, r.area, r.diameter) for r in hulls.hulls(df, ["k"]).collect()}
    monkeypatch.setattr(hulls, "REDUCED_ROWS", 2)
    monkeypatch.setattr(hulls, "MERGED_PLACES", 3)
    got = {r.k: (r.n, r.area, r.diameter) for r in hulls.hulls(df, ["k"]).collect()}
    assert len(want) == 500 and got == want
    plan = hulls.hulls(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan
