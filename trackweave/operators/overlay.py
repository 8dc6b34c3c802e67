"""Union of polygons by overlay: sides split where they meet, kept where one side of them is covered, stitched to rings.

Places are whole numbers of a grid, so corners that are shared stay shared.
Keys of few corners, as most are, move once, as polygons: many of them lie side
by side in a task and their sides meet in arrays.  The sides of a key with more
corners meet over the cluster, in cells and in bands of latitude, by equal
keys, so no polygon is compared with all others; only the outline that is left
of such a key is put together in one group, as its rings are values of that
key's rows anyway.

The joins are hinted to sort and merge: from the size of the file Spark takes
the exploded sides to be small, and would gather them in the driver to
broadcast them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .grouped import whole_flights
from .references import slabs
from .scratch import materialize

#: Degrees of the grid, and of the cells in which sides meet.
GRID, CELL = 1e-7, 0.25

_SIDE = ["_x1", "_y1", "_x2", "_y2"]
POINT = T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType())
HOLES = "array<array<struct<x:double,y:double>>>"

#: Corners of a key that is put together in arrays, of a task, sides and pairs of sides that are compared at once, and most tasks.
TOGETHER, TASK_CORNERS, SIDES_AT_ONCE, PAIRS_AT_ONCE, MOST_TASKS = 5_000, 40_000, 50_000, 1_000_000, 10_000


def _sides(df: DataFrame, by: list[str], grid: float) -> DataFrame:
    """(by, _id, side): directed sides with the polygon on their left, in whole steps of the grid."""
    snapped = lambda ring: F.transform(ring, lambda p: F.struct(F.round(p["x"] / grid).cast("long").alias("x"), F.round(p["y"] / grid).cast("long").alias("y")))
    holes = F.col("holes") if "holes" in df.columns else F.lit(None).cast(HOLES)
    polygons = df.select(*by, F.col("ring"), holes.alias("_holes")).withColumn("_id", F.xxhash64(*by, "ring", "_holes")).dropDuplicates(["_id", *by])
    kind = F.transform(F.coalesce("_holes", F.array()), lambda h: F.struct(F.lit(-1.0).alias("s"), snapped(h).alias("r")))
    rings = polygons.filter("ring is not null").select(*by, "_id", F.explode(F.concat(F.array(F.struct(F.lit(1.0).alias("s"), snapped("ring").alias("r"))), kind)).alias("_q"))
    rings = rings.select(*by, "_id", "_q.s", F.col("_q.r").alias("r"))
    turned = F.transform("r", lambda p, i: F.struct(p.alias("a"), F.get("r", F.pmod(i + 1, F.size("r"))).alias("b")))
    origin = F.get("r", F.lit(0))
    cross = lambda s: (s["a"]["x"] - origin["x"]).cast("double") * (s["b"]["y"] - origin["y"]) - (s["b"]["x"] - origin["x"]).cast("double") * (s["a"]["y"] - origin["y"])
    rings = rings.withColumn("_pairs", turned).withColumn("_area", F.aggregate("_pairs", F.lit(0.0), lambda t, s: t + cross(s)) * F.col("s"))
    side = rings.filter("_area <> 0").select(*by, "_id", "_area", F.explode("_pairs").alias("_p")).filter("_p.a <> _p.b")
    a, b = F.when(F.col("_area") > 0, F.col("_p.a")).otherwise(F.col("_p.b")), F.when(F.col("_area") > 0, F.col("_p.b")).otherwise(F.col("_p.a"))
    return side.select(*by, "_id", a["x"].alias("_x1"), a["y"].alias("_y1"), b["x"].alias("_x2"), b["y"].alias("_y2"))


def _line_cells(size: float) -> Column:
    """Cells (struct k, c) that a side touches, widened by a step of the grid: a column of cells at a time."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in _SIDE)
    west, east = F.least(x1, x2) - 1, F.greatest(x1, x2) + 1
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    slope = F.when(x1 != x2, (y2 - y1) / (x2 - x1))

    def column(c: Column) -> Column:
        at = lambda x: y1 + slope * (F.greatest(F.least(x, F.greatest(x1, x2)), F.least(x1, x2)) - x1)
        a, b = at(c * size - 1), at((c + 1) * size + 1)
        south, north = F.coalesce(F.greatest(low, F.least(a, b)), low) - 1, F.coalesce(F.least(high, F.greatest(a, b)), high) + 1
        return F.transform(F.sequence(F.floor(south / size), F.floor(north / size)), lambda k: F.struct(k.alias("k"), c.alias("c")))

    return F.flatten(F.transform(F.sequence(F.floor(west / size), F.floor(east / size)), column))


def _meeting(a: Column, b: Column) -> Column:
    """Points (side: 0 or 1, x, y) at which two sides split each other."""

    def near(p: str, s: Column, side: int) -> Column:
        """An end of the other side on this one, but at its ends."""
        px, py = (a if side else b)[f"_x{p}"], (a if side else b)[f"_y{p}"]
        dx, dy = (s["_x2"] - s["_x1"]).cast("double"), (s["_y2"] - s["_y1"]).cast("double")
        ex, ey = (px - s["_x1"]).cast("double"), (py - s["_y1"]).cast("double")
        size2 = dx * dx + dy * dy
        t = ex * dx + ey * dy
        is_end = ((px == s["_x1"]) & (py == s["_y1"])) | ((px == s["_x2"]) & (py == s["_y2"]))
        on = (t > 0) & (t < size2) & (F.abs(ex * dy - ey * dx) <= F.sqrt(size2)) & ~is_end
        return F.when(on, F.struct(F.lit(side).alias("side"), px.alias("x"), py.alias("y")))

    touches = F.array_compact(F.array(near("1", a, 0), near("2", a, 0), near("1", b, 1), near("2", b, 1)))
    rx, ry = (a["_x2"] - a["_x1"]).cast("double"), (a["_y2"] - a["_y1"]).cast("double")
    sx, sy = (b["_x2"] - b["_x1"]).cast("double"), (b["_y2"] - b["_y1"]).cast("double")
    qx, qy = (b["_x1"] - a["_x1"]).cast("double"), (b["_y1"] - a["_y1"]).cast("double")
    det = rx * sy - ry * sx
    t, u = (qx * sy - qy * sx) / det, (qx * ry - qy * rx) / det
    x, y = a["_x1"] + F.round(t * rx).cast("long"), a["_y1"] + F.round(t * ry).cast("long")
    both = F.array(*[F.struct(F.lit(k).alias("side"), x.alias("x"), y.alias("y")) for k in (0, 1)])
    proper = (det != 0) & t.between(0, 1) & u.between(0, 1)
    return F.when(F.size(touches) > 0, touches).when(proper, both)


def _fragments(sides: DataFrame, by: list[str], size: float) -> DataFrame:
    """Sides cut where others touch or cross them: (by, _id, side)."""
    this = F.struct("_id", *_SIDE)
    met = sides.select(*by, this.alias("_a"), F.explode(_line_cells(size)).alias("_cell"))
    other = met.withColumnRenamed("_a", "_b")
    # Points come at once, where the pair meets: pairs don't move, and points found in several cells are one in the set.
    low, high = (lambda s, c, f=f: f(s[f"_{c}1"], s[f"_{c}2"]) for f in (F.least, F.greatest))
    near = F.lit(True)
    for c in "xy":
        near = near & (low(F.col("_a"), c) <= high(F.col("_b"), c) + 2) & (low(F.col("_b"), c) <= high(F.col("_a"), c) + 2)
    pairs = met.join(other.hint("merge"), [*by, "_cell"]).filter((F.col("_a") < F.col("_b")) & (F.col("_a._id") != F.col("_b._id")) & near)
    points = pairs.select(*by, "_a", "_b", F.explode(_meeting(F.col("_a"), F.col("_b"))).alias("_m"))
    cuts = points.select(*by, F.when(F.col("_m.side") == 0, F.col("_a")).otherwise(F.col("_b")).alias("_s"), F.struct("_m.x", "_m.y").alias("_m")).groupBy(*by, "_s").agg(F.collect_set("_m").alias("_cuts"))
    cut = sides.withColumn("_s", this).join(cuts.hint("merge"), [*by, "_s"], "left")
    dx, dy = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    along = lambda p: (p["x"] - F.col("_x1")).cast("double") * dx + (p["y"] - F.col("_y1")).cast("double") * dy
    ends = F.array(F.struct(F.col("_x1").alias("x"), F.col("_y1").alias("y")), F.struct(F.col("_x2").alias("x"), F.col("_y2").alias("y")))
    inner = F.filter(F.coalesce("_cuts", F.array()), lambda p: (along(p) > 0) & (along(p) < along(F.struct(F.col("_x2").alias("x"), F.col("_y2").alias("y")))))
    chain = F.array_sort(F.transform(F.array_union(ends, inner), lambda p: F.struct(along(p).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    cut = cut.select(*by, "_id", chain.alias("_c")).select(*by, "_id", F.posexplode("_c").alias("_i", "_p"), "_c").withColumn("_q", F.get("_c", F.col("_i") + 1)).filter("_q is not null")
    out = cut.select(*by, "_id", F.col("_p.x").alias("_x1"), F.col("_p.y").alias("_y1"), F.col("_q.x").alias("_x2"), F.col("_q.y").alias("_y2"))
    return out.filter("_x1 <> _x2 or _y1 <> _y2")


def outline(df: DataFrame, by: list[str], grid: float = GRID, cell: float = CELL) -> DataFrame:
    """(by, _x1, _y1, _x2, _y2): the directed pieces of the union's boundary, the union on their left."""
    size = cell / grid
    names, by = by, ["_key"]
    df = df.withColumn("_key", F.struct(*names))  # null keys meet each other inside a struct
    sides = _sides(df, by, grid)
    lower, upper = (F.struct(F.col(f"_x{k}").alias("x"), F.col(f"_y{k}").alias("y")) for k in "12")
    ahead = lower < upper
    a, b = F.when(ahead, lower).otherwise(upper), F.when(ahead, upper).otherwise(lower)
    pieces = _fragments(sides, by, size).select(*by, "_id", ahead.alias("_ahead"), a.alias("_a"), b.alias("_b"))
    pieces = pieces.groupBy(*by, "_a", "_b").agg(F.collect_set("_id").alias("_own"), F.max("_ahead").alias("_left"), F.max(~F.col("_ahead")).alias("_right"))
    # Polygons around a piece's middle: of the sides west of it, in its band of latitude, those that go down less those that go up, as polygons lie on the left.
    x, y = (F.col("_a.x") + F.col("_b.x")) / 2.0, (F.col("_a.y") + F.col("_b.y")) / 2.0
    pieces = pieces.filter(F.col("_left") != F.col("_right"))
    middle = pieces.select(*by, "_a", "_b", "_own", x.alias("_mx"), y.alias("_my")).withColumn("_band", F.floor(F.col("_my") / size))
    walls = sides.filter("_y1 <> _y2").withColumn("_band", F.explode(F.sequence(F.floor(F.least("_y1", "_y2") / size), F.floor(F.greatest("_y1", "_y2") / size))))
    west = F.col("_x1") + (F.col("_x2") - F.col("_x1")) * ((F.col("_my") - F.col("_y1")) / (F.col("_y2") - F.col("_y1"))) < F.col("_mx")
    spans = (F.col("_y1") > F.col("_my")) != (F.col("_y2") > F.col("_my"))
    hit = middle.join(walls.hint("merge"), [*by, "_band"]).filter(spans & west & ~F.array_contains("_own", F.col("_id")))
    around = hit.groupBy(*by, "_a", "_b").agg(F.sum(F.when(F.col("_y2") < F.col("_y1"), 1).otherwise(-1)).alias("_n")).filter("_n <> 0").select(*by, "_a", "_b")
    free = pieces.join(around.hint("merge"), [*by, "_a", "_b"], "left_anti")
    s, e = F.when(F.col("_left"), F.col("_a")).otherwise(F.col("_b")), F.when(F.col("_left"), F.col("_b")).otherwise(F.col("_a"))
    return free.select(*[F.col("_key")[c].alias(c) for c in names], s["x"].alias("_x1"), s["y"].alias("_y1"), e["x"].alias("_x2"), e["y"].alias("_y2"))


def stitch(pieces: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(rings, pieces left over) of directed pieces (n x 4).

    At a corner with several ways on, the first one clockwise from the way back
    is taken, so that rings that touch stay apart.
    """
    order = np.lexsort(pieces.T[::-1])
    pieces = pieces[order]
    rows = pieces.tolist()
    starts: dict[tuple[int, int], list[int]] = {}
    for i, (x, y, _, _) in enumerate(rows):
        starts.setdefault((x, y), []).append(i)
    free = [True] * len(rows)
    rings, loose = [], 0

    def onward(i: int) -> int:
        x1, y1, x2, y2 = rows[i]
        ways = [j for j in starts.get((x2, y2), ()) if free[j]]
        if len(ways) < 2:
            return ways[0] if ways else -1
        back = math.atan2(y1 - y2, x1 - x2)
        turn = lambda j: (back - math.atan2(rows[j][3] - y2, rows[j][2] - x2)) % (2 * math.pi) or 2 * math.pi
        return min(ways, key=turn)

    for i in range(len(rows)):
        if not free[i]:
            continue
        ring, at = [], i
        while at >= 0 and free[at]:
            free[at] = False
            last = rows[at]
            ring.append(last[:2])
            if last[2:] == rows[i][:2]:
                break
            at = onward(at)
        if last[2:] == rows[i][:2] and len(ring) > 2:
            rings.append(np.array(ring, float))
        else:
            loose += len(ring)
    return rings, loose


def _straight(ring: np.ndarray) -> np.ndarray:
    """Without corners on a straight line."""
    before, after = np.concatenate([ring[-1:], ring[:-1]]) - ring, np.concatenate([ring[1:], ring[:1]]) - ring
    bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 0
    return ring[bend] if bend.sum() > 2 else ring


def _area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _inside(p: np.ndarray, ring: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, 0)
    spans = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[spans], b[spans]
    return bool((a[:, 0] + (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) > p[0]).sum() % 2)


def _parts(pieces: np.ndarray, grid: float) -> tuple[list[tuple[np.ndarray, list[np.ndarray], float]], int]:
    """(outer ring, holes and area of every part, pieces left over) of a key's outline."""
    rings, loose = stitch(pieces)
    rings = [_straight(r) for r in rings]
    areas = [_area(r) for r in rings]
    outer = sorted(((r, a) for r, a in zip(rings, areas) if a > 0), key=lambda q: (q[0][:, 0].min(), q[0][:, 1].min(), -q[1]))
    inner: list[list[np.ndarray]] = [[] for _ in outer]
    taken = [0.0] * len(outer)
    for hole, area in ((r, a) for r, a in zip(rings, areas) if a <= 0):
        # A place just inside the union, beside the hole's first side: in the smallest ring around it.
        d = hole[1] - hole[0]
        p = (hole[0] + hole[1]) / 2 + np.array([-d[1], d[0]]) / np.hypot(*d) * 1e-3
        around = [k for k, (r, _) in enumerate(outer) if _inside(p, r)]
        if around:
            k = min(around, key=lambda k: outer[k][1])
            inner[k].append(hole)
            taken[k] += area
        else:
            loose += len(hole)
    return [(r, hs, (a + t) * grid * grid) for (r, a), hs, t in zip(outer, inner, taken)], loose


def _columns(found: list[tuple[list[tuple[np.ndarray, list[np.ndarray], float]], int]], grid: float) -> list[pa.Array]:
    """part, ring, holes, area and loose of every part of several unions."""
    parts = [p for ps, _ in found for p in ps]
    part = [k for ps, _ in found for k in range(len(ps))]
    loose = [n for ps, n in found for _ in ps]

    def lists(rings: list[np.ndarray]) -> pa.Array:
        at = np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype(np.int32)
        xy = np.concatenate([*rings, np.zeros((0, 2))]) * grid
        return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"]))

    ends = np.concatenate([[0], np.cumsum([len(hs) for _, hs, _ in parts])]).astype(np.int32)
    holes = pa.ListArray.from_arrays(pa.array(ends), lists([h for _, hs, _ in parts for h in hs]))
    return [pa.array(part, pa.int32()), lists([r for r, _, _ in parts]), holes, pa.array([a for _, _, a in parts], pa.float64()), pa.array(loose, pa.int32())]


def _ring_sides(xy: pa.Array, sign: float, grid: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the ring, side) of rings given as arrays x, y, x, y, ..: _sides() of them."""
    xy = xy.combine_chunks() if isinstance(xy, pa.ChunkedArray) else xy
    size = np.asarray(xy.value_lengths().fill_null(0), np.int64) // 2
    values = xy.flatten()
    known = np.asarray(values.is_valid())
    v = np.asarray(values.fill_null(0.0), float) / grid
    if not np.isfinite(v).all():
        raise ValueError("a corner that is no number")
    whole = np.trunc(np.abs(v))
    v = (np.copysign(1.0, v) * (whole + (np.abs(v) - whole >= 0.5))).astype(np.int64).reshape(-1, 2)
    ring = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    at = np.arange(len(ring))
    after = np.where(at + 1 == (first + size)[ring], first[ring], at + 1)
    x, y = (v[:, k] - v[first[ring], k] for k in (0, 1))
    cross = x.astype(np.longdouble) * y[after] - x[after].astype(np.longdouble) * y
    area = np.zeros(len(size), np.longdouble)
    np.add.at(area, ring, cross * sign)
    area[ring[~known.reshape(-1, 2).all(1)]] = 0
    keep = (area[ring] != 0) & (v != v[after]).any(1)
    a, b = np.where(area[ring] > 0, at, after)[keep], np.where(area[ring] > 0, after, at)[keep]
    return ring[keep], np.concatenate([v[a], v[b]], 1)


def _spread(lo: np.ndarray, hi: np.ndarray):
    """(i, j): each i with lo[i] .. hi[i] - 1, PAIRS_AT_ONCE or one more row of them at a time."""
    n = np.maximum(hi - lo, 0)
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        c = n[at:to]
        yield np.repeat(np.arange(at, to), c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - lo[at:to], c)
        at = to


def _joined(parts: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    return np.concatenate([like[:0], *parts])


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows, in their order."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, back = np.unique(c, return_inverse=True)
        code = np.unique(code * max(len(values), 1) + back, return_inverse=True)[1]
    return code


def _meet(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """_meeting() of sides in arrays: (number of the pair, side 0 or 1, place)."""
    out, touched = [], np.zeros(len(a), bool)
    for s, o, side in ((a, b, 0), (b, a, 1)):
        d = (s[:, 2:] - s[:, :2]).astype(float)
        size2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
        for p in (o[:, :2], o[:, 2:]):
            e = (p - s[:, :2]).astype(float)
            t = e[:, 0] * d[:, 0] + e[:, 1] * d[:, 1]
            is_end = (p == s[:, :2]).all(1) | (p == s[:, 2:]).all(1)
            on = np.flatnonzero((t > 0) & (t < size2) & (np.abs(e[:, 0] * d[:, 1] - e[:, 1] * d[:, 0]) <= np.sqrt(size2)) & ~is_end)
            out.append((on, side, p[on]))
            touched[on] = True
    r, q, s = ((w[:, 2:] - w[:, :2]).astype(float) if k else (b[:, :2] - a[:, :2]).astype(float) for w, k in ((a, 1), (a, 0), (b, 1)))
    det = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    ok = np.flatnonzero(~touched & (det != 0))
    r, q, s, det = r[ok], q[ok], s[ok], det[ok]
    t, u = (q[:, 0] * s[:, 1] - q[:, 1] * s[:, 0]) / det, (q[:, 0] * r[:, 1] - q[:, 1] * r[:, 0]) / det
    cut = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    step = t[cut, None] * r[cut]
    place = a[ok[cut], :2] + (np.sign(step) * np.floor(np.abs(step) + 0.5)).astype(np.int64)
    return [*out, (ok[cut], 0, place), (ok[cut], 1, place)]


def _outlines(g: np.ndarray, polygon: np.ndarray, side: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """outline() of groups in arrays: (group, directed pieces), from the sides of each group's polygons."""
    # Sides of a group that may meet, by their western ends.
    west, east = np.minimum(side[:, 0], side[:, 2]), np.maximum(side[:, 0], side[:, 2])
    low, high = np.minimum(side[:, 1], side[:, 3]), np.maximum(side[:, 1], side[:, 3])
    order = np.lexsort((west, g))
    g, polygon, side, west, east, low, high = (c[order] for c in (g, polygon, side, west, east, low, high))
    origin, wide = west.min(initial=0), int(east.max(initial=0) - west.min(initial=0)) + 4
    place = _dense(g) * wide + (west - origin)
    last = np.searchsorted(place, place - (west - origin) + np.minimum(east - origin + 2, wide - 1), "right")
    ours, at = [], []
    for i, j in _spread(np.arange(1, len(g) + 1), last):
        near = (polygon[i] != polygon[j]) & (low[i] <= high[j] + 2) & (low[j] <= high[i] + 2)
        i, j = i[near], j[near]
        for k, which, p in _meet(side[i], side[j]):
            ours.append((j if which else i)[k])
            at.append(p)
    # Each side's corners and cuts in their order along it, cut into pieces.
    every = np.arange(len(g))
    d = (side[:, 2:] - side[:, :2]).astype(float)
    along = lambda k, p: (p[:, 0] - side[k, 0]).astype(float) * d[k, 0] + (p[:, 1] - side[k, 1]).astype(float) * d[k, 1]
    k, p = _joined(ours, every), np.concatenate([np.zeros((0, 2), np.int64), *at])
    t, end = along(k, p), along(every, side[:, 2:])
    inner = (t > 0) & (t < end[k])
    k, p, t = np.concatenate([every, every, k[inner]]), np.concatenate([side[:, :2], side[:, 2:], p[inner]]), np.concatenate([np.zeros(len(g)), end, t[inner]])
    order = np.lexsort((p[:, 1], p[:, 0], t, k))
    k, p = k[order], p[order]
    piece = np.flatnonzero((k[1:] == k[:-1]) & (p[1:] != p[:-1]).any(1))
    k, a, b = k[piece], p[piece], p[piece + 1]
    # Equal pieces are one; those with polygons on one side only may be on the outline.
    ahead = (a[:, 0] < b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] < b[:, 1]))
    a, b = np.where(ahead[:, None], a, b), np.where(ahead[:, None], b, a)
    order = np.lexsort((polygon[k], b[:, 1], b[:, 0], a[:, 1], a[:, 0], g[k]))
    k, a, b, ahead = k[order], a[order], b[order], ahead[order]
    differ = (g[k[1:]] != g[k[:-1]]) | (a[1:] != a[:-1]).any(1) | (b[1:] != b[:-1]).any(1)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), differ]))
    number = np.cumsum(np.concatenate([np.zeros(min(len(k), 1), np.int64), differ.astype(np.int64)]))
    left, right = (np.logical_or.reduceat(w, first) if len(first) else w for w in (ahead, ~ahead))
    single = left != right
    polygons = int(polygon.max(initial=0)) + 1
    own = (number * polygons + polygon[k])[single[number]]  # sorted, as pieces and their polygons are
    kept = np.flatnonzero(single)
    pg, a, b, left = g[k[first[kept]]], a[first[kept]], b[first[kept]], left[kept]
    # Polygons around a piece's middle: of the sides west of it, in its band of latitude, those that go down less those that go up, as polygons lie on the left.
    mx, my = (a[:, 0] + b[:, 0]) / 2.0, (a[:, 1] + b[:, 1]) / 2.0
    wall = np.flatnonzero(side[:, 1] != side[:, 3])
    south, north = (np.floor(c[wall] / size).astype(np.int64) for c in (low, high))
    base = int(min(south.min(initial=0), np.floor(my / size).min(initial=0)))
    tall = int(max(north.max(initial=0), np.floor(my / size).max(initial=0))) - base + 1
    wall, band = np.repeat(wall, north - south + 1), np.concatenate([np.arange(s, n + 1) for s, n in zip(south.tolist(), north.tolist())] or [south])
    groups = np.unique(g)
    code = np.searchsorted(groups, g[wall]) * tall + band - base
    order = np.argsort(code, kind="stable")
    wall, code = wall[order], code[order]
    asked = np.searchsorted(groups, pg) * tall + np.floor(my / size).astype(np.int64) - base
    around = np.zeros(len(kept), np.int64)
    sx, sy, ex, ey = side.T
    for i, j in _spread(np.searchsorted(code, asked), np.searchsorted(code, asked, "right")):
        j = wall[j]
        spans = np.flatnonzero((sy[j] > my[i]) != (ey[j] > my[i]))
        i, j = i[spans], j[spans]
        hit = np.flatnonzero(sx[j] + (ex[j] - sx[j]) * ((my[i] - sy[j]) / (ey[j] - sy[j])) < mx[i])
        i, j = i[hit], j[hit]
        mine = kept[i] * polygons + polygon[j]
        at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
        other = own[at] != mine
        i, j = i[other], j[other]
        np.add.at(around, i, np.where(ey[j] < sy[j], 1, -1))
    free = around == 0
    a, b, left = a[free], b[free], left[free]
    return pg[free], np.where(left[:, None], np.concatenate([a, b], 1), np.concatenate([b, a], 1))


def _unions(t: pa.Table, g: np.ndarray, row: np.ndarray, grid: float, size: float):
    """Unions of groups of a table's polygons (_ring, _holes, _id): batches of numbers of groups, and _columns() of their parts.

    ``g`` numbers the group of each polygon and ascends, ``row`` is the polygon's row.
    """
    name = np.asarray(t.column("_id"))[row]
    order = np.lexsort((name, g))
    g, row, name = g[order], row[order], name[order]
    one = np.concatenate([np.ones(min(len(g), 1), bool), (g[1:] != g[:-1]) | (name[1:] != name[:-1])])
    g, row = g[one], row[one]
    ring, side = _ring_sides(t.column("_ring"), 1.0, grid)
    holes = t.column("_holes").combine_chunks()
    if holes.null_count < len(holes):
        of = np.asarray(holes.value_parent_indices())
        inner, more = _ring_sides(holes.flatten(), -1.0, grid)
        known = np.asarray(t.column("_ring").is_valid())[of[inner]]
        ring, side = np.concatenate([ring, of[inner][known]]), np.concatenate([side, more[known]])
        order = np.argsort(ring, kind="stable")
        ring, side = ring[order], side[order]
    first, stop = np.searchsorted(ring, row), np.searchsorted(ring, row, "right")
    ends = np.cumsum(stop - first)
    heads = np.flatnonzero(np.concatenate([np.ones(min(len(g), 1), bool), g[1:] != g[:-1]]))
    at = 0
    while at < len(g):
        # So many whole groups as have the sides of a step, one at least.
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SIDES_AT_ONCE, "right"))
        below = heads[np.searchsorted(heads, at) + 1 : np.searchsorted(heads, to, "right")]
        if to >= len(g):
            to = len(g)
        elif len(below):
            to = int(below[-1])
        else:
            following = heads[heads > at]
            to = int(following[0]) if len(following) else len(g)
        n = (stop - first)[at:to]
        k = np.repeat(np.arange(at, to), n)
        if len(k):
            s = side[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[at:to], n)]
            pg, pieces = _outlines(g[k], k - at, s, size)
            order = np.argsort(pg, kind="stable")
            pg, pieces = pg[order], pieces[order]
            cut = np.flatnonzero(pg[1:] != pg[:-1]) + 1
            found = [_parts(x, grid) for x in np.split(pieces, cut)] if len(pg) else []
            names = pg[np.concatenate([[0], cut])] if len(pg) else pg
            yield np.repeat(names, [len(ps) for ps, _ in found]).astype(np.int64), _columns(found, grid)
        at = to


def _result(df: DataFrame, by: list[str], levels: bool) -> T.StructType:
    out = T.StructType([df.schema[c] for c in by])
    if levels:
        out = out.add("lower", T.DoubleType()).add("upper", T.DoubleType())
    return out.add("part", T.IntegerType()).add("ring", T.ArrayType(POINT)).add("holes", T.ArrayType(T.ArrayType(POINT))).add("area", T.DoubleType()).add("loose", T.IntegerType())


def _split(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None, int]:
    """(polygons of keys with at most TOGETHER corners, those of the others if there are any, tasks for the first)."""
    holes = F.coalesce(F.aggregate("holes", F.lit(0), lambda n, h: n + F.coalesce(F.size(h), F.lit(0))), F.lit(0)) if "holes" in df.columns else F.lit(0)
    each = df.groupBy(F.struct(*by).alias("_large")).agg(F.sum(F.coalesce(F.size("ring"), F.lit(0)) + holes).alias("_n"))
    corners, most = each.agg(F.sum("_n"), F.max("_n")).first()
    tasks = max(1, min(MOST_TASKS, -(-(corners or 0) // TASK_CORNERS)))
    if (most or 0) <= TOGETHER:
        return df, None, tasks
    large = F.broadcast(materialize(each.filter(F.col("_n") > TOGETHER).select("_large")))  # few, as each has many corners
    same = F.struct(*by) == F.col("_large")
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi"), tasks


def _together(df: DataFrame, by: list[str], tasks: int, schema: T.StructType, grid: float, cell: float, extra: list[str], groups) -> DataFrame:
    """Unions of the polygons of whole keys; ``groups`` of a table and the bounds of its keys gives numbers of the groups, rows of polygons in them, and the groups' own columns."""
    holes = F.col("holes") if "holes" in df.columns else F.lit(None).cast(HOLES)
    flat = lambda ring: F.flatten(F.transform(ring, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    sent = df.select(*by, *extra, flat(F.col("ring")).alias("_ring"), F.transform(holes, flat).alias("_holes"))
    sent = sent.repartition(tasks, *by).sortWithinPartitions(*by).withColumn("_id", F.xxhash64("_ring", "_holes"))
    size, made = cell / grid, to_arrow_schema(schema)

    def run(batches):
        for t, starts in whole_flights(batches, by):
            t = t.combine_chunks()
            g, row, own = groups(t, starts)
            for at, columns in _unions(t, g, row, grid, size):
                of = own.take(pa.array(at))
                values = [*of.columns, *columns]
                yield from pa.table([c.cast(f.type) for c, f in zip(values, made)], schema=made).combine_chunks().to_batches()

    return sent.mapInArrow(run, schema)


def union(df: DataFrame, by: list[str], grid: float = GRID, cell: float = CELL) -> DataFrame:
    """by, part, ring, holes, area, loose: the parts of the union of each key's polygons.

    Polygons: ring (array of struct x, y: simple, either way round, closed or
    not) and, if there are any, holes (array of rings).  Corners move to a grid
    of ``grid`` degrees; ``area`` is in square degrees.  Outer rings run
    counterclockwise, holes clockwise, corners on straight lines are left out.
    Polygons that touch in a corner only are different parts.  Null and flat
    rings count as none; repeated polygons count once; a key without any has no
    row.  ``loose`` counts pieces of the outline that close no ring: 0 but for
    polygons that nearly touch within a step of the grid.
    """
    few, many, tasks = _split(df, by)
    whole = lambda t, starts: (np.repeat(np.arange(len(starts) - 1), np.diff(starts)), np.arange(t.num_rows), t.select(by).take(pa.array(starts[:-1])))
    out = _together(few, by, tasks, _result(df, by, False), grid, cell, [], whole)
    return out if many is None else out.unionByName(_over_cluster(many, by, grid, cell))


def _over_cluster(df: DataFrame, by: list[str], grid: float, cell: float) -> DataFrame:
    """union() of keys of any size: outline() over the cluster, then a group for each key's outline."""
    schema = _result(df, by, False)

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, loose = _parts(pdf[_SIDE].to_numpy(np.int64), grid)
        points = lambda r: [{"x": x * grid, "y": y * grid} for x, y in r.tolist()]
        out = pd.DataFrame({
            "part": range(len(parts)), "ring": [points(r) for r, _, _ in parts], "holes": [[points(h) for h in hs] for _, hs, _ in parts],
            "area": [a for _, _, a in parts], "loose": loose,
        })
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[schema.names]

    return outline(df, by, grid, cell).groupBy(*by).applyInPandas(assemble, schema)


def union_levels(layers: DataFrame, by: list[str], grid: float = GRID, cell: float = CELL) -> DataFrame:
    """union() of an airspace's layers (ring, lower, upper) between each two of its bounds: by, lower, upper, part, ring, holes, area.

    Neighbouring slabs with the same layers are one; bounds that are null are
    taken as unlimited, and rows whose key is null are left out.
    """
    wide = layers.select(*by, "ring", F.coalesce(F.col("lower").cast("double"), F.lit(-math.inf)).alias("lower"), F.coalesce(F.col("upper").cast("double"), F.lit(math.inf)).alias("upper"))
    few, many, tasks = _split(wide.dropna(subset=by), by)
    out = _together(few, by, tasks, _result(wide, by, True), grid, cell, ["lower", "upper"], lambda t, starts: _slabs(t, starts, by))
    if many is None:
        return out
    many = many.withColumn("_layer", F.xxhash64("ring", "lower", "upper"))
    cut = slabs(many, by, "_layer").select(*by, "lower", "upper", F.explode("layers").alias("_layer"))
    rings = many.select(*by, "_layer", "ring").dropDuplicates([*by, "_layer"])
    return out.unionByName(union(cut.join(rings.hint("merge"), [*by, "_layer"]), [*by, "lower", "upper"], grid, cell))


def _slabs(t: pa.Table, starts: np.ndarray, by: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """slabs() of whole keys in arrays: number of the slab and row of each layer in it, and the slabs' key, lower and upper."""
    lower, upper, name = (np.asarray(t.column(c)) for c in ("lower", "upper", "_id"))
    rows, sizes, key, lo, hi = [], [], [], [], []
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        one = a + np.lexsort((name[a:b], upper[a:b], lower[a:b]))
        same = (lower[one[1:]] == lower[one[:-1]]) & (upper[one[1:]] == upper[one[:-1]]) & (name[one[1:]] == name[one[:-1]])
        one = one[np.concatenate([[True], ~same])]
        cuts = np.unique(np.concatenate([lower[one], upper[one]]))
        before = None
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            inside = one[(lower[one] <= s) & (upper[one] >= e)]
            if not len(inside):
                before = None
            elif before is not None and len(before) == len(inside) and (before == inside).all():
                hi[-1] = e
            else:
                rows.append(inside)
                sizes.append(len(inside))
                key.append(k)
                lo.append(s)
                hi.append(e)
                before = inside
    own = t.select(by).take(pa.array(starts[np.array(key, np.int64)]))
    own = own.append_column("lower", pa.array(lo, pa.float64())).append_column("upper", pa.array(hi, pa.float64()))
    return np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64)), np.concatenate([np.zeros(0, np.int64), *rows]), own
