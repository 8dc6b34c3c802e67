"""Rows along a ground network: the likeliest chain of edges, and a filter that the network draws in.

The network is a table throughout: rows meet edges by cell, and distances over
the network are computed between nodes within a limit, by joins.  Only the
recurrence along a flight runs in numpy, on that flight's candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import cells
from .grouped import beside, whole_flights
from .joins import small
from .keys import TIME
from .scratch import discard, materialize


def placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (edge, u, v) with the places x1, y1, x2, y2 of their ends and the length between them; nodes: node, x, y."""
    end = lambda c, k: nodes.select(F.col("node").alias(c), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    both = edges.select("edge", "u", "v").join(end("u", 1), "u").join(end("v", 2), "v")
    return both.withColumn("length", F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))).select("edge", "u", "v", "x1", "y1", "x2", "y2", "length")


def node_distances(edges: DataFrame, limit: float) -> DataFrame:
    """(a, b, d): shortest ways between nodes that are ``limit`` metres apart or less, both directions, a node to itself included.

    Known ways are joined with each other, so each round doubles the number of
    edges a way may have.  The table grows with the network and with what lies
    within the limit of a node, not with the square of the network.
    """
    steps = edges.filter(F.col("length") <= limit).select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("length").alias("d"))
    steps = steps.unionByName(steps.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    own = edges.select(F.explode(F.array("u", "v")).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("d"))
    shortest = lambda d: d.groupBy("a", "b").agg(F.min("d").alias("d"))
    near = materialize(shortest(steps.unionByName(own)))
    while True:
        onward = near.select(F.col("a").alias("m"), F.col("b").alias("to"), F.col("d").alias("e"))
        longer = near.join(onward, F.col("b") == F.col("m")).select("a", F.col("to").alias("b"), (F.col("d") + F.col("e")).alias("d")).filter(F.col("d") <= limit)
        new = materialize(shortest(longer.unionByName(near)))
        old = near.withColumnRenamed("d", "old")
        changed = new.join(old, ["a", "b"], "left").filter(F.col("old").isNull() | (F.col("d") < F.col("old"))).limit(1).count()
        discard(near)
        near = new
        if not changed:
            return near


def edge_distances(edges: DataFrame, limit: float) -> DataFrame:
    """(e, f, uu, uv, vu, vv): shortest ways between the ends of two edges; null beyond the limit."""
    near = node_distances(edges, limit)
    ends = edges.select("edge", F.explode(F.array(F.struct(F.lit("u").alias("s"), F.col("u").alias("n")), F.struct(F.lit("v").alias("s"), F.col("v").alias("n")))).alias("x")).select("edge", "x.s", "x.n")
    a, b = ends.toDF("e", "s", "a"), ends.toDF("f", "t", "b")
    met = near.join(a, "a").join(b, "b").filter("e <> f")
    part = lambda s, t: F.min(F.when((F.col("s") == s) & (F.col("t") == t), F.col("d"))).alias(s + t)
    return met.groupBy("e", "f").agg(part("u", "u"), part("u", "v"), part("v", "u"), part("v", "v"))


def _lists(edges: DataFrame, reach: float, size: float, name: str, *cols: str) -> DataFrame:
    """(_cell, array of edges as structs) of the cells that edges reach."""
    box = cells.box_cells(F.least("x1", "x2") - reach, F.least("y1", "y2") - reach, F.greatest("x1", "x2") + reach, F.greatest("y1", "y2") + reach, size)
    return edges.select(F.struct(*cols).alias("_e"), F.explode(box).alias("_cell")).groupBy("_cell").agg(F.array_sort(F.collect_list("_e")).alias(name))


def _foot(e: Column, x: str, y: str) -> tuple[Column, Column]:
    """(share of the edge's length, metres away) of the point of an edge that is nearest to a place."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = F.when(e["length"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(x) - e["x1"]) * dx + (F.col(y) - e["y1"]) * dy) / (dx * dx + dy * dy)))).otherwise(F.lit(0.0))
    return t, F.hypot(F.col(x) - e["x1"] - t * dx, F.col(y) - e["y1"] - t * dy)


def with_edges(df: DataFrame, edges: DataFrame, reach: float, name: str = "_near", x: str = "x", y: str = "y") -> DataFrame:
    """Adds an array of the edges within ``reach`` metres of each row (edge, u, v, off: metres from u, away: metres from the edge), by edge; null positions have none."""
    size = 4.0 * reach
    lists = _lists(edges, reach, size, "_all", "edge", "u", "v", "x1", "y1", "x2", "y2", "length")
    j = df.withColumn("_cell", cells.plane_cell(y, x, size)).join(small(lists), "_cell", "left")

    def to_edge(e: Column) -> Column:
        t, away = _foot(e, x, y)
        return F.struct(e["edge"].alias("edge"), e["u"].alias("u"), e["v"].alias("v"), (t * e["length"]).alias("off"), (e["length"] * (1 - t)).alias("rest"), away.alias("away"))

    found = F.filter(F.transform(F.coalesce("_all", F.array()), to_edge), lambda e: e["away"] <= reach)
    return j.withColumn(name, found).drop("_cell", "_all")


def viterbi(row: np.ndarray, k: np.ndarray, before: np.ndarray, emission: np.ndarray, move: np.ndarray) -> dict[int, int]:
    """Candidate of each row on the cheapest chain; entries (row, candidate, candidate of the row before or -1) in that order.

    Costs are whole numbers.  Equal ones are decided for the smaller candidates, from the end.
    """
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    cost, back, rows = np.zeros(0, np.int64), [], row[first]
    for a, b in zip(first, np.append(first[1:], len(row))):
        n = k[b - 1] + 1
        total = (move[a:b] + (cost[before[a:b]] if len(cost) else 0)).reshape(n, -1)
        best = total.argmin(axis=1)
        back.append(best)
        cost = total[np.arange(n), best] + emission[a:b].reshape(n, -1)[:, 0]
    out, at = {}, int(cost.argmin())
    for r, b in zip(rows[::-1].tolist(), back[::-1]):
        out[r] = at
        at = int(b[at])
    return out


def match(df: DataFrame, by: list[str], nodes: DataFrame, edges: DataFrame, reach: float = 50.0, limit: float = 500.0, sigma: float = 10.0, beta: float = 20.0, lost: float = 25.0, x: str = "x", y: str = "y") -> DataFrame:
    """Adds edge, edge_offset (metres from its u) and edge_distance (metres): the likeliest chain of edges of each flight.

    A hidden Markov model: a row's states are the edges within ``reach``, which
    cost (distance / sigma)**2 / 2; a move costs the difference between the
    way over the network and the straight line, divided by ``beta``, or
    ``lost`` where no way within ``limit`` is known.  Rows with no edge in
    reach get nulls and are stepped over.  All costs are computed by joins, a
    row for each pair of neighbouring candidates; flights share Arrow batches.
    """
    order = [TIME] + [c for c in ("event_id",) if c in df.columns]
    roads = materialize(placed(nodes, edges))
    numbered = df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    rows = materialize(with_edges(numbered, roads, reach, "_near", x, y))
    on = W.partitionBy(*by).orderBy("_r")
    seen = rows.filter(F.size("_near") > 0).select(*by, "_r", "_near", F.col(x).alias("_x"), F.col(y).alias("_y"))
    seen = seen.withColumns({"_prev": F.lag("_near").over(on), "_far": F.hypot(F.col("_x") - F.lag("_x").over(on), F.col("_y") - F.lag("_y").over(on))})
    states = seen.select(*by, "_r", "_far", "_prev", F.posexplode("_near").alias("_k", "_c"))
    pairs = states.select(*by, "_r", "_far", "_k", "_c", F.posexplode_outer("_prev").alias("_pk", "_p"))
    gaps = edge_distances(roads, limit)
    met = pairs.join(small(gaps), (F.col("_p.edge") == F.col("e")) & (F.col("_c.edge") == F.col("f")), "left")
    ways = [F.col(f"_p.{'off' if s == 'u' else 'rest'}") + F.col(s + t) + F.col(f"_c.{'off' if t == 'u' else 'rest'}") for s in "uv" for t in "uv"]
    road = F.when(F.col("_p.edge") == F.col("_c.edge"), F.abs(F.col("_p.off") - F.col("_c.off"))).otherwise(F.least(*ways))
    move = F.when(F.col("_pk").isNull(), 0.0).when(road <= limit, F.least(F.lit(float(lost)), F.abs(road - F.col("_far")) / beta)).otherwise(float(lost))
    whole = lambda c: F.round(c * 1e6).cast("long")  # noqa: E731 - chains of the same cost tie exactly, in whatever order it is summed
    costs = met.select(*by, "_r", "_k", F.coalesce("_pk", F.lit(-1)).alias("_pk"), whole(F.pow(F.col("_c.away") / sigma, 2) / 2).alias("_emission"), whole(move).alias("_move"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_flights(batches, by):
            columns = [rows.column(c).to_numpy() for c in ("_r", "_k", "_pk", "_emission", "_move")]
            paths = [viterbi(*(c[a:b] for c in columns)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            keys = rows.select(by).take(pa.array(np.repeat(ends[:-1], [len(p) for p in paths])))
            at = [pa.array([i for p in paths for i in f(p)], pa.int32()) for f in (dict.keys, dict.values)]
            yield from keys.append_column("_r", at[0]).append_column("_at", at[1]).combine_chunks().to_batches()

    schema = T.StructType([df.schema[c] for c in by]).add("_r", T.IntegerType()).add("_at", T.IntegerType())
    found = costs.repartition(*by).sortWithinPartitions(*by, "_r", "_k", "_pk").mapInArrow(chain, schema)
    same = [rows[c].eqNullSafe(found[c]) for c in by] + [rows["_r"] == found["_r"]]
    out = rows.join(found, same, "left").select(*[rows[c] for c in df.columns], F.get(rows["_near"], found["_at"]).alias("_on"))
    return out.select(*df.columns, F.col("_on.edge").alias("edge"), F.col("_on.off").alias("edge_offset"), F.col("_on.away").alias("edge_distance"))


def network_filter(t: np.ndarray, z: np.ndarray, pieces: list[np.ndarray], noise: tuple[float, ...] = (4.0, 4.0, 2.0, 2.0), bind: float = 1.0, smooth: bool = True) -> np.ndarray:
    """States (x, y, vx, vy) at times t (s) from measured ones (NaN: unknown) and the straight pieces near each row (m x 4: x1, y1, x2, y2).

    After the measured values, the distance of the state from the piece that
    is nearest to the measured place (to the predicted one, where that is
    unknown) counts as a measured zero with deviation ``bind``.  Rows without
    pieces take those of the row before.
    """
    many = [np.asarray(p, float).reshape(-1, 4) for p in pieces]
    return network_filters(t, z, np.concatenate([*many, np.zeros((0, 4))]), np.array([len(p) for p in many], np.int64), np.array([0, len(t)]), noise, bind, smooth)


def network_filters(t: np.ndarray, z: np.ndarray, pieces: np.ndarray, count: np.ndarray, ends: np.ndarray, noise: tuple[float, ...] = (4.0, 4.0, 2.0, 2.0), bind: float = 1.0, smooth: bool = True) -> np.ndarray:
    """network_filter() of flights side by side: all k-th rows are one step.

    Rows of flight i go from ends[i] to before ends[i + 1]; pieces are those of
    all rows one after the other, ``count`` of each row.
    """
    n, r = len(t), np.square(noise)
    size = np.diff(ends)
    longest = np.argsort(-size, kind="stable")
    first, size = ends[:-1][longest], size[longest]
    # The row whose pieces count for a row: itself, else the last one of the flight before it that has any.
    start = np.repeat(ends[:-1], np.diff(ends))
    source = np.maximum.accumulate(np.where(count > 0, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    begin = np.cumsum(count) - count
    fs, ps, pp = (np.zeros((n, 4, 4)) for _ in range(3))
    xs, xp = np.zeros((n, 4)), np.zeros((n, 4))
    turned = lambda m: m.transpose(0, 2, 1)
    for k in range(int(size[0]) if len(size) else 0):
        at = first[: np.searchsorted(-size, -k)] + k
        m, known = len(at), ~np.isnan(z[at])
        f = np.tile(np.eye(4), (m, 1, 1))
        if k:
            dt = t[at] - t[at - 1]
            f[:, 0, 2] = f[:, 1, 3] = dt
            # White acceleration of 0.5 m/s2 and little more on the places themselves.
            q = np.zeros((m, 4, 4))
            q[:, 0, 0] = q[:, 1, 1] = 0.25 * dt**3 / 3 + 0.05 * dt
            q[:, 0, 2] = q[:, 2, 0] = q[:, 1, 3] = q[:, 3, 1] = 0.25 * dt**2 / 2
            q[:, 2, 2] = q[:, 3, 3] = 0.25 * dt
            x, p = (f @ xs[at - 1][:, :, None])[:, :, 0], f @ ps[at - 1] @ turned(f) + q
        else:
            x, p = np.where(known, z[at], 0.0), np.eye(4) * np.where(known, r, 1e6)[:, None, :]
        fs[at], xp[at], pp[at] = f, x, p
        if k:
            # Unknown values measure nothing: their rows are those of the unit matrix, their gain is zero.
            both = known[:, :, None] & known[:, None, :]
            s = np.where(both, p, 0.0) + np.eye(4) * np.where(known, r, 1.0)[:, None, :]
            gain = turned(np.linalg.solve(s, np.where(known[:, :, None], p, 0.0)))
            left = np.eye(4) - gain * known[:, None, :]
            x = x + (gain @ np.where(known, z[at] - x, 0.0)[:, :, None])[:, :, 0]
            p = left @ p @ turned(left) + (gain * r) @ turned(gain)
        drawn = np.flatnonzero(source[at] >= start[at])
        if len(drawn):
            here = source[at[drawn]]
            c = count[here]
            row, j = np.repeat(np.arange(len(drawn)), c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            near = pieces[begin[here][row] + j]
            a, d = near[:, :2], near[:, 2:] - near[:, :2]
            share = lambda w, a, d: np.clip(((w - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-12), 0, 1)
            placed_ = known[drawn, :2].all(1)
            w = np.where(placed_[:, None], z[at[drawn], :2], xp[at[drawn], :2])[row]
            off = np.hypot(*(a + d * share(w, a, d)[:, None] - w).T)
            order = np.lexsort((j, off, row))
            one = order[np.cumsum(c) - c]  # the nearest piece of each row, the first of equal ones
            a, d = a[one], d[one]
            u = share(x[drawn, :2], a, d)
            away = x[drawn, :2] - a - u[:, None] * d
            # Beside a piece the direction is the piece's normal, which is there on the line too.
            normal = np.where(((u > 0) & (u < 1))[:, None], np.column_stack([-d[:, 1], d[:, 0]]), away)
            length = np.hypot(*normal.T)
            some = length > 1e-9
            drawn, away, h = drawn[some], away[some], np.zeros((int(some.sum()), 4))
            h[:, :2] = normal[some] / length[some, None]
            ph = (p[drawn] @ h[:, :, None])[:, :, 0]
            gain = ph / ((h * ph).sum(1) + bind**2)[:, None]
            x[drawn] -= gain * (h[:, :2] * away).sum(1)[:, None]
            p[drawn] -= gain[:, :, None] * (h[:, None, :] @ p[drawn])
        xs[at], ps[at] = x, p
    if smooth:
        for k in range(int(size[0]) - 2 if len(size) else -1, -1, -1):
            at = first[: np.searchsorted(-size, -(k + 1))] + k
            gain = turned(np.linalg.solve(turned(pp[at + 1]), turned(ps[at] @ turned(fs[at + 1]))))
            xs[at] += (gain @ (xs[at + 1] - xp[at + 1])[:, :, None])[:, :, 0]
    return xs


def kalman_network(df: DataFrame, by: list[str], nodes: DataFrame, edges: DataFrame, reach: float = 100.0, bind: float = 1.0, smooth: bool = True) -> DataFrame:
    """Filters x, y (m), groundspeed (kt) and track of flights on the ground, drawn to the edges within ``reach`` of each row."""
    kt = 1852 / 3600
    roads = placed(nodes, edges)
    size = 4.0 * reach
    lists = _lists(roads, reach, size, "_all", "x1", "y1", "x2", "y2", "length")
    within = F.filter(F.coalesce("_all", F.array()), lambda e: _foot(e, "x", "y")[1] <= reach)
    flat = F.flatten(F.transform(within, lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])))
    rows = df.withColumn("_cell", cells.plane_cell("y", "x", size)).join(small(lists), "_cell", "left").withColumn("_roads", flat).drop("_cell", "_all")

    schema = T.StructType([c for c in rows.schema.fields if c.name != "_roads"])
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_flights(batches, by):
            x, y, knots, track = (table.column(c).to_numpy().astype(float) for c in ("x", "y", "groundspeed", "track"))
            a, v = np.radians(track), knots * kt
            near = table.column("_roads").combine_chunks()
            count = np.asarray(pc.fill_null(pc.list_value_length(near), 0)).astype(np.int64) // 4
            t = table.column(TIME).cast(pa.int64()).to_numpy() / 1e6
            s = network_filters(t, np.column_stack([x, y, v * np.sin(a), v * np.cos(a)]), np.asarray(near.flatten(), float).reshape(-1, 4), count, ends, bind=bind, smooth=smooth)
            new = {"x": s[:, 0], "y": s[:, 1], "groundspeed": np.hypot(s[:, 2], s[:, 3]) / kt, "track": np.degrees(np.arctan2(s[:, 2], s[:, 3])) % 360}
            yield from pa.table({c: pa.array(new[c], made.field(c).type) if c in new else table.column(c) for c in schema.names}).combine_chunks().to_batches()

    return beside(rows, by).mapInArrow(run, schema)
