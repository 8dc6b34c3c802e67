"""Sequential algorithms that windows can't express: one flight at a time, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.timeunits import micros
from .keys import TIME


class Flight:
    """One flight's columns as arrays, in time order; times are whole microseconds, and numbers with nulls are floats."""

    def __init__(self, columns: Columns, start: int, stop: int):
        self.columns, self.start, self.stop = columns, start, stop

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name][self.start : self.stop]

    def __len__(self) -> int:
        return self.stop - self.start


class Columns(dict):
    """Arrays of a table's columns, made when they are first asked for."""

    def __init__(self, table: pa.Table):
        self.table = table

    def __missing__(self, name: str) -> np.ndarray:
        column = self.table.column(name)
        self[name] = (column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column).to_numpy()
        return self[name]


def _cuts(rows: pa.Table, by: list[str]) -> np.ndarray:
    """Numbers of the rows whose key is not that of the row before; nulls are equal."""
    last = rows.num_rows - 1
    differ = np.zeros(max(last, 0), bool)
    for c in by if last > 0 else ():
        x, y = rows.column(c).slice(0, last), rows.column(c).slice(1)
        unlike = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y)))
        differ |= unlike.to_numpy()
    return np.flatnonzero(differ) + 1


def whole_flights(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole flights out of sorted batches, and where each flight begins and the last one ends."""

    def ended(parts: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.concat_tables(parts)
        return rows, np.concatenate([[0], _cuts(rows, by), [rows.num_rows]])

    open_: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        cuts = _cuts(pa.concat_tables([open_[-1].slice(open_[-1].num_rows - 1), rows]), by) - 1 if open_ else _cuts(rows, by)
        if len(cuts):
            yield ended([*open_, rows.slice(0, cuts[-1])])
            open_ = []
        open_.append(rows.slice(cuts[-1]) if len(cuts) else rows)
    if open_:
        yield ended(open_)


def beside(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a flight in one task, in time order, the flights one after the other."""
    order = [c for c in (TIME, "event_id") if c in df.columns and c not in by]
    return df.repartition(*by).sortWithinPartitions(*by, *order)


Change = tuple[np.ndarray | None, dict[str, np.ndarray]]


def per_flight(df: DataFrame, by: list[str], func: Callable[[Flight], Change], **new: str) -> DataFrame:
    """func on each flight in time order gives the numbers of the rows that stay (None: all) and columns for them.

    ``new`` columns by name and type are added to the schema.  Short flights
    share Arrow batches; a task holds a batch and the flight that goes on behind
    it.  Only the columns of ``df`` travel, so select first.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name not in new])
    for n, kind in new.items():
        schema = schema.add(n, kind)
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_flights(batches, by):
            columns, stay, changed = Columns(rows), [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                at, values = func(Flight(columns, a, b))
                stay.append(np.arange(a, b) if at is None else at + a)
                changed.append(values)
            left = rows.take(pa.array(np.concatenate(stay)))
            out = {c: left.column(c) for c in left.column_names}
            for c in changed[0]:
                out[c] = pa.array(np.concatenate([v[c] for v in changed]), made.field(c).type, from_pandas=True)
            yield from pa.table({c: out[c] for c in schema.names}).combine_chunks().to_batches()

    return beside(df, by).mapInArrow(run, schema)


def pandas_flights(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """whole_flights() of pandas frames."""

    def cuts(keys: pd.DataFrame) -> np.ndarray:
        differ = np.zeros(len(keys), bool)
        for c in by:
            x, y = keys[c], keys[c].shift()
            differ |= ((x != y).fillna(True) & ~(x.isna() & y.isna())).to_numpy(bool)
        return np.flatnonzero(differ[1:]) + 1

    def ended(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        return rows, np.concatenate([[0], cuts(rows[by]), [len(rows)]])

    open_: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        at = cuts(pd.concat([open_[-1][by].iloc[-1:], pdf[by]])) - 1 if open_ else cuts(pdf[by])
        if len(at):
            yield ended([*open_, pdf.iloc[: at[-1]]])
            open_ = []
        open_.append(pdf.iloc[at[-1] :] if len(at) else pdf)
    if open_:
        yield ended(open_)


def flights_in_batches(df: DataFrame, by: list[str], func: Callable[[pd.DataFrame], pd.DataFrame], **new: str) -> DataFrame:
    """per_flight() for functions of pandas frames."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in new])
    for n, kind in new.items():
        schema = schema.add(n, kind)
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, ends in pandas_flights(batches, by):
            yield pd.concat([func(rows.iloc[a:b].reset_index(drop=True))[names] for a, b in zip(ends[:-1], ends[1:])])

    return beside(df, by).mapInPandas(run, schema)


def douglas_peucker(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the vertices that a simplified line keeps; points: n x 2 or n x 3."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    keep = np.zeros(len(points), bool)
    if not len(points):
        return keep
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.linalg.norm(base)
        if length == 0:
            off = np.linalg.norm(inner, axis=1)
        else:
            along = inner @ base / length
            off = np.sqrt(np.maximum(0, (inner**2).sum(1) - along**2))
        k = int(off.argmax())
        if off[k] > tolerance or (off[k] == tolerance and tolerance > 0):
            m = a + 1 + k
            keep[m] = True
            todo += [(a, m), (m, b)]
    return keep


def simplify(df: DataFrame, by: list[str], tolerance: float, x: str = "x", y: str = "y", z: str | None = None, z_factor: float = 3.048) -> DataFrame:
    """Rows that a Douglas-Peucker line through x, y (and z times z_factor) keeps."""

    def run(f: Flight) -> Change:
        cols = [f[x], f[y]] + ([f[z] * z_factor] if z else [])
        return np.flatnonzero(douglas_peucker(np.column_stack(cols).astype(float), tolerance)), {}

    return per_flight(df, by, run)


def sliding_windows(df: DataFrame, by: list[str], duration, step) -> DataFrame:
    """Rows by window: each starts at the first row after the last start plus ``step``; window counts from 0."""
    length, ahead = micros(duration), micros(step)

    def run(f: Flight) -> Change:
        t = f[TIME]
        out, start = [], 0
        while start < len(t):
            stop = int(np.searchsorted(t, t[start] + length, "left"))
            out.append(np.arange(start, stop))
            nxt = int(np.searchsorted(t, t[start] + ahead, "right"))
            start = max(nxt, start + 1)
        return np.concatenate(out), {"window": np.repeat(np.arange(len(out)), [len(w) for w in out])}

    return per_flight(df, by, run, window="long")


def _constant_velocity(dims: int) -> tuple[np.ndarray, np.ndarray]:
    f = np.eye(2 * dims)
    f[:dims, dims:] = np.eye(dims)
    return f, np.eye(2 * dims)


def _noise(z: np.ndarray, rows: int = 17) -> np.ndarray:
    """Variance of the difference from a trailing mean, by columns; one where fewer than two rows are known."""
    known = ~np.isnan(z)
    padded = np.zeros((2, len(z) + rows - 1, z.shape[1]))
    padded[0, rows - 1 :][known] = z[known]
    padded[1, rows - 1 :] = known
    total, n = np.lib.stride_tricks.sliding_window_view(padded, rows, axis=1).sum(-1)
    off = np.where(known, z - total / np.maximum(n, 1), 0.0)
    n = known.sum(0)
    mean = off.sum(0) / np.maximum(n, 1)
    var = (np.where(known, off - mean, 0.0) ** 2).sum(0) / np.maximum(n - 1, 1)
    return np.where(n > 1, var, 1.0) + 1e-6


def kalman(z: np.ndarray, smooth: bool = False, reject: float = 3.0) -> np.ndarray:
    """Constant-velocity filter (dt 1) over measured positions and speeds, n x 2d, NaN where unknown.

    Measurement noise is the variance of the difference from a trailing mean of
    17 rows; components further than ``reject`` deviations from the prediction
    are left out.  ``smooth`` adds a backward pass.
    """
    n, m = z.shape
    f, q = _constant_velocity(m // 2)
    noise = _noise(z)
    x = np.where(np.isnan(z[0]), 0.0, z[0])
    p = np.diag(noise) * 10
    xs, ps, xp, pp = [], [], [], []
    for k in range(n):
        if k:
            x, p = f @ x, f @ p @ f.T + q
        xp.append(x)
        pp.append(p)
        innovation = z[k] - x
        s = np.sqrt(np.diag(p) + noise)
        use = ~np.isnan(innovation) & (np.abs(innovation) <= reject * s)
        if use.any():
            h = np.eye(m)[use]
            gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.diag(noise[use]))
            x = x + gain @ innovation[use]
            p = (np.eye(m) - gain @ h) @ p
        xs.append(x)
        ps.append(p)
    xs = np.array(xs)
    if smooth:
        for k in range(n - 2, -1, -1):
            gain = ps[k] @ f.T @ np.linalg.inv(pp[k + 1])
            xs[k] = xs[k] + gain @ (xs[k + 1] - xp[k + 1])
    return xs


def kalman6d(df: DataFrame, by: list[str], smooth: bool = False) -> DataFrame:
    """Filters x, y (m), altitude (ft), groundspeed (kt), track and vertical_rate (ft/min) as positions and speeds in SI."""
    kt, ft = 1852 / 3600, 0.3048

    def run(f: Flight) -> Change:
        a = np.radians(f["track"].astype(float))
        v = f["groundspeed"].astype(float) * kt
        z = np.column_stack([f["x"], f["y"], f["altitude"] * ft, v * np.sin(a), v * np.cos(a), f["vertical_rate"] * ft / 60]).astype(float)
        s = kalman(z, smooth)
        return None, {
            "x": s[:, 0], "y": s[:, 1], "altitude": s[:, 2] / ft, "groundspeed": np.hypot(s[:, 3], s[:, 4]) / kt, "track": np.degrees(np.arctan2(s[:, 3], s[:, 4])) % 360, "vertical_rate": s[:, 5] * 60 / ft
        }

    return per_flight(df, by, run)


def ekf(z: np.ndarray, dt: np.ndarray, smooth: bool = True, reject: float = 3.0) -> np.ndarray:
    """Extended filter over (x, y, altitude, direction, speed, climb); direction in radians from east."""
    n = len(z)
    q = np.diag([25.0, 25.0, 25.0, 0.01, 4.0, 4.0])
    r = np.diag([400.0, 400.0, 400.0, 0.02, 9.0, 9.0])
    x, p = np.nan_to_num(z[0]).astype(float), r * 10

    def move(s, d):
        return np.array([s[0] + s[4] * np.cos(s[3]) * d, s[1] + s[4] * np.sin(s[3]) * d, s[2] + s[5] * d, s[3], s[4], s[5]])

    def slope(s, d):
        j = np.eye(6)
        j[0, 3], j[0, 4] = -s[4] * np.sin(s[3]) * d, np.cos(s[3]) * d
        j[1, 3], j[1, 4] = s[4] * np.cos(s[3]) * d, np.sin(s[3]) * d
        j[2, 5] = d
        return j

    turn = lambda a: (a + np.pi) % (2 * np.pi) - np.pi
    xs, ps, xp, pp, js = [x], [p], [x], [p], [np.eye(6)]
    for k in range(1, n):
        j = slope(x, dt[k])
        x, p = move(x, dt[k]), j @ p @ j.T + q
        xp.append(x)
        pp.append(p)
        js.append(j)
        e = z[k] - x
        e[3] = turn(e[3])
        use = ~np.isnan(e) & (np.abs(e) <= reject * np.sqrt(np.diag(p) + np.diag(r)))
        if use.any():
            h = np.eye(6)[use]
            gain = np.linalg.solve((h @ p @ h.T + h @ r @ h.T).T, (p @ h.T).T).T
            x, p = x + gain @ e[use], (np.eye(6) - gain @ h) @ p
        xs.append(x)
        ps.append(p)
    xs = np.array(xs)
    if smooth:
        for k in range(n - 2, -1, -1):
            gain = np.linalg.solve(pp[k + 1].T, (ps[k] @ js[k + 1].T).T).T
            d = xs[k + 1] - xp[k + 1]
            d[3] = turn(d[3])
            xs[k] = xs[k] + gain @ d
    return xs


def ekf_rts(df: DataFrame, by: list[str], smooth: bool = True) -> DataFrame:
    kt, ft = 1852 / 3600, 0.3048

    def run(f: Flight) -> Change:
        t = f[TIME] / 1e6
        dt = np.diff(t, prepend=t[0])
        z = np.column_stack([f["x"], f["y"], f["altitude"] * ft, np.radians(90 - f["track"]), f["groundspeed"] * kt, f["vertical_rate"] * ft / 60]).astype(float)
        s = ekf(z, dt, smooth)
        return None, {"x": s[:, 0], "y": s[:, 1], "altitude": s[:, 2] / ft, "track": (90 - np.degrees(s[:, 3])) % 360, "groundspeed": s[:, 4] / kt, "vertical_rate": s[:, 5] * 60 / ft}

    return per_flight(df, by, run)


def longest_consistent(ok: np.ndarray) -> np.ndarray:
    """Mask of a longest chain of rows in which each follows its predecessor consistently.

    ok[i, h]: row i + h + 1 may follow row i.  A chain's length is found from
    the back, row by row, over the horizon.
    """
    n, horizon = ok.shape
    length, nxt = np.ones(n, np.int64), np.full(n, -1)
    for i in range(n - 1, -1, -1):
        for h in range(min(horizon, n - 1 - i)):
            if ok[i, h] and length[i + h + 1] + 1 > length[i]:
                length[i], nxt[i] = length[i + h + 1] + 1, i + h + 1
    keep = np.zeros(n, bool)
    i = int(length.argmax()) if n else -1
    while i >= 0:
        keep[i] = True
        i = nxt[i]
    return keep


def consistency(df: DataFrame, by: list[str], horizon: int = 20, speed: float = 1.5, climb: float = 3000, turn: float = 90) -> DataFrame:
    """Adds ok: rows on a longest chain whose distance, climb and turn agree with the reported rates."""

    def run(f: Flight) -> Change:
        t = f[TIME] / 3.6e9
        lat, lon = np.radians(f["latitude"].astype(float)), np.radians(f["longitude"].astype(float))
        gs, alt, track = (f[c].astype(float) for c in ("groundspeed", "altitude", "track"))
        n = len(f)
        ok = np.zeros((n, horizon), bool)
        for h in range(min(horizon, n - 1)):
            i, j = slice(0, n - h - 1), slice(h + 1, n)
            a = np.sin((lat[j] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[j]) * np.sin((lon[j] - lon[i]) / 2) ** 2
            d = 2 * 6371000 / 1852 * np.arcsin(np.sqrt(np.minimum(1, a)))
            dt = np.maximum(t[j] - t[i], 1e-9)
            d_track = np.abs((track[j] - track[i] + 180) % 360 - 180)
            ok[: n - h - 1, h] = (d <= speed * np.maximum(gs[i], gs[j]) * dt + 0.5) & (np.abs(alt[j] - alt[i]) <= climb * dt * 60 + 100) & (d_track <= turn + 180 * dt)
        return None, {"ok": longest_consistent(ok)}

    return per_flight(df, by, run, ok="boolean")


def fuel(df: DataFrame, by: list[str], initial_mass: float | str = 60000.0, rate: Callable | None = None) -> DataFrame:
    """Adds fuelflow (kg/s) and mass: each row's mass is the last one's less what was burnt since.

    ``rate`` gives the flow from (mass, TAS kt, altitude ft, climb ft/min); the
    default is a drag polar of a medium jet.  ``initial_mass`` may name a column.
    """
    flow = rate or medium_jet

    def run(f: Flight) -> Change:
        t = f[TIME] / 1e6
        dt = np.diff(t, append=t[-1])
        m = float(f[initial_mass][0]) if isinstance(initial_mass, str) else float(initial_mass)
        ff, mass = np.empty(len(f)), np.empty(len(f))
        tas, alt, vs = (f[c].astype(float) for c in ("groundspeed", "altitude", "vertical_rate"))
        for k in range(len(f)):
            mass[k] = m
            ff[k] = flow(m, tas[k], alt[k], vs[k])
            m = max(m - ff[k] * dt[k], 1.0)
        return None, {"fuelflow": ff, "mass": mass}

    return per_flight(df, by, run, fuelflow="double", mass="double")


def medium_jet(mass: float, tas_kt: float, altitude_ft: float, climb_fpm: float) -> float:
    """Fuel flow from lift, drag and climb with textbook constants (wing 122 m2, polar 0.02 + 0.04 cl2)."""
    v, h = max(tas_kt * 1852 / 3600, 30.0), max(0.0, altitude_ft * 0.3048)
    rho = 1.225 * max(1 - 2.2558e-5 * h, 0.2) ** 4.2559
    dyn = 0.5 * rho * v * v * 122.0
    cl = mass * 9.80665 / dyn
    thrust = dyn * (0.02 + 0.04 * cl * cl) + mass * 9.80665 * (climb_fpm * 0.3048 / 60) / v
    return max(0.1, max(thrust, 0.0) * 1.6e-5)


# Emission indices in grams per kilogram of fuel.
EMISSION = {"CO2": 3149.0, "H2O": 1230.0, "SOx": 0.84, "NOx": 14.0, "CO": 2.0, "HC": 0.1}


def emission(df: DataFrame, by: list[str]) -> DataFrame:
    """Kilograms emitted so far per substance, from fuelflow and the time between rows."""
    from pyspark.sql import functions as F

    from ..functions.timeunits import us
    from .keys import ordered, running

    dt = F.coalesce((us(F.lead(TIME).over(ordered(df, by))) - us(TIME)) / 1e6, F.lit(0.0))
    df = df.withColumn("_kg", F.col("fuelflow") * dt)
    return df.withColumns({k: F.sum("_kg").over(running(df, by)) * v * 1e-3 for k, v in EMISSION.items()}).drop("_kg")


def apply_time(df: DataFrame, by: list[str], freq, kind: str = "double", **funcs: Callable[[Flight], float]) -> DataFrame:
    """Any function of a flight's rows per nearest time bucket, one column each; NaN is written as null."""
    from .aggregates import nearest

    keyed = df.withColumn("rounded", nearest(TIME, freq))
    schema = T.StructType([keyed.schema[c] for c in (*by, "rounded")])
    for n in funcs:
        schema = schema.add(n, kind)

    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_flights(batches, [*by, "rounded"]):
            columns = Columns(rows)
            each = [Flight(columns, a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            heads = rows.select([*by, "rounded"]).take(pa.array(ends[:-1]))
            for n, func in funcs.items():
                heads = heads.append_column(n, pa.array([func(f) for f in each], made.field(n).type, from_pandas=True))
            yield from heads.combine_chunks().to_batches()

    return beside(keyed, [*by, "rounded"]).mapInArrow(run, schema)


Steps = dict[int, list[tuple[int, float]]]


def steps_of(edges: list[tuple[int, int, float]]) -> Steps:
    """(other node, weight) of the edges of each node, both ways."""
    near: Steps = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    return near


def shortest_path(near: Steps, start: int, goal: int) -> list[int]:
    """Nodes of a shortest path; empty if there is none."""
    import heapq

    queue, came, done = [(0.0, start, start)], {}, set()
    while queue:
        d, node, prev = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        came[node] = prev
        if node == goal:
            path = [goal]
            while path[-1] != start:
                path.append(came[path[-1]])
            return path[::-1]
        for other, w in near.get(node, []):
            if other not in done:
                heapq.heappush(queue, (d + w, other, node))
    return []


#: Distances between rows and nodes that are held at once.
NODE_BLOCK = 2_000_000


def nearest_nodes(lat: np.ndarray, lon: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Number of the node nearest to each place, in degrees; ties to the first, unknown places get the first node."""
    out, step = np.empty(len(lat), np.int64), max(1, NODE_BLOCK // len(ids))
    for a in range(0, len(lat), step):
        s = slice(a, a + step)
        out[s] = ids[((lat[s, None] - pos[None, :, 0]) ** 2 + (lon[s, None] - pos[None, :, 1]) ** 2).argmin(1)]
    return out


def map_match(ends: DataFrame, by: list[str], nodes: dict[int, tuple[float, float]], edges: list[tuple[int, int, float]]) -> DataFrame:
    """Nodes (n: position in order, node) of the shortest path over a small graph from a flight's first position (lat0, lon0) to its last one (lat1, lon1).

    A path is sought once for all flights that have the same two nodes at their ends.
    """
    if not nodes:
        return ends.select(*by, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("node")).limit(0)
    ids = np.array(sorted(nodes))
    pos = np.array([nodes[i] for i in ids.tolist()], float)
    kinds = T.StructType([ends.schema[c] for c in by]).add("_u", "long").add("_v", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [nearest_nodes(*(batch.column(f"{c}{k}").to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon")), ids, pos) for k in "01"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *map(pa.array, at)], names=kinds.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = steps_of(edges)
        for batch in batches:
            paths = [shortest_path(near, u, v) for u, v in zip(batch.column("_u").to_pylist(), batch.column("_v").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_u"), batch.column("_v"), pa.array(paths, pa.list_(pa.int64()))], names=["_u", "_v", "_path"])

    placed = ends.mapInArrow(place, kinds)
    paths = placed.select("_u", "_v").distinct().mapInArrow(walk, "_u long, _v long, _path array<long>")
    return placed.join(paths, ["_u", "_v"]).select(*by, F.posexplode("_path").alias("n", "node")).withColumn("n", F.col("n").cast("long"))
