"""Joins between flights, points and reference tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, geo
from ..functions.timeunits import from_us, micros, us
from .grouped import whole_flights
from .keys import TIME
from .scratch import materialize

#: Reference tables are broadcast up to so many rows; larger ones are joined by cell.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if it is within the bound (counted up to the bound only)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def near(df: DataFrame, table: DataFrame, prefix: str, reach: float) -> DataFrame:
    """Each row with the rows of a reference table (latitude, longitude, ..) within ``reach`` NM or little more; their columns get the prefix.

    Rows and points meet by cell, an equal key: a row has one, a point those
    that its reach touches.  A table beyond the broadcast bound is shuffled by
    cell, and cells with many rows are split by adaptive execution.
    """
    deg = min(90.0, reach / 60.0)
    t = table.select(*[F.col(c).alias(f"{prefix}{c}") for c in table.columns])
    t = t.withColumn("_cell", F.explode(cells.cells_around(f"{prefix}latitude", f"{prefix}longitude", deg, min(reach, 60.0 * deg))))
    return df.withColumn("_cell", cells.cell("latitude", "longitude", deg)).join(small(t), "_cell").drop("_cell")


def listed_near(df: DataFrame, table: DataFrame, cols: tuple[str, ...], reach: float, name: str) -> DataFrame:
    """Adds the array of a table's points (structs of ``cols``, sorted) that the row's cell has within ``reach`` NM or little more.

    One array per cell, so its length is the number of points in reach; rows
    without any have null.
    """
    deg = min(90.0, reach / 60.0)
    at = table.select(F.struct(*cols).alias("_p"), F.explode(cells.cells_around("latitude", "longitude", deg, min(reach, 60.0 * deg))).alias("_cell"))
    lists = at.groupBy("_cell").agg(F.array_sort(F.collect_list("_p")).alias(name))
    return df.withColumn("_cell", cells.cell("latitude", "longitude", deg)).join(small(lists), "_cell", "left").drop("_cell")


def pair_distance(a: DataFrame, b: DataFrame, on: list[str] = [TIME], keep: tuple[str, ...] = ("icao24",)) -> DataFrame:  # noqa: B006
    """lateral (NM) and vertical (ft) between rows of the same time; columns get _x and _y."""
    cols = ["latitude", "longitude", "altitude", *keep]
    x = a.select(*on, *[F.col(c).alias(f"{c}_x") for c in cols])
    y = b.select(*on, *[F.col(c).alias(f"{c}_y") for c in cols])
    j = x.join(y, on)
    return j.withColumns({"lateral": geo.distance("latitude_x", "longitude_x", "latitude_y", "longitude_y"), "vertical": F.abs(F.col("altitude_x") - F.col("altitude_y"))})


#: In closest_approach(): edge of a tile in separations, rows of either side of a group, rows of a task, most tasks, and pairs measured at once.
TILE, GROUP_ROWS, TASK_ROWS, MOST_TASKS, MEETINGS_AT_ONCE = 16, 20_000, 10_000, 10_000, 200_000


def closest_approach(df: DataFrame, lateral: float, vertical: float, bucket, key: str = "icao24", keep: list[str] | None = None) -> DataFrame:
    """Rows of different aircraft in the same time bucket within both separations, both ways round.

    ``keep`` names the columns returned of either row: of timestamp, key,
    latitude, longitude, altitude and event_id, all by default.

    Rows are shuffled once, to the time bucket and a tile many separations
    wide, and those near a tile's edge to its neighbours as well, where they
    are met but meet none themselves.  Tiles close at the date line and the
    poles.  A tile with more than GROUP_ROWS rows is cut into blocks that meet
    block by block, so a task holds few rows and yields pairs as it finds them;
    pairs are never shuffled.
    """
    known = df.filter(" and ".join(f"`{c}` is not null" for c in (TIME, key, "latitude", "longitude", "altitude")))
    known = known.filter(" and ".join(f"abs(cast({c} as double)) < double('infinity')" for c in ("latitude", "longitude")))
    rows = known.count()
    everything = [TIME, key, "latitude", "longitude", "altitude", *(["event_id"] if "event_id" in df.columns else [])]
    sent = everything if keep is None else [c for c in everything if c in keep]
    cols = list(dict.fromkeys([*sent, key, "latitude", "longitude", "altitude"]))
    reach = max(lateral, 1e-3)
    # Blocks are dealt by all of a row's columns, so every copy of the row is in the same one.
    v = known.select(*cols, F.floor(us(TIME) / F.lit(float(micros(bucket)))).alias("_u"), F.xxhash64(*everything).alias("_h"))
    v = cells.touched(v, "latitude", "longitude", TILE * reach / 60.0, reach)
    v = v.withColumn("_slot", F.pmod(F.xxhash64("_u", "_k", "_c"), F.lit(max(1024, rows // 1000))))
    # Tiles are counted by slots, few in number; a full slot may cut a small tile as well, which costs copies only.
    full = v.groupBy("_slot").agg(F.count("*").alias("_m")).filter(F.col("_m") > GROUP_ROWS).select("_slot", F.ceil(F.col("_m") / GROUP_ROWS).alias("_s"))
    v = v.join(F.broadcast(full), "_slot", "left").withColumn("_s", F.coalesce("_s", F.lit(1).cast("long")))
    s, q, home, i = F.col("_s"), F.col("_q"), F.col("_home"), F.pmod(F.col("_h"), F.col("_s"))
    v = v.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.when(home, 2 * s - 2).otherwise(s - 1))))
    other = q - s + F.when(q - s >= i, 1).otherwise(0)
    a = F.when(~home, q).when(q < s, i).otherwise(other)
    b = F.when(home & (q < s), q).otherwise(i)
    v = v.select(*cols, "_u", "_k", "_c", (a * s + b).alias("_block"), (F.when(home & (a == i), 1).otherwise(0) + F.when(b == i, 2).otherwise(0)).alias("_role"))
    group, at_once = ["_u", "_k", "_c", "_block"], MEETINGS_AT_ONCE
    tasks = min(MOST_TASKS, -(-rows // TASK_ROWS)) or 1
    fields = [df.schema[c] for c in dict.fromkeys([*sent, "altitude"])]
    schema = T.StructType([T.StructField(f"{f.name}_{w}", f.dataType) for w in "xy" for f in fields] + [T.StructField("lateral", T.DoubleType())])

    def meet(batches):
        for t, starts in whole_flights(batches, group):
            yield from _meetings(t, starts, key, [f.name for f in fields], lateral, vertical, reach, at_once)

    j = v.repartition(tasks, *group).sortWithinPartitions(*group).mapInArrow(meet, schema)
    j = j.withColumn("vertical", F.abs(F.col("altitude_x") - F.col("altitude_y"))).filter(F.col("vertical") <= vertical)
    if TIME not in sent:
        return j.select(*[f"{c}_{w}" for w in "xy" for c in sent], "lateral", "vertical")
    u = F.floor(us(f"{TIME}_x") / F.lit(float(micros(bucket)))).alias("bucket")
    return j.select(*[f"{c}_x" for c in sent], u, *[f"{c}_y" for c in sent], "lateral", "vertical")


def _meetings(t: pa.Table, starts: np.ndarray, key: str, names: list[str], lateral: float, vertical: float, reach: float, at_once: int):
    """Batches of the close pairs within each group: rows of role 1 with rows of role 2.

    Rows that are met are sorted by group, band of latitude and longitude; a
    row looks into its own band and those beside it, between two longitudes.
    """
    y, x, z = (t.column(c).cast(pa.float64()).to_numpy() for c in ("latitude", "longitude", "altitude"))
    k = t.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
    role = t.column("_role").to_numpy()
    ours, theirs = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if not len(ours) or not len(theirs):
        return
    deg = reach / 60.0
    band = np.floor((y + 90.0) / deg).astype(np.int64)
    bands = np.unique(np.concatenate([band - 1, band, band + 1]))
    strip = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * len(bands) + np.searchsorted(bands, band)
    turn = np.mod(x, 360.0)
    turn[turn >= 360.0] = 0.0
    at = lambda lon: np.floor(lon * 2**20).astype(np.int64) + 2**28
    # Rows beside the date line are met from either side.
    d = deg + cells.SLACK
    polar = np.abs(y) + d >= 90.0
    half = np.degrees(np.arcsin(np.minimum(1.0, np.sin(np.radians(min(d, 90.0))) / np.cos(np.radians(np.where(polar, 0.0, y)))))) + cells.SLACK
    most = half[~polar].max(initial=0.0)
    east, west = theirs[turn[theirs] >= 360.0 - most - 1e-6], theirs[turn[theirs] <= most + 1e-6]
    met = np.concatenate([theirs, east, west])
    place = at(np.concatenate([turn[theirs], turn[east] - 360.0, turn[west] + 360.0]))
    strips = np.unique(strip[met])
    place += np.searchsorted(strips, strip[met]) << 31
    order = np.argsort(place)
    met, place = met[order], place[order]
    lo, hi = [], []
    for step in (-1, 0, 1):
        n = np.minimum(np.searchsorted(strips, strip[ours] + step), len(strips) - 1)
        first = np.where(polar[ours], 2**28, at(turn[ours] - half[ours]))
        last = np.where(polar[ours], 2**28 + 360 * 2**20, at(turn[ours] + half[ours]) + 1)
        lo.append(np.searchsorted(place, (n << 31) + first))
        hi.append(np.where(strips[n] == strip[ours] + step, np.searchsorted(place, (n << 31) + last), lo[-1]))
    rows, lo, hi = np.tile(ours, 3), np.concatenate(lo), np.concatenate(hi)
    y, x, cos = np.radians(y), np.radians(x), np.cos(np.radians(y))
    slack = 1e-6 * (1 + abs(vertical))  # heights are compared once more in their own type
    ends = np.cumsum(hi - lo)
    for g in range(int(ends[-1] // at_once) + 1):
        r = np.arange(*np.searchsorted(ends, [g * at_once, (g + 1) * at_once], "right"))
        c = hi[r] - lo[r]
        i, j = np.repeat(rows[r], c), met[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - lo[r], c)]
        near = (k[i] != k[j]) & (np.abs(z[i] - z[j]) <= vertical + slack)
        i, j = i[near], j[near]
        h = np.sin((y[j] - y[i]) / 2) ** 2 + cos[i] * cos[j] * np.sin((x[j] - x[i]) / 2) ** 2
        apart = 2 * geo.R_NM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
        near = apart <= lateral
        i, j = i[near], j[near]
        if len(i):
            sides = [t.column(c).take(pa.array(w)).combine_chunks() for w in (i, j) for c in names]
            yield pa.RecordBatch.from_arrays([*sides, pa.array(apart[near])], [f"{c}_{w}" for w in "xy" for c in names] + ["lateral"])


def cpa_score(cpa: DataFrame, lateral: float = 5, vertical: float = 1000) -> DataFrame:
    return cpa.withColumn("aggregated", F.greatest(F.col("lateral") / lateral, F.col("vertical") / vertical))


def cpa_min(cpa: DataFrame, column: str, key: str = "icao24") -> DataFrame:
    """The row of each ordered pair with the smallest value; ties to the earliest times."""
    keys = [f"{key}_x", f"{key}_y"]
    rest = [c for c in cpa.columns if c not in keys]
    order = F.struct(column, f"{TIME}_x", f"{TIME}_y", *[c for c in ("event_id_x", "event_id_y") if c in cpa.columns])
    # Column by column, so that those nobody reads are never moved; the order is total, so all are of one row.
    return cpa.groupBy(*keys).agg(*[F.min(c).alias(c) if c == column else F.min_by(c, order).alias(c) for c in rest])


#: In closest_pairs(): rows of a block, pairs that are measured at once, pairs of aircraft with a place of their own in an array, and rows of a batch.
PAIR_ROWS, PAIRS_AT_ONCE, PAIR_PLACES, RESULT_ROWS = 50_000, 2_000_000, 5_000_000, 100_000


def closest_pairs(df: DataFrame, lateral: float, vertical: float, bucket, key: str = "icao24") -> DataFrame:
    """cpa_min(closest_approach(..), "lateral"): key, timestamp and event_id of both, lateral, vertical.

    Aircraft are dealt to blocks, and blocks meet block by block, so all rows of
    two aircraft are in one meeting: only a pair's least row leaves it.  A block
    is packed into one value and written once; meetings read it from there, so
    neither rows nor close pairs are copied into shuffles.
    """
    known = df.filter("latitude is not null and longitude is not null and altitude is not null").filter(F.col(key).isNotNull() & F.col(TIME).isNotNull())
    n = max(1, -(-known.count() // PAIR_ROWS))
    event = F.col("event_id").cast("long") if "event_id" in df.columns else F.lit(0).cast("long")
    v = known.select(F.col(key).alias("k"), us(TIME).alias("t"), F.col("latitude").cast("double").alias("y"), F.col("longitude").cast("double").alias("x"), F.col("altitude").cast("double").alias("z"), event.alias("e"), F.pmod(F.xxhash64(key), F.lit(n)).alias("_i"))

    def packed(t: pa.Table) -> pa.Table:
        rows = t.select(list("ktyxze")).sort_by([("k", "ascending"), ("t", "ascending")]).combine_chunks()
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows)
        return pa.table([t.column("_i").slice(0, 1), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["_i", "rows"])

    blocks = materialize(v.groupBy("_i").applyInArrow(packed, "_i long, rows binary"))
    # Each two blocks meet once, in either half of the square, so tasks are alike.
    i, j = F.col("_i"), F.col("_j")
    meetings = blocks.crossJoin(blocks.withColumnsRenamed({"_i": "_j", "rows": "others"})).filter((i == j) | ((i < j) == ((i + j) % 2 == 0)))
    names = ["kx", "ky", "tx", "ty", "ex", "ey", "lateral", "vertical"]
    kind, width, at_once, places, most = v.schema["k"].dataType.simpleString(), float(micros(bucket)), PAIRS_AT_ONCE, PAIR_PLACES, RESULT_ROWS

    def unpacked(value) -> tuple[pa.Array, dict[str, np.ndarray]]:
        t = pa.ipc.open_stream(value.as_buffer()).read_all()
        code = t.column("k").combine_chunks().dictionary_encode()
        a = {c: t.column(c).to_numpy() for c in "tze"} | {c: np.radians(t.column(c).to_numpy()) for c in "yx"}
        return code.dictionary, a | {"k": code.indices.to_numpy().astype(np.int64), "u": np.floor(a["t"] / width).astype(np.int64)}

    def meet(batches):
        held: tuple[int | None, tuple] = (None, ())
        for batch in batches:
            for m in range(batch.num_rows):
                first, second = batch.column("_i")[m].as_py(), batch.column("_j")[m].as_py()
                if held[0] != first:
                    held = (first, unpacked(batch.column("rows")[m]))
                a = held[1]
                b = a if first == second else unpacked(batch.column("others")[m])
                columns = _least(*a, *b, first == second, lateral, vertical, at_once, places)
                for r in range(0, len(columns[0]), most):
                    yield pa.RecordBatch.from_arrays([c[r : r + most] for c in columns], names)

    schema = f"kx {kind}, ky {kind}, tx long, ty long, ex long, ey long, lateral double, vertical double"
    out = meetings.select("_i", "_j", "rows", "others").mapInArrow(meet, schema)
    ids = [F.col(f"e{s}").alias(f"event_id_{s}") for s in "xy"] if "event_id" in df.columns else []
    return out.select(F.col("kx").alias(f"{key}_x"), F.col("ky").alias(f"{key}_y"), *[from_us(f"t{s}").alias(f"{TIME}_{s}") for s in "xy"], *ids, "lateral", "vertical")


def _least(ka: pa.Array, a: dict[str, np.ndarray], kb: pa.Array, b: dict[str, np.ndarray], same: bool, lateral: float, vertical: float, at_once: int, places: int) -> list[pa.Array]:
    """Keys, times and events of both, lateral and vertical of the least row of each two aircraft of two blocks, both ways round."""
    # A row's candidates are of its bucket, between two heights: both as ranks, so that one search finds them.
    buckets, heights = np.unique(b["u"]), np.unique(b["z"])
    rank = np.searchsorted(buckets, b["u"]) * (len(heights) + 1) + np.searchsorted(heights, b["z"])
    order = np.argsort(rank, kind="stable")
    rank, b = rank[order], {c: w[order] for c, w in b.items()}
    slack = 1e-9 * (1 + np.abs(a["z"]) + vertical)
    of = np.minimum(np.searchsorted(buckets, a["u"]), len(buckets) - 1)
    lo = np.searchsorted(rank, of * (len(heights) + 1) + np.searchsorted(heights, a["z"] - vertical - slack))
    hi = np.searchsorted(rank, of * (len(heights) + 1) + np.searchsorted(heights, a["z"] + vertical + slack, "right"))
    hi = np.where(buckets[of] == a["u"], np.maximum(hi, lo), lo)
    best = [np.zeros(0, np.int64) for _ in range(2)] + [np.zeros(0)]
    cos = np.cos(a["y"]), np.cos(b["y"])
    dense = len(ka) * len(kb) <= places
    low = np.full(len(ka) * len(kb), np.inf) if dense else None

    def leading(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Rows that share their pair's least distance."""
        pair = a["k"][i] * len(kb) + b["k"][j]
        if dense:
            np.minimum.at(low, pair, d)
            return d == low[pair]
        order = np.lexsort((d, pair))
        first = np.concatenate([np.ones(min(len(order), 1), bool), pair[order][1:] != pair[order][:-1]])
        tied = np.zeros(len(d), bool)
        tied[order] = d[order] == d[order][first][np.cumsum(first) - 1]
        return tied

    ends = np.cumsum(hi - lo)
    for g in range(int(ends[-1] // at_once) + 1):
        r = np.arange(*np.searchsorted(ends, [g * at_once, (g + 1) * at_once], "right"))
        c = hi[r] - lo[r]
        i, j = np.repeat(r, c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c - lo[r], c)
        ok = (np.abs(a["z"][i] - b["z"][j]) <= vertical) & (np.abs(a["y"][i] - b["y"][j]) <= np.radians(lateral / 60))
        if same:
            ok &= a["k"][i] < b["k"][j]
        i, j = i[ok], j[ok]
        h = np.sin((b["y"][j] - a["y"][i]) / 2) ** 2 + cos[0][i] * cos[1][j] * np.sin((b["x"][j] - a["x"][i]) / 2) ** 2
        d = 2 * geo.R_NM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
        near = d <= lateral
        i, j, d = i[near], j[near], d[near]
        tied = leading(i, j, d)
        best = [np.concatenate([w, z[tied]]) for w, z in zip(best, (i, j, d))]
        if len(best[0]) > 2 * at_once:
            tied = leading(*best)
            best = [w[tied] for w in best]
    tied = leading(*best)
    i, j, d = (w[tied] for w in best)
    # Ties are decided from either side; pairs without any are as they are.
    pair = a["k"][i] * len(kb) + b["k"][j]
    order = np.argsort(pair, kind="stable")
    i, j, d, pair = i[order], j[order], d[order], pair[order]
    first = np.concatenate([np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1]])
    alone = first & np.concatenate([first[1:], np.ones(min(len(pair), 1), bool)])
    several = np.flatnonzero(~alone)
    columns = []
    for s, m, ks, o, w, ko in ((a, i, ka, b, j, kb), (b, j, kb, a, i, ka)):
        p, q = m[several], w[several]
        order = np.lexsort((o["e"][q], s["e"][p], o["t"][q], s["t"][p], pair[several]))
        one = several[order[np.concatenate([np.ones(min(len(order), 1), bool), pair[several][order][1:] != pair[several][order][:-1]])]]
        at = np.concatenate([np.flatnonzero(alone), one])
        m, w = m[at], w[at]
        columns.append([ks.take(pa.array(s["k"][m])), ko.take(pa.array(o["k"][w])), *map(pa.array, (s["t"][m], o["t"][w], s["e"][m], o["e"][w], d[at], np.abs(s["z"][m] - o["z"][w])))])
    return [pa.concat_arrays(c) for c in zip(*columns)]


#: Distances (NM) in which nearest points are sought, one after the other; the last one holds the whole sphere.
REACHES = (60.0, 600.0, 10_900.0)


def closest_point(df: DataFrame, points: DataFrame, by: list[str], reaches: tuple[float, ...] = REACHES) -> DataFrame:
    """For each flight the nearest point (name, latitude, longitude) over all its rows, and the distance.

    A flight whose nearest point within a reach is nearer than that reach is
    done; the others look further.  Ties go to the first name; flights without
    positions have no row.
    """
    p = points.select(F.col("name").alias("point"), F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"), "latitude", "longitude")
    if p.limit(LISTED + 1).count() <= LISTED:  # so few that all are measured at once
        reaches = reaches[-1:]
    rest, done = df.select(*by, "latitude", "longitude").filter("latitude is not null and longitude is not null"), None
    for reach in reaches:
        last = reach == reaches[-1]
        pts = listed_near(rest, p, ("point", "p_lat", "p_lon"), reach, "_pts") if not last else _all_points(rest, p)
        d = F.transform("_pts", lambda q: F.struct(geo.distance("latitude", "longitude", q["p_lat"], q["p_lon"]).alias("distance"), q["point"].alias("point")))
        best = pts.groupBy(*by).agg(F.min(F.array_min(d)).alias("_m")).filter(F.col("_m").isNotNull()).select(*by, "_m.point", "_m.distance")
        if not last:
            best = materialize(best.filter(F.col("distance") <= reach))
            rest = rest.join(best, by, "left_anti")
        done = best if done is None else done.unionByName(best)
    return done


#: Points in one array.
LISTED = 1000


def _all_points(df: DataFrame, points: DataFrame) -> DataFrame:
    """Each row once for every block of at most LISTED points, as an array; few rows get here, or few points."""
    blocks = -(-points.count() // LISTED) or 1
    lists = points.groupBy(F.pmod(F.xxhash64("point", "p_lat", "p_lon"), F.lit(blocks)).alias("_blk")).agg(F.array_sort(F.collect_list(F.struct("point", "p_lat", "p_lon"))).alias("_pts"))
    each = df.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return each.join(F.broadcast(lists) if blocks == 1 else lists, "_blk").drop("_blk")


def bearing_to(df: DataFrame, lat: float, lon: float, name: str = "bearing") -> DataFrame:
    return df.withColumn(name, geo.bearing("latitude", "longitude", F.lit(lat), F.lit(lon)))


def distance_to(df: DataFrame, lat: float, lon: float, name: str = "distance") -> DataFrame:
    return df.withColumn(name, geo.distance("latitude", "longitude", F.lit(lat), F.lit(lon)))


def dimension(df: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join with a reference table of one row per key; a key that repeats there counts once."""
    return df.join(small(table.dropDuplicates([on])), on, how)


def as_of(df: DataFrame, other: DataFrame, by: list[str], *cols: str) -> DataFrame:
    """Each row with the latest earlier (or equal) values of another table.

    Both are merged in one sort per key and values are carried forward, so no
    row meets more than its own key's rows.
    """
    tie = [c for c in ("event_id",) if c in df.columns]
    rows = df.withColumn("_side", F.lit(1))
    ref = other.select(*by, TIME, F.struct(*cols).alias("_ref")).withColumn("_side", F.lit(0))
    w = W.partitionBy(*by).orderBy(TIME, "_side", *tie).rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(ref, allowMissingColumns=True).withColumn("_ref", F.last_value("_ref", True).over(w))
    return both.filter("_side = 1").select(*df.columns, *[F.col(f"_ref.{c}").alias(c) for c in cols])


def overlap(a: DataFrame, b: DataFrame, by: list[str], cell="1 d") -> DataFrame:
    """Pairs of intervals (start, stop) of one key that overlap for more than an instant.

    Intervals are cut into time cells first, so a key with many is spread out;
    a pair is kept in the cell in which it begins.
    """
    f = micros(cell)
    cut = lambda d: d.withColumn("_c", F.explode(F.sequence(F.floor(us("start") / f), F.floor(us("stop") / f))))
    x, y = cut(a), cut(b.withColumnsRenamed({"start": "start_y", "stop": "stop_y"}).withColumnsRenamed({"start_y": "start", "stop_y": "stop"})).withColumnsRenamed({"start": "start_y", "stop": "stop_y"})
    j = x.join(y, [*by, "_c"]).filter((F.col("start") < F.col("stop_y")) & (F.col("stop") > F.col("start_y")))
    return j.filter(F.col("_c") == F.floor(us(F.greatest("start", "start_y")) / f)).drop("_c")


def index_by(df: DataFrame, frame: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose key is in the frame and whose time is within its start and stop; null ends are open."""
    f = frame.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    return df.join(f, [*same, F.col("_start").isNull() | (F.col(TIME) >= F.col("_start")), F.col("_stop").isNull() | (F.col(TIME) <= F.col("_stop"))], "left_semi")


def compositions(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(root, leaf): leaves reached from each parent over (parent, child) edges, however deep.

    A frontier of new pairs is joined with the edges until it is empty; each
    round is written to the shared folder, and known pairs are dropped, so
    cycles end.
    """
    edges = materialize(edges.select("parent", "child").distinct())
    rounds = [materialize(edges.select(F.col("parent").alias("root"), F.col("child").alias("node")))]
    seen = rounds[0]
    while rounds[-1].limit(1).count():
        ahead = rounds[-1].join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        rounds.append(materialize(ahead.join(seen, ["root", "node"], "left_anti")))
        seen = seen.unionByName(rounds[-1])
    return seen.join(leaves.select(F.col("leaf").alias("node")).distinct(), "node", "left_semi")


def dme_error(df: DataFrame, stations: DataFrame, name: str = "NSE", reach: float = 200.0) -> DataFrame:
    """Least position error over pairs of stations within ``reach`` NM seen at 30 to 150 degrees from each other."""
    s = stations.select("name", F.col("latitude").alias("s_lat"), F.col("longitude").alias("s_lon"), "latitude", "longitude")
    j = listed_near(df, s, ("name", "s_lat", "s_lon"), reach, "_s")
    seen = F.transform("_s", lambda p: F.struct(p["name"].alias("name"), geo.distance("latitude", "longitude", p["s_lat"], p["s_lon"]).alias("d"), geo.bearing("latitude", "longitude", p["s_lat"], p["s_lon"]).alias("b")))
    j = j.withColumn("_v", F.filter(seen, lambda p: p["d"] <= reach))

    return j.withColumn("_e", least_dme_error()("_v")).withColumns({name: F.col("_e.e"), f"{name}_idx": F.col("_e.pair")}).drop("_s", "_v", "_e")


#: Values of a step in least_dme_error().
DME_VALUES = 1_000_000


def least_dme_error():
    """A function of arrays of stations (name, distance d, bearing b): the least error e over pairs seen at 30 to 150 degrees, and their names; equal errors go by name."""

    @F.arrow_udf("e double, pair string")
    def least(seen: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.list_value_length(seen), 0)).astype(np.int64)
        flat = seen.flatten()
        name, d, b = (flat.field(c) for c in ("name", "d", "b"))
        spread, toward = 2 * 0.05**2 + 0.0, np.asarray(b, float)
        s2 = np.maximum(0.085, 0.00125 * np.asarray(d, float)) ** 2
        first = np.cumsum(size) - size
        best, pair = np.full(len(size), np.inf), [None] * len(size)
        label = lambda p, q: "_".join(x for x in (name[p].as_py(), name[q].as_py()) if x is not None)
        # Rows with as many stations are done together, a pair of places in the arrays at a time.
        for n in np.unique(size[size > 1]).tolist():
            same = np.flatnonzero(size == n)
            step = max(1, DME_VALUES // n)
            for rows in (same[i : i + step] for i in range(0, len(same), step)):
                at = first[rows]
                one, two = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                low, ties = np.full(len(rows), np.inf), {}
                for k in range(n):
                    for m in range(k + 1, n):
                        p, q = at + k, at + m
                        turn = (toward[p] - toward[q]) % 360
                        angle = np.minimum(turn, 360 - turn)
                        e = 2 * np.sqrt(s2[p] + s2[q] + spread) / np.sin(np.radians(angle))
                        e = np.where((angle >= 30) & (angle <= 150), e, np.inf)
                        for r in np.flatnonzero((e == low) & (e < np.inf)).tolist():
                            ties.setdefault(r, []).append((float(e[r]), k, m))
                        less = e < low
                        low[less], one[less], two[less] = e[less], k, m
                best[rows] = low
                got = np.flatnonzero(low < np.inf)
                for r in got.tolist():
                    pair[rows[r]] = label(int(at[r] + one[r]), int(at[r] + two[r]))
                    for e, k, m in ties.get(r, ()):
                        if e == low[r]:
                            pair[rows[r]] = min(pair[rows[r]], label(int(at[r] + k), int(at[r] + m)))
        none = pa.array(~(best < np.inf))
        return pa.StructArray.from_arrays([pa.array(best), pa.array(pair, pa.string())], ["e", "pair"], mask=none)

    return least
