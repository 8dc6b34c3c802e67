"""Convex hulls of flights' places, and what rotating calipers measure on them.

Hulls are mergeable: tasks reduce their rows to hull corners before anything is
shuffled, so a key with many rows sends few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .grouped import whole_flights

#: Rows of a key from which a batch sends their hull, and places of a key that are merged at once.
REDUCED_ROWS, MERGED_PLACES = 32, 65_536


def hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n x 2), counterclockwise from the smallest; without corners on straight sides."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    half = []
    for points in (p.tolist(), p[::-1].tolist()):
        line: list[list[float]] = []
        for q in points:
            while len(line) > 1 and (line[-1][0] - line[-2][0]) * (q[1] - line[-2][1]) <= (line[-1][1] - line[-2][1]) * (q[0] - line[-2][0]):
                line.pop()
            line.append(q)
        half += line[:-1]
    return np.array(half)


def calipers(h: np.ndarray) -> tuple[float, float, float, float]:
    """(length, width, diagonal of the least rectangle around a hull, greatest distance of two corners).

    The least rectangle has a side on a side of the hull; of rectangles alike
    in area the one with the shorter diagonal counts.
    """
    if len(h) < 2:
        return 0.0, 0.0, 0.0, 0.0
    sides = np.roll(h, -1, 0) - h
    size = np.hypot(*sides.T)
    sides = sides[size > 0] / size[size > 0, None]
    best = None
    # Supports of all directions at once, a block of sides at a time: rotating calipers over whole arrays.
    for k in range(0, len(sides), 256):
        u = sides[k : k + 256]
        along, across = h @ u.T, h @ np.stack([-u[:, 1], u[:, 0]])
        a, b = np.ptp(along, axis=0), np.ptp(across, axis=0)
        for x, y in zip(a.tolist(), b.tolist()):
            key = (round(x * y, 9), x * x + y * y)
            if best is None or key < best[0]:
                best = key, max(x, y), min(x, y)
    n, far, j = len(h), 0.0, 1
    for i in range(n):  # opposite corners move on together
        while n > 2:
            nxt = (j + 1) % n
            e = h[(i + 1) % n] - h[i]
            if e[0] * (h[nxt][1] - h[j][1]) - e[1] * (h[nxt][0] - h[j][0]) <= 0:
                break
            j = nxt
        far = max(far, float(np.hypot(*(h[i] - h[j]))), float(np.hypot(*(h[(i + 1) % n] - h[j]))))
    return best[1], best[2], float(np.hypot(best[1], best[2])), far


def hulls(df: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """by, n, corners (array of struct x, y), area, length, width, diagonal, diameter of each key's places.

    length, width and diagonal are those of the least rectangle around the
    hull, turned as it needs; diameter is the greatest distance of two places.
    Rows without a place don't count; a key without any has no row.
    """
    kinds = T.StructType([df.schema[c] for c in by])
    part = T.StructType(kinds.fields + [T.StructField("_n", T.LongType()), T.StructField("_x", T.ArrayType(T.DoubleType())), T.StructField("_y", T.ArrayType(T.DoubleType()))])
    known = df.select(*by, df[x].cast("double").alias("_x"), df[y].cast("double").alias("_y")).filter("_x is not null and _y is not null")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).append_column("_i", pa.array(np.arange(batch.num_rows)))
            rows = table.group_by(by).aggregate([("_i", "list")])
            p = np.column_stack([batch.column(batch.num_columns - 2).to_numpy(False), batch.column(batch.num_columns - 1).to_numpy(False)])
            lists = rows["_i_list"].combine_chunks()
            n = np.asarray(lists.value_lengths()).astype(np.int64)
            p = p[np.asarray(lists.flatten())]
            ends = np.cumsum(n)
            left, size = [], n.copy()
            at = 0
            for k in np.flatnonzero(n >= REDUCED_ROWS).tolist():  # few rows travel as they are
                corners = hull(p[ends[k] - n[k] : ends[k]])
                left += [p[at : ends[k] - n[k]], corners]
                size[k], at = len(corners), ends[k]
            p = np.concatenate([*left, p[at:]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            keys = [rows[c].combine_chunks().cast(batch.schema.field(c).type) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(n), *[pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(p[:, k]))) for k in (0, 1)]], names=part.names)

    point = T.StructType().add("x", T.DoubleType()).add("y", T.DoubleType())
    out = T.StructType(kinds.fields + [T.StructField("n", T.LongType()), T.StructField("corners", T.ArrayType(point)), *[T.StructField(c, T.DoubleType()) for c in ("area", "length", "width", "diagonal", "diameter")]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ends in whole_flights(batches, by):
            xs, ys = (table.column(c).combine_chunks() for c in ("_x", "_y"))
            first = np.concatenate([[0], np.cumsum(np.asarray(xs.value_lengths()))]).astype(np.int64)
            xy = np.column_stack([np.asarray(c.flatten(), float) for c in (xs, ys)])
            corners, values = [], []
            for a, b in zip(first[ends[:-1]].tolist(), first[ends[1:]].tolist()):
                h = hull(xy[a : min(a + MERGED_PLACES, b)])
                for k in range(a + MERGED_PLACES, b, MERGED_PLACES):
                    h = hull(np.concatenate([h, xy[k : min(k + MERGED_PLACES, b)]]))
                d = h - h[0]
                area = float((d[:, 0] * np.roll(d[:, 1], -1) - np.roll(d[:, 0], -1) * d[:, 1]).sum() / 2)
                corners.append(h)
                values.append((area, *calipers(h)))
            n = np.add.reduceat(table.column("_n").to_numpy(), ends[:-1])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in corners])]).astype(np.int32))
            flat = np.concatenate(corners)
            places = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], ["x", "y"])
            keys = table.select(by).take(pa.array(ends[:-1])).combine_chunks()
            yield from pa.table([*keys.columns, pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, places), *[pa.array(v, pa.float64()) for v in zip(*values)]], names=out.names).combine_chunks().to_batches()

    return known.mapInArrow(reduce, part).repartition(*by).sortWithinPartitions(*by).mapInArrow(merge, out)
