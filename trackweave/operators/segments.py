"""Segments of flights: rows (key, seg_idx, start, stop) and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeunits import micros, us
from .keys import TIME, legs, ordered, running


def segments(df: DataFrame, by: list[str], gap, min_duration=None, having: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Runs of rows without a gap of more than ``gap``: one row per run of two rows or more."""
    runs = legs(df, by, gap)
    out = runs.groupBy(*by, "leg").agg(F.min(TIME).alias("start"), F.max(TIME).alias("stop"), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (extra or {}).items()])
    if min_duration is not None:
        out = out.filter(us("stop") - us("start") > micros(min_duration))
    if having is not None:
        out = out.filter(having)
    return out.withColumn("seg_idx", (F.row_number().over(W.partitionBy(*by).orderBy("start", "leg")) - 1).cast("long")).drop("leg")


def split(df: DataFrame, by: list[str], gap="10 min", condition=None) -> DataFrame:
    """Segments of flights cut at gaps of more than ``gap``; with ``condition`` only where it holds.

    condition(before, here): a boolean column from two functions that give a
    column's value in the row before the cut and in the row after it.
    """
    if condition is None:
        return segments(df, by, gap)
    w = ordered(df, by)
    cut = (us(TIME) - us(F.lag(TIME).over(w)) > micros(gap)) & condition(lambda c: F.lag(c).over(w), F.col)
    runs = df.withColumn("_open", F.when(cut, 1).otherwise(0)).withColumn("leg", F.sum("_open").over(running(df, by)).cast("long"))
    out = runs.groupBy(*by, "leg").agg(F.min(TIME).alias("start"), F.max(TIME).alias("stop"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return out.withColumn("seg_idx", (F.row_number().over(W.partitionBy(*by).orderBy("start", "leg")) - 1).cast("long")).drop("leg")


def numbered(segs: DataFrame, by: list[str], back: bool = False) -> DataFrame:
    """Adds _at: each segment's place in its flight, from 0, from the end if ``back``."""
    order = [F.col(c).desc() if back else F.col(c) for c in ("start", "seg_idx")]
    return segs.withColumn("_at", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def has(df: DataFrame, segs: DataFrame, by: list[str]) -> DataFrame:
    """Flights with a segment."""
    return df.join(segs, by, "left_semi")


def pick(segs: DataFrame, by: list[str], which: str = "next", key: Column | None = None) -> DataFrame:
    """next, final, max or min (by ``key``, the duration by default; ties to the first)."""
    key = us("stop") - us("start") if key is None else key
    order = {"next": [F.col("seg_idx")], "final": [F.col("seg_idx").desc()], "max": [key.desc(), F.col("seg_idx")], "min": [key, F.col("seg_idx")]}[which]
    return segs.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def rows_of(df: DataFrame, segs: DataFrame, by: list[str]) -> DataFrame:
    """Rows inside segments, ends included, with the segment's number."""
    s = segs.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.col("seg_idx").alias("index_"))
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    return df.join(s, [*same, F.col(TIME) >= F.col("_start"), F.col(TIME) <= F.col("_stop")]).drop(*[f"_{c}" for c in by], "_start", "_stop")


def label(df: DataFrame, segs: DataFrame, by: list[str], name: str, value: Column | None = None, default: Column | None = None) -> DataFrame:
    """Sets a column on rows inside segments; the last segment that covers a row wins.

    Without a value rows get true, and false elsewhere.
    """
    val = F.lit(True) if value is None else value
    other = (F.lit(False) if value is None else F.lit(None)) if default is None else default
    s = segs.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.struct("seg_idx", val.alias("v")).alias("_val"))
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    inside = df.join(s, [*same, F.col(TIME) >= F.col("_start"), F.col(TIME) <= F.col("_stop")], "left")
    cols = [c for c in df.columns if c != name]
    row = [F.first(c).alias(c) for c in cols if c not in (*by, TIME, "event_id")]
    keys = [c for c in (*by, TIME, "event_id") if c in df.columns]
    return inside.groupBy(*keys).agg(*row, F.coalesce(F.max_by("_val.v", "_val.seg_idx"), other).alias(name))
