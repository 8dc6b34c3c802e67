"""Streaming forms of batch operators (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeunits import micros, us
from ..operators import detectors
from .beast import frames_of


def bucket_stats(stream: DataFrame, freq: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts, mean and highest altitude per aircraft and time bucket."""
    w = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", freq), "icao24")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("altitude").alias("altitude_mean"), F.max("altitude").alias("altitude_max"))


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "10 minutes", min_rows: int = 2) -> DataFrame:
    """Flights as sessions of a gap: first and last time and rows per aircraft."""
    s = stream.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap), "icao24")
    out = s.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("stop"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= min_rows).drop("session_window")


def distinct_reports(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each report once, however many receivers heard it."""
    return stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["icao24", "timestamp"])


def landings(stream: DataFrame, thresholds: DataFrame, by: list[str] = ["icao24"], angle: float = 0.1, gap="20 s", min_time="1 min", ceiling: float = 5000, field: float = 0.0, wrap: bool = False, reach: float = 500, late: str = "1 minute") -> DataFrame:  # noqa: B006
    """detectors.ils_aligned() of a stream, without seg_idx: each run once, when nothing more can join it.

    The state of a run is its first and last time, its rows and its lowest
    altitude, kept by aircraft and runway; it ends ``gap`` after its last row,
    once the watermark has passed.  The thresholds are a table.
    """
    rows = detectors.ils_rows(stream, thresholds, angle, wrap, reach).withWatermark("timestamp", late)
    # Rows just ``gap`` apart belong together, as in a batch; sessions part there.
    runs = rows.groupBy(F.session_window("timestamp", f"{micros(gap) + 1} microseconds"), *by, "ILS")
    out = runs.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("stop"), F.count(F.lit(1)).alias("n"), F.min("altitude").alias("altitude_min"))
    out = out.filter((F.col("n") >= 2) & (us("stop") - us("start") > micros(min_time)) & (F.col("altitude_min") < field + ceiling))
    return out.drop("session_window")


def beast_frames(chunks) -> list[bytes]:
    """Frames of a short Beast byte stream given in chunks of any size; beast.frames_of() gives them as they come, format "beast" reads files in ranges."""
    return list(frames_of(chunks))
