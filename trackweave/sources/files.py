"""Readers by file suffix and dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """parquet, json, jsonl, csv, orc or text by suffix; others raise FileNotFoundError."""
    name = path.rstrip("/").lower()
    for end in (".gz", ".bz2", ".zst", ".snappy"):
        name = name.removesuffix(end)
    kind = name.rpartition(".")[2]
    if kind == "parquet":
        return spark.read.options(**options).parquet(path)
    if kind == "jsonl":
        return spark.read.options(**options).json(path)
    if kind == "json":
        return spark.read.options(**{"multiLine": True} | options).json(path)
    if kind == "csv":
        return spark.read.options(**{"header": True, "inferSchema": True} | options).csv(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind in ("pkl", "pickle", "feather", "h5"):
        import pandas as pd

        frame = {"pkl": pd.read_pickle, "pickle": pd.read_pickle, "feather": pd.read_feather, "h5": pd.read_hdf}[kind](path, **options)
        return spark.createDataFrame(frame)
    raise FileNotFoundError(f"no reader for {path!r}")


def web_csv(df: DataFrame) -> DataFrame:
    """Columns Timestamp, UTC, Callsign, Position "lat,lon", Altitude, Speed, Direction to the usual ones."""
    at = F.split("Position", ",")
    return df.select(
        F.timestamp_seconds(F.col("Timestamp").cast("long")).alias("timestamp"), F.col("Callsign").alias("callsign"), at[0].cast("double").alias("latitude"), at[1].cast("double").alias("longitude"),
        F.col("Altitude").cast("double").alias("altitude"), F.col("Speed").cast("double").alias("groundspeed"), F.col("Direction").cast("double").alias("track"),
    )


def point_profile(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Rows of a packed profile: points apart by blanks, nine fields apart by colons."""
    names = ["timestamp", "point", "route", "flightLevel", "pointDistance", "pointType", "geoPointId", "relDist", "isVisible"]
    each = df.select(*keep, F.posexplode(F.filter(F.split(column, r"\s+"), lambda x: x != "")).alias("n", "_p")).withColumn("_f", F.split("_p", ":"))
    fields = [F.get("_f", i).alias(n) for i, n in enumerate(names)]
    lat, lon = codec.dms_pair(F.get("_f", 6))
    return each.select(*keep, "n", *fields, lat.alias("latitude"), lon.alias("longitude"))


def flatten_json(df: DataFrame, column: str, schema: str, prefix: str = "") -> DataFrame:
    """Fields of a JSON text column as columns of their own."""
    s = df.withColumn("_j", F.from_json(column, schema))
    fields = s.schema["_j"].dataType.names
    return s.select(*[c for c in df.columns], *[F.col(f"_j.{f}").alias(f"{prefix}{f}") for f in fields])


def readsb(df: DataFrame, column: str = "value") -> DataFrame:
    """Trace files: an array of arrays per aircraft, with times as offsets, to one row per point."""
    top = df.select(F.from_json(column, "icao string, r string, t string, timestamp double, trace array<array<string>>").alias("j"))
    p = top.select("j.icao", "j.r", "j.t", "j.timestamp", F.explode("j.trace").alias("p"))
    num = lambda i: F.get("p", i).try_cast("double")
    return p.select(
        F.col("icao").alias("icao24"), F.col("r").alias("registration"), F.col("t").alias("typecode"), F.timestamp_micros(F.rint((F.col("timestamp") + num(0)) * 1e6).cast("long")).alias("timestamp"),
        num(1).alias("latitude"), num(2).alias("longitude"), num(3).alias("altitude"), (F.get("p", 3) == "ground").alias("onground"), num(4).alias("groundspeed"), num(5).alias("track"), num(7).alias("vertical_rate"),
    )


def fr24_archive(metadata: DataFrame, positions: DataFrame, ems: DataFrame | None = None) -> DataFrame:
    """Positions, with EMS rows by snapshot (outer), joined to flight metadata."""
    rows = positions if ems is None else positions.join(ems, ["flight_id", "snapshot_id"], "full_outer")
    diverted = F.when(F.col("real_to") != F.col("schd_to"), F.col("real_to"))
    meta = metadata.withColumns({"icao24": F.lpad(F.lower(F.hex(F.col("aircraft_id").cast("long"))), 6, "0"), "diverted": diverted})
    return rows.join(meta, "flight_id")


def vectors_to_track(vx, vy) -> tuple:
    """(track, groundspeed in knots) from metres per second east and north."""
    return F.pmod(90 - F.degrees(F.atan2(F.col(vy), F.col(vx))), F.lit(360.0)), F.hypot(vx, vy) / 0.514444


def sections(df: DataFrame, header: str, column: str = "value", order: str = "line") -> DataFrame:
    """Lines with the number of the header line they stand under (text files in blocks)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("file").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("section", F.sum(F.when(F.col(column).rlike(header), 1).otherwise(0)).over(w))
