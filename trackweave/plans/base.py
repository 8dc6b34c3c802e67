"""Trajectory tables made from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keys

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL after the common tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {TABLES} {sql}" if not sql.lstrip().upper().startswith(("WITH", "PLAIN")) else sql.removeprefix("PLAIN ")
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as position reports: user as aircraft, value as altitude, the rest from the row number."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("icao24"), "event_id", F.col("ts").alias("timestamp"), "event_type", F.col("value").alias("altitude"), (43 + F.col("value") / 100).alias("latitude"),
        (1 + (e * 37 % 1000) / 250.0).alias("longitude"), (e * 53 % 360).cast("double").alias("track"), (100 + e * 7 % 400).cast("double").alias("groundspeed"),
        (e * 91 % 4000 - 2000).cast("double").alias("vertical_rate"), (F.col("event_type") == "error").alias("onground"),
        F.when(F.col("event_type") == "signup", "7700").otherwise("1200").alias("squawk"), "props",
    )


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points cut into flights at gaps of 12 hours."""
    return keys.assign_id(keys.legs(points(spark, sf_dir), ["icao24"], "12 h"), ["icao24"])


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as a reference table of 25 points with a direction each."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (43 + k * F.lit(0.2)).alias("latitude"), (1 + k * F.lit(0.15)).alias("longitude"), (k * 40 % 360).cast("double").alias("bearing"))


TABLES = """p AS (SELECT user_id icao24, event_id, ts, event_type, value altitude, 43+value/100 latitude, 1+((event_id*37)%1000)/250.0 longitude,
 CAST((event_id*53)%360 AS DOUBLE) track, CAST(100+(event_id*7)%400 AS DOUBLE) groundspeed, CAST((event_id*91)%4000-2000 AS DOUBLE) vertical_rate,
 event_type='error' onground, CASE WHEN event_type='signup' THEN '7700' ELSE '1200' END squawk, props FROM events),
g AS (SELECT *, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY icao24 ORDER BY ts, event_id)) > 43200000000 THEN 1 ELSE 0 END o FROM p),
l AS (SELECT *, CAST(sum(o) OVER (PARTITION BY icao24 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) leg FROM g),
f AS (SELECT *, CAST(icao24 AS VARCHAR)||'_'||lpad(CAST(leg AS VARCHAR),3,'0') flight_id FROM (SELECT *, count(*) OVER (PARTITION BY icao24, leg) cn FROM l) WHERE cn>=2),
pts AS (SELECT n_name AS name, 43+n_nationkey*CAST(0.2 AS DOUBLE) latitude, 1+n_nationkey*CAST(0.15 AS DOUBLE) longitude, CAST((n_nationkey*40)%360 AS DOUBLE) bearing FROM nation)"""


def dist(a: str, b: str, c: str, d: str) -> str:
    h = f"asin(least(1.0, sqrt(pow(sin((radians({c})-radians({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2),2))))"
    return f"(CASE WHEN {a}+{b}+{c}+{d} IS NOT NULL THEN 2*(6371000.0/1852.0)*{h} END)"


def brg(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d})-radians({b}))*cos(radians({c}))"
    x = f"(cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d})-radians({b})))"
    return pmod(f"degrees(atan2({y},{x}))", "360.0")


def pmod(x: str, n: str) -> str:
    return f"(({x} % {n} + {n}) % {n})"


def runs(source: str, by: str, gap_us: int, extra: str = "", where: str = "", min_us: int | None = None) -> str:
    """CTE bodies seg: segments of ``source`` by gaps, as operators.segments makes them."""
    on = f"PARTITION BY {by} ORDER BY ts, event_id"
    body = f"""sg AS (SELECT *, CASE WHEN epoch_us(ts)-epoch_us(lag(ts) OVER ({on})) > {gap_us} THEN 1 ELSE 0 END o2 FROM {source}),
sl AS (SELECT *, sum(o2) OVER ({on} ROWS UNBOUNDED PRECEDING) lg FROM sg),
s0 AS (SELECT {by}, lg, min(ts) AS "start", max(ts) AS "stop", count(*) n {extra} FROM sl GROUP BY {by}, lg HAVING count(*) >= 2),
seg AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY "start", lg)-1 AS BIGINT) seg_idx FROM s0 WHERE true {f'AND epoch_us("stop")-epoch_us("start") > {min_us}' if min_us is not None else ''} {where})"""
    return body
