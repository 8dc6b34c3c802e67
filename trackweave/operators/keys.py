"""Flight keys: trips from raw points by key and time gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timeunits import micros, us

TIME = "timestamp"


def ordered(df: DataFrame, by: list[str]):
    """The one window spec that all operators share: a flight's rows in time, ties by row id."""
    tie = [c for c in ("event_id",) if c in df.columns]
    return W.partitionBy(*by).orderBy(TIME, *tie)


def running(df: DataFrame, by: list[str]):
    return ordered(df, by).rowsBetween(W.unboundedPreceding, 0)


def flight_key(df: DataFrame) -> list[str]:
    """flight_id if there is one, else icao24 and callsign."""
    return ["flight_id"] if "flight_id" in df.columns else [c for c in ("icao24", "callsign") if c in df.columns]


def legs(df: DataFrame, by: list[str], gap="10 min", keep_single: bool = False) -> DataFrame:
    """Adds leg, numbered from 0 by gaps of more than ``gap``; pieces of one row vanish.

    Rows with a null key or time belong to no flight.  One shuffle on the key.
    """
    present = df.filter(" and ".join(f"`{c}` is not null" for c in [*by, TIME]))
    w = ordered(df, by)
    opens = F.when(us(TIME) - us(F.lag(TIME).over(w)) > micros(gap), 1).otherwise(0)
    out = present.withColumn("_open", opens).withColumn("leg", F.sum("_open").over(running(df, by)).cast("long")).drop("_open")
    if keep_single:
        return out
    return out.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by, "leg"))).filter("_n >= 2").drop("_n")


def assign_id(df: DataFrame, by: list[str], template: Column | None = None) -> DataFrame:
    """flight_id from the key and the leg: ``<key>_<leg in three digits>``."""
    return df.withColumn("flight_id", template if template is not None else F.concat_ws("_", *[F.col(c).cast("string") for c in by], F.lpad(F.col("leg").cast("string"), 3, "0")))


def iterate(df: DataFrame, gap="10 min") -> DataFrame:
    """Every row with its flight_id: the column itself, or key and gap."""
    if "flight_id" in df.columns:
        return df.filter(F.col("flight_id").isNotNull())
    by = flight_key(df)
    return assign_id(legs(df, by, gap), by).drop("leg")
