"""Column names and units of trajectory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Other names of columns, as they occur in public data sets.
ALIASES = {
    "time": "timestamp",
    "lat": "latitude",
    "lon": "longitude",
    "long": "longitude",
    "lng": "longitude",
    "ias": "IAS",
    "tas": "TAS",
    "mach": "Mach",
    "geo_altitude": "geoaltitude",
    "departure": "origin",
    "arrival": "destination",
    "velocity": "groundspeed",
    "ground_speed": "groundspeed",
    "speed": "groundspeed",
    "vertrate": "vertical_rate",
    "vertical_speed": "vertical_rate",
    "roc": "vertical_rate",
    "geoaltitude_ft": "geoaltitude",
    "hex": "icao24",
    "flight": "callsign",
    "type": "typecode",
    "reg": "registration",
    "lastposupdate": "last_position",
}

FT, NM, KT, FPM = 0.3048, 1852.0, 1852.0 / 3600.0, 0.3048 / 60.0


def normalise(df: DataFrame) -> DataFrame:
    """Renames known synonyms; baroaltitude or baro_altitude becomes altitude and moves an existing one to geoaltitude.

    A column is renamed only if its usual name is not taken, small letters
    told apart from large ones; heading serves as track where there is no track.
    """

    def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
        # By place: withColumnRenamed() takes names that differ in case for one.
        return df.toDF(*[names.get(c, c) for c in df.columns])

    baro = next((c for c in ("baroaltitude", "baro_altitude") if c in df.columns), None)
    if baro:
        if "altitude" in df.columns:
            df = renamed(df.drop("geoaltitude", "geo_altitude"), {"altitude": "geoaltitude"})
        df = renamed(df, {baro: "altitude"})
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = renamed(df, {old: new})
    if "heading" in df.columns and "track" not in df.columns:
        df = df.withColumnRenamed("heading", "track")
    return df


def to_nautical(df: DataFrame) -> DataFrame:
    """SI columns to feet, knots and feet per minute, rounded half to even."""
    factor = {"altitude": FT, "geoaltitude": FT, "groundspeed": KT, "vertical_rate": FPM}
    return df.withColumns({c: F.rint(F.col(c) / f) for c, f in factor.items() if c in df.columns})
