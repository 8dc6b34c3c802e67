"""Mode S replies to interrogation, and squitters from the ground (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import col
from .modes import _field, checksum, valid, zones

# Places, from the right, of the bits of altitude and identity codes.
PLACES = {"C1": 12, "A1": 11, "C2": 10, "A2": 9, "C4": 8, "A4": 7, "B1": 5, "D1": 4, "B2": 3, "D2": 2, "B4": 1, "D4": 0}

# Codes of ground movement: first, last, knots of the first, knots a step.
MOVEMENT = ((1, 1, 0.0, 0.0), (2, 8, 0.125, 0.125), (9, 12, 1.0, 0.25), (13, 38, 2.0, 0.5), (39, 93, 15.0, 1.0), (94, 108, 70.0, 2.0), (109, 123, 100.0, 5.0), (124, 124, 175.0, 0.0))


def _bits(code: Column, *names: str) -> Column:
    """The named bits of a 13-bit code as a number, the first one highest."""
    out = F.lit(0)
    for n in names:
        out = out * 2 + F.shiftright(code, PLACES[n]).bitwiseAND(F.lit(1))
    return out


def _plain(gray: Column) -> Column:
    """A Gray code of up to eight bits as a number."""
    for by in (4, 2, 1):
        gray = gray.bitwiseXOR(F.shiftright(gray, by))
    return gray


def altitude(code: Column) -> Column:
    """Feet of a 13-bit altitude code, in steps of 25 or of 100; null for metric and unused codes."""
    c = code.cast("int")
    fine = F.shiftright(c.bitwiseAND(F.lit(0x1F80)), 2).bitwiseOR(F.shiftright(c.bitwiseAND(F.lit(0x20)), 1)).bitwiseOR(c.bitwiseAND(F.lit(0xF)))
    fives, ones = _plain(_bits(c, "D2", "D4", "A1", "A2", "A4", "B1", "B2", "B4")), _plain(_bits(c, "C1", "C2", "C4"))
    ones_used = F.when(ones == 7, 5).when(ones.isin(1, 2, 3, 4), ones)
    coarse = fives * 500 + F.when(fives % 2 == 1, 6 - ones_used).otherwise(ones_used) * 100 - 1300
    return F.when((c == 0) | (c.bitwiseAND(F.lit(0x40)) > 0), None).when(c.bitwiseAND(F.lit(0x10)) > 0, fine * 25 - 1000).otherwise(coarse).cast("double")


def squawk(code: Column) -> Column:
    """Four octal digits of a 13-bit identity code."""
    c = code.cast("int")
    return F.concat(*[_bits(c, f"{d}4", f"{d}2", f"{d}1").cast("string") for d in "ABCD"])


def replies(df: DataFrame, message: str = "rawmsg", known: DataFrame | None = None) -> DataFrame:
    """Replies with altitude (formats 4 and 20) or squawk (5 and 21), short or long, with icao24.

    The address lies in the check sum, so a damaged reply gives a wrong one:
    ``known`` (icao24) leaves replies of addresses that are seen elsewhere.
    """
    m = col(message)
    kind = F.shiftright(F.conv(F.substring(m, 1, 2), 16, 10).cast("int"), 3)
    long = kind.isin(20, 21) & m.rlike("^[0-9a-fA-F]{28}$")
    short = kind.isin(4, 5) & m.rlike("^[0-9a-fA-F]{14}$")
    ok = df.filter(long | short).withColumn("_size", F.length(m))
    parity = F.conv(F.substring(m, F.col("_size") - 5, F.lit(6)), 16, 10).cast("int")
    address = F.lower(F.lpad(F.hex(parity.bitwiseXOR(checksum(m, (F.col("_size") / 2 - 3).cast("int"))).cast("long")), 6, "0"))
    code = F.conv(F.substring(m, 5, 4), 16, 10).cast("int").bitwiseAND(F.lit(0x1FFF))
    out = ok.withColumns({"icao24": address, "altitude": F.when(kind.isin(4, 20), altitude(code)), "squawk": F.when(kind.isin(5, 21), squawk(code))}).drop("_size")
    return out if known is None else out.join(known.select("icao24").distinct(), "icao24", "left_semi").select(out.columns)


def surface(df: DataFrame, latitude, longitude, message: str = "rawmsg") -> DataFrame:
    """Valid squitters from the ground with icao24, groundspeed, track, and the position nearest to a receiver's place.

    The place is given as numbers or columns; packed positions repeat every 1.5
    degrees of latitude, so it must be within 45 NM of the aircraft.
    """
    place = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else col(v)
    ok = df.filter(valid(message)).withColumn("_me", F.conv(F.substring(message, 9, 14), 16, 10).cast("long")).filter(_field(F.col("_me"), 0, 5).between(5, 8))
    me = F.col("_me")
    code, odd = _field(me, 5, 7), _field(me, 21, 1)
    speed = F.lit(None).cast("double")
    for first, last, knots, step in MOVEMENT:
        speed = F.when(code.between(first, last), knots + (code - first) * step).otherwise(speed)
    nearest = lambda at, step, packed: step * (F.floor(at / step - packed + 0.5) + packed)
    out = ok.withColumns({
        "icao24": F.lower(F.substring(message, 3, 6)), "onground": F.lit(True), "groundspeed": speed, "track": F.when(_field(me, 12, 1) == 1, _field(me, 13, 7) * 360.0 / 128),
        "latitude": nearest(place(latitude), 90.0 / (60 - odd), _field(me, 22, 17) / F.lit(131072.0)),
    })
    n = F.greatest(F.lit(1).cast("long"), zones(F.col("latitude")) - odd)
    return out.withColumn("longitude", nearest(place(longitude), 90.0 / n, _field(me, 39, 17) / F.lit(131072.0))).drop("_me")
