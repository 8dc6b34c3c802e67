"""Mode S extended squitters to columns: identification, position, velocity (built-in functions only).

Messages are hex texts of 28 characters with a time; positions need an even and
an odd frame of one aircraft, or a reference, so frames meet in one window per
aircraft.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import col
from ..functions.timeunits import micros, us

# The 6-bit letters of call signs and the generator of the check sum.
LETTERS = "#ABCDEFGHIJKLMNOPQRSTUVWXYZ##### ###############0123456789######"
GENERATOR = 0xFFF409


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 16
        for _ in range(8):
            c = (c << 1) ^ GENERATOR if c & 0x800000 else c << 1
        out.append(c & 0xFFFFFF)
    return out


def once(value: Column, use) -> Column:
    """use(value) with the value computed a single time, however often and wherever in lambdas ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def checksum(message, size: int | Column = 11) -> Column:
    """The 24-bit remainder of a message's first bytes: all but the last three of a long one."""
    return once(col(message), lambda m: _remainder(m, size))


def _remainder(message: Column, size: int | Column) -> Column:
    last = F.lit(size - 1) if isinstance(size, int) else size - 1
    table = F.lit(_crc_table())
    byte = lambda i: F.conv(F.substring(message, 2 * i + 1, F.lit(2)), 16, 10).cast("int")

    def step(crc, i):
        at = F.shiftright(crc, 16).bitwiseXOR(byte(i)).bitwiseAND(F.lit(0xFF))
        return F.shiftleft(crc, 8).bitwiseXOR(F.get(table, at)).bitwiseAND(F.lit(0xFFFFFF))

    return F.aggregate(F.sequence(F.lit(0), last), F.lit(0), step)


def valid(message) -> Column:
    """Whether a text is a long squitter (formats 17 and 18) whose check sum is right."""

    def right(m: Column) -> Column:
        df = F.shiftright(F.conv(F.substring(m, 1, 2), 16, 10).cast("int"), 3)
        return F.coalesce(m.rlike("^[0-9a-fA-F]{28}$") & df.isin(17, 18) & (F.conv(F.substring(m, 23, 6), 16, 10).cast("int") == _remainder(m, 11)), F.lit(False))

    return once(col(message), right)


def _field(me: Column, at: int, n: int) -> Column:
    """n bits from bit ``at`` (counted from 0) of the 56-bit payload."""
    return F.shiftright(me, 56 - at - n).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def zones(lat: Column) -> Column:
    """Number of longitude zones at a latitude."""
    a = F.abs(lat)
    ratio = (1 - math.cos(math.pi / 30)) / F.pow(F.cos(F.radians(a)), 2)
    n = F.floor(2 * math.pi / F.acos(F.greatest(F.lit(-1.0), 1 - ratio)))
    return F.when(a < 1e-9, 59).when(a > 87, 1).when(a == 87, 2).otherwise(n).cast("long")


def fields(df: DataFrame, message: str = "rawmsg") -> DataFrame:
    """Valid squitters with icao24, typecode, callsign, altitude, groundspeed, track, heading, airspeed, vertical_rate and the packed position (_odd, _y, _x)."""
    ok = df.filter(valid(message))
    ok = ok.withColumn("icao24", F.lower(F.substring(message, 3, 6))).withColumn("_me", F.conv(F.substring(message, 9, 14), 16, 10).cast("long"))
    me = F.col("_me")
    tc = _field(me, 0, 5)
    letter = lambda i: F.substring(F.lit(LETTERS), _field(me, 8 + 6 * i, 6).cast("int") + 1, F.lit(1))
    callsign = F.when(tc.between(1, 4), F.rtrim(F.regexp_replace(F.concat(*[letter(i) for i in range(8)]), "#", "")))
    airborne = tc.between(9, 18) | tc.between(20, 22)
    height = _field(me, 8, 12)
    in_feet = F.shiftright(height.bitwiseAND(F.lit(0xFE0).cast("long")), 1).bitwiseOR(height.bitwiseAND(F.lit(0xF).cast("long"))) * 25 - 1000
    altitude = F.when(tc.between(9, 18) & (height.bitwiseAND(F.lit(0x10).cast("long")) > 0), in_feet).when(tc.between(20, 22), height / F.lit(0.3048))
    velocity, sub = tc == 19, _field(me, 5, 3)
    scale = F.when(sub.isin(2, 4), 4).otherwise(1)
    speed = lambda sign, at: F.when(_field(me, at, 10) > 0, (_field(me, at, 10) - 1) * F.when(_field(me, sign, 1) == 1, -1).otherwise(1) * scale)
    east, north = speed(13, 14), speed(24, 25)
    ground, air = velocity & sub.isin(1, 2), velocity & sub.isin(3, 4)
    climb = F.when(_field(me, 37, 9) > 0, (_field(me, 37, 9) - 1) * 64 * F.when(_field(me, 36, 1) == 1, -1).otherwise(1))
    return ok.withColumns({
        "typecode": tc, "callsign": callsign, "altitude": altitude.cast("double"),
        "groundspeed": F.when(ground, F.hypot(east.cast("double"), north.cast("double"))), "track": F.when(ground, F.pmod(F.degrees(F.atan2(east.cast("double"), north.cast("double"))), F.lit(360.0))),
        "heading": F.when(air & (_field(me, 13, 1) == 1), _field(me, 14, 10) * 360.0 / 1024), "airspeed": F.when(air & (_field(me, 25, 10) > 0), (_field(me, 25, 10) - 1) * scale),
        "vertical_rate": F.when(velocity, climb).cast("double"),
        "_odd": F.when(airborne, _field(me, 21, 1)), "_y": F.when(airborne, _field(me, 22, 17) / F.lit(131072.0)), "_x": F.when(airborne, _field(me, 39, 17) / F.lit(131072.0)),
    }).drop("_me")


def decode(df: DataFrame, message: str = "rawmsg", time: str = "timestamp", within="10 s") -> DataFrame:
    """fields() with latitude and longitude: of each airborne frame with the last one of the other parity, at most ``within`` before."""
    f = fields(df, message)
    tie = [c for c in ("event_id",) if c in df.columns]
    w = W.partitionBy("icao24").orderBy(time, *tie).rowsBetween(W.unboundedPreceding, -1)
    packed = F.struct(us(time).alias("t"), F.col("_y").alias("y"), F.col("_x").alias("x"))
    f = f.withColumns({"_e": F.last_value(F.when(F.col("_odd") == 0, packed), True).over(w), "_o": F.last_value(F.when(F.col("_odd") == 1, packed), True).over(w)})
    return positions(f, time, within)


def positions(f: DataFrame, time: str = "timestamp", within="10 s") -> DataFrame:
    """Latitude and longitude of frames with the last even (_e) and odd (_o) packed positions before them."""
    is_odd = F.col("_odd") == 1
    other = F.when(is_odd, F.col("_e")).otherwise(F.col("_o"))
    fresh = F.col("_odd").isNotNull() & (us(time) - other["t"] <= micros(within))
    ye, yo = F.when(is_odd, other["y"]).otherwise(F.col("_y")), F.when(is_odd, F.col("_y")).otherwise(other["y"])
    xe, xo = F.when(is_odd, other["x"]).otherwise(F.col("_x")), F.when(is_odd, F.col("_x")).otherwise(other["x"])
    f = f.withColumns({"_fresh": fresh, "_ye": ye, "_yo": yo, "_xe": xe, "_xo": xo})
    j = F.floor(59 * F.col("_ye") - 60 * F.col("_yo") + 0.5)
    south = lambda v: F.when(v >= 270, v - 360).otherwise(v)
    f = f.withColumns({"_le": south(6.0 * (F.pmod(j, F.lit(60)) + F.col("_ye"))), "_lo": south(360.0 / 59 * (F.pmod(j, F.lit(59)) + F.col("_yo")))})
    f = f.withColumns({"_nl": zones(F.col("_le")), "_same": zones(F.col("_le")) == zones(F.col("_lo"))})
    n = F.greatest(F.lit(1).cast("long"), F.when(is_odd, F.col("_nl") - 1).otherwise(F.col("_nl")))
    m = F.floor(F.col("_xe") * (F.col("_nl") - 1) - F.col("_xo") * F.col("_nl") + 0.5)
    lon = 360.0 / n * (F.pmod(m, n) + F.when(is_odd, F.col("_xo")).otherwise(F.col("_xe")))
    good = F.col("_fresh") & F.col("_same")
    lat = F.when(is_odd, F.col("_lo")).otherwise(F.col("_le"))
    out = f.withColumns({"latitude": F.when(good, lat), "longitude": F.when(good, F.when(lon >= 180, lon - 360).otherwise(lon))})
    return out.drop("_e", "_o", "_fresh", "_ye", "_yo", "_xe", "_xo", "_le", "_lo", "_nl", "_same", "_odd", "_y", "_x")


def near_receiver(df: DataFrame, latitude: float, longitude: float, km: float = 100.0) -> DataFrame:
    """Rows less than ``km`` from a receiver."""
    return df.filter(geo.distance("latitude", "longitude", F.lit(float(latitude)), F.lit(float(longitude))) * 1.852 < km)
