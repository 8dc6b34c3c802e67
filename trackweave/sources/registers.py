"""Registers carried by long Mode S replies (built-in functions only).

A reply doesn't say which register it carries.  Each register is a hypothesis:
bits that it fixes, values that it allows, and values that the aircraft's last
known state makes likely.  Its score is the logarithm of how much likelier the
56 bits are under it than as noise; the best one is taken if it is good enough
and beats the next by a margin, else the message stays unread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timeunits import micros, us
from ..operators import joins
from .modes import LETTERS, _field
from .replies import replies

#: Least score of a register, and least lead over the next one: odds of 20 to 1.
ODDS = math.log(20.0)
#: Share of values that disagree with the state whatever it is (turns, gusts, wrong reports).
STRAY = 0.02
#: Share of registers in use that fill a field.
FILLED = 0.9
STATE = ("altitude", "groundspeed", "track", "vertical_rate")


@dataclass(frozen=True)
class Field:
    """A value: its status bit (None: always filled), sign bit, first bit, bits, step and offset; allowed range; what the state expects, how closely."""

    name: str
    status: int | None
    sign: int | None
    at: int
    bits: int
    step: float
    low: float
    high: float
    offset: float = 0.0
    expects: str | None = None
    sigma: float = 1.0
    angle: bool = False

    def value(self, me: Column) -> Column:
        """The value; null unless its status bit is set."""
        raw = _field(me, self.at, self.bits)
        if self.sign is not None:
            raw = raw - F.shiftleft(_field(me, self.sign, 1), self.bits)
        out = raw * self.step + self.offset
        out = F.pmod(out, F.lit(360.0)) if self.angle and self.sign is not None else out
        return out if self.status is None else F.when(_field(me, self.status, 1) == 1, out)

    def width(self) -> int:
        return self.bits + (self.sign is not None)

    def score(self, me: Column, state: dict[str, Column]) -> Column:
        """Log odds of this field's bits against noise; null where the register can't be."""
        v = self.value(me)
        inside = v.between(self.low, self.high)
        span = self.step * 2.0 ** self.width()
        flat = span / (self.high - self.low)
        gain = F.lit(math.log(flat))
        if self.expects is not None:
            at = state[self.expects]
            off = geo.angle_between(v, at) if self.angle else v - at
            normal = F.exp(-F.pow(off / self.sigma, 2) / 2) * (span / (self.sigma * math.sqrt(2 * math.pi)))
            gain = F.coalesce(F.log((1 - STRAY) * normal + STRAY * flat), gain)
        if self.status is None:
            return F.when(inside, gain)
        empty = _field(me, self.at, self.bits) == 0
        if self.sign is not None:
            empty = empty & (_field(me, self.sign, 1) == 0)
        set_ = _field(me, self.status, 1) == 1
        return F.when(set_ & inside, gain + math.log(2 * FILLED)).when(~set_ & empty, math.log(2 * (1 - FILLED)) + self.width() * math.log(2))


@dataclass(frozen=True)
class Register:
    """Fields, runs of bits that are zero (first, number), and the first byte if it names the register."""

    code: str
    fields: tuple[Field, ...]
    zeros: tuple[tuple[int, int], ...] = ()
    head: int | None = None

    def score(self, me: Column, state: dict[str, Column]) -> Column:
        fixed = F.lit(0.0)
        for at, n in (*self.zeros, *(((0, 8),) if self.head is not None else ())):
            fixed = fixed + F.when(_field(me, at, n) == (self.head if (at, n) == (0, 8) and self.head is not None else 0), n * math.log(2))
        for f in self.fields:
            fixed = fixed + f.score(me, state)
        return fixed


# The public layout of the registers.
REGISTERS = (
    Register("17", (Field("_identification", None, None, 6, 1, 1.0, 1, 1.5),), zeros=((24, 32),)),
    Register("40", (
        Field("selected_mcp", 0, None, 1, 12, 16.0, 0, 50_000, expects="altitude", sigma=12_000),
        Field("selected_fms", 13, None, 14, 12, 16.0, 0, 50_000, expects="altitude", sigma=12_000),
        Field("barometric_setting", 26, None, 27, 12, 0.1, 850, 1100, offset=800.0, expects="_pressure", sigma=15),
    ), zeros=((39, 8), (51, 2))),
    Register("44", (
        Field("_source", None, None, 0, 4, 1.0, 1, 4),
        Field("wind_speed", 4, None, 5, 9, 1.0, 0, 250),
        Field("wind_direction", 4, None, 14, 9, 180 / 256, 0, 360, angle=True),
        Field("temperature", None, 23, 24, 10, 0.25, -80, 60, expects="_temperature", sigma=8),
        Field("_static_pressure", 34, None, 35, 11, 1.0, 100, 1100),
        Field("_turbulence", 46, None, 47, 2, 1.0, 0, 3),
        Field("_humidity", 49, None, 50, 6, 100 / 64, 0, 100),
    )),
    Register("50", (
        Field("roll", 0, 1, 2, 9, 45 / 256, -50, 50, expects="_level", sigma=12),
        Field("true_track", 11, 12, 13, 10, 90 / 512, 0, 360, expects="track", sigma=4, angle=True),
        Field("ground_speed", 23, None, 24, 10, 2.0, 0, 700, expects="groundspeed", sigma=12),
        Field("track_rate", 34, 35, 36, 9, 8 / 256, -10, 10, expects="_turn", sigma=0.5),
        Field("TAS", 45, None, 46, 10, 2.0, 0, 600, expects="groundspeed", sigma=50),
    )),
    Register("53", (
        Field("_heading53", 0, 1, 2, 10, 90 / 512, 0, 360, expects="track", sigma=12, angle=True),
        Field("_ias53", 12, None, 13, 10, 1.0, 0, 500),
        Field("_mach53", 23, None, 24, 9, 0.008, 0, 1, expects="_mach_of_53", sigma=0.03),
        Field("_tas53", 33, None, 34, 12, 0.5, 0, 600, expects="groundspeed", sigma=50),
        Field("_rate53", 46, 47, 48, 8, 64.0, -8000, 8000, expects="vertical_rate", sigma=500),
    )),
    Register("60", (
        Field("heading", 0, 1, 2, 10, 90 / 512, 0, 360, expects="track", sigma=12, angle=True),
        Field("IAS", 12, None, 13, 10, 1.0, 0, 500),
        Field("Mach", 23, None, 24, 10, 2.048 / 512, 0, 1, expects="_mach_of_60", sigma=0.03),
        Field("vrate_barometric", 34, 35, 36, 9, 32.0, -6000, 6000, expects="vertical_rate", sigma=500),
        Field("vrate_inertial", 45, 46, 47, 9, 32.0, -6000, 6000, expects="vertical_rate", sigma=500),
    )),
    Register("10", (), zeros=((9, 5),), head=0x10),
    Register("20", (), head=0x20),
    Register("30", (Field("_threat", None, None, 28, 2, 1.0, 0, 2.5),), head=0x30),
)
VALUES = tuple(f.name for r in REGISTERS for f in r.fields if not f.name.startswith("_"))


def mach_of(ias: Column, altitude: Column) -> Column:
    """Mach number at a calibrated airspeed (kt) and pressure altitude (ft) of the standard atmosphere."""
    ratio = F.when(altitude < 36089.24, F.pow(1 - 6.8755856e-6 * F.least(altitude, F.lit(36089.24)), 5.2558797)).otherwise(0.2233609 * F.exp((36089.24 - altitude) / 20805.8))
    impact = F.pow(1 + 0.2 * F.pow(ias / 661.4786, 2), 3.5) - 1
    return F.sqrt(5 * (F.pow(impact / ratio + 1, 2 / 7) - 1))


def _letters(me: Column) -> list[Column]:
    return [F.substring(F.lit(LETTERS), _field(me, 8 + 6 * i, 6).cast("int") + 1, F.lit(1)) for i in range(8)]


def infer(df: DataFrame, message: str = "rawmsg", state: dict[str, Column] | None = None) -> DataFrame:
    """Adds bds (null: unread), bds_lead (log odds to the next register) and the values of the register, to replies of formats 20 and 21.

    ``state`` gives columns for STATE (ft, kt, degrees, ft/min), which may be
    null; without them only layouts and ranges decide.
    """
    given = {c: F.lit(None) for c in STATE} | (state or {})
    given = {c: v.cast("double") for c, v in given.items()}
    me = F.col("_me")
    df = df.withColumn("_me", F.conv(F.substring(message, 9, 14), 16, 10).cast("long"))
    by = {f.name: f for r in REGISTERS for f in r.fields}
    tas, roll = by["TAS"].value(me), by["roll"].value(me)
    turn = F.when(tas > 60, F.degrees(9.80665 * F.tan(F.radians(F.when(F.abs(roll) <= 50, roll))) / (tas * (1852 / 3600))))
    state = given | {
        "_pressure": F.lit(1013.25), "_level": F.lit(0.0), "_turn": turn,
        "_temperature": 15 - 1.9812e-3 * F.least(given["altitude"], F.lit(36089.24)),
        "_mach_of_60": mach_of(by["IAS"].value(me), given["altitude"]), "_mach_of_53": mach_of(by["_ias53"].value(me), given["altitude"]),
    }
    named = {"20": ~F.concat(*_letters(me)).contains("#") & (F.trim(F.concat(*_letters(me))) != "")}
    df = df.withColumns({f"_s{r.code}": F.when(named.get(r.code, F.lit(True)) & me.isNotNull(), r.score(me, state)) for r in REGISTERS})
    scores = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_s{r.code}").isNotNull(), F.struct((-F.col(f"_s{r.code}")).alias("s"), F.lit(r.code).alias("code"))) for r in REGISTERS])))
    df = df.withColumn("_best", scores).drop(*[f"_s{r.code}" for r in REGISTERS])
    best, second = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    lead = F.coalesce(second["s"], F.lit(0.0)) - best["s"]
    df = df.withColumns({"bds": F.when((best["s"] <= -ODDS) & (lead >= ODDS), best["code"]), "bds_lead": lead})
    read = {f.name: F.when(F.col("bds") == r.code, f.value(me)) for r in REGISTERS for f in r.fields if f.name in VALUES}
    read["bds_callsign"] = F.when(F.col("bds") == "20", F.rtrim(F.concat(*_letters(me))))
    return df.withColumns(read).drop("_me", "_best")


def decode(messages: DataFrame, flights: DataFrame | None = None, message: str = "rawmsg", within="30 s", known: DataFrame | None = None) -> DataFrame:
    """Long replies (formats 20 and 21) with icao24, altitude, squawk and the values of their registers.

    ``flights`` (icao24, timestamp and columns of STATE) gives each message its
    aircraft's last state, at most ``within`` old, in one sort per aircraft.
    """
    long = F.shiftright(F.conv(F.substring(message, 1, 2), 16, 10).cast("int"), 3).isin(20, 21)
    found = replies(messages.filter(long), message, known)
    if flights is None:
        return infer(found, message, {"altitude": F.col("altitude")})
    have = [c for c in STATE if c in flights.columns]
    past = flights.select("icao24", "timestamp", F.struct(*have).alias("_state"), us("timestamp").alias("_since"))
    at = joins.as_of(found, past, ["icao24"], "_state", "_since")
    fresh = us("timestamp") - F.col("_since") <= micros(within)
    state = {c: F.when(fresh, F.col("_state")[c]) for c in have}
    state["altitude"] = F.coalesce(F.col("altitude"), state["altitude"]) if "altitude" in have else F.col("altitude")
    return infer(at, message, state).drop("_state", "_since")


def extend(flights: DataFrame, messages: DataFrame, message: str = "rawmsg", within="30 s") -> DataFrame:
    """Flights' rows with the latest value before of each that registers gave for their aircraft; columns of these names are replaced."""
    names = (*VALUES, "bds_callsign")
    flights = flights.drop(*names)
    read = decode(messages, flights, message, within).select("icao24", "timestamp", F.struct(*names).alias("_read"))
    tie = [c for c in ("event_id",) if c in flights.columns]
    w = W.partitionBy("icao24").orderBy("timestamp", "_side", *tie).rowsBetween(W.unboundedPreceding, 0)
    both = flights.withColumn("_side", F.lit(1)).unionByName(read.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    carried = both.withColumns({c: F.last_value(F.col("_read")[c], True).over(w) for c in names})
    return carried.filter("_side = 1").drop("_side", "_read")
