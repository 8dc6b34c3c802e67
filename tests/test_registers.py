"""Registers in Mode S replies: public messages, rivals, states of the aircraft."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackweave.plans import catalog_more
from trackweave.sources import registers

T0 = datetime(2024, 1, 1)
# Messages of public documentation and what they are known to say.
PUBLIC = {
    "A000029C85E42F313000007047D3": {"bds": "40", "selected_mcp": 3008, "selected_fms": 3008, "barometric_setting": 1020},
    "A000139381951536E024D4CCF6B5": {"bds": "50", "roll": 2.109375, "true_track": 114.2578125, "ground_speed": 438, "track_rate": 0.125, "TAS": 424},
    "A0001691FFD263377FFCE02B2BF9": {"bds": "50", "roll": -0.3515625},
    "A00004128F39F91A7E27C46ADC21": {"bds": "60", "heading": 42.71484375, "IAS": 252, "Mach": 0.42, "vrate_barometric": -1920, "vrate_inertial": -1920},
    "A000083E202CC371C31DE0AA1CCF": {"bds": "20", "bds_callsign": "KLM1017"},
    "A0001993202422F2E37CE038738E": {"bds": "20", "bds_callsign": "IBK2873"},
    "A800178D10010080F50000D5893C": {"bds": "10"},
    "A0000638FA81C10000000081A92F": {"bds": "17"},
    "A0001692185BD5CF400000DFC696": {"bds": "44", "wind_speed": 22, "wind_direction": 344.53125, "temperature": -48.75},
    "A0000000000000000000000000AA": {"bds": None},
}


def test_public_messages(spark):
    df = spark.createDataFrame([(m,) for m in (*PUBLIC, "8D40621D58C382D690C8AC2863A7", "zz", None)], "rawmsg string")
    got = {r.rawmsg: r.asDict() for r in registers.decode(df).collect()}
    assert set(got) == set(PUBLIC)
    for m, want in PUBLIC.items():
        assert {k: got[m][k] for k in want} == want
        others = [k for k in registers.VALUES if k not in want and m not in ("A0001691FFD263377FFCE02B2BF9",)]
        assert all(got[m][k] is None for k in others)


def rivals(spark):
    """A payload that fits 5,0 (roll 0, track 90, 400 kt) and 6,0 as well, when nothing else is known."""
    b = catalog_more._bits((1, 1), (0, 1), (256, 9), (1, 1), (0, 1), (512, 10), (1, 1), (100, 10), (0, 1), (0, 1), (0, 9), (1, 1), (100, 10))
    return spark.range(1).select(F.lit("A00000780" + "0" * 5).alias("x"), b.alias("me"))


@pytest.mark.parametrize("track, want", [(90.0, "50"), (45.0, "60")])
def test_the_aircrafts_state_decides(spark, track, want):
    """One payload under two states: track and speed of a turn, or heading and airspeed on another course."""
    # Bits 0-10 fit a roll and a heading, 11-22 a track and an airspeed, 23-33 a speed and a Mach number.
    me = catalog_more._bits((1, 1), (0, 1), (256, 9), (1, 1), (1, 1), (0, 10), (1, 1), (150, 10), (0, 1), (0, 10), (0, 1), (0, 10))
    p = spark.range(1).select(F.lit(0xABCDEF).cast("long").alias("icao24"))
    sent = catalog_more._long_reply(p, F.lit(0x78), me).select("rawmsg").withColumn("timestamp", F.lit(T0 + timedelta(seconds=5)))
    turning = {"50": (300.0, 180.0), "60": (255.0, 45.0)}[want]
    state = spark.createDataFrame([("abcdef", T0, turning[0], turning[1], 0.0)], "icao24 string, timestamp timestamp, groundspeed double, track double, vertical_rate double")
    both = {r.bds for r in registers.decode(sent, state).collect()}
    assert both <= {want, None}
    stale = registers.decode(sent, state, within="1 s").collect()[0]
    plain = registers.decode(sent).collect()[0]
    assert (stale.bds, stale.bds_lead) == (plain.bds, plain.bds_lead)


def test_flights_are_extended(spark):
    p = spark.createDataFrame([(k, 0xABCDEF, T0 + timedelta(seconds=k), 400.0, 100.0, 0.0) for k in range(4)], "event_id long, icao24 long, timestamp timestamp, groundspeed double, track double, vertical_rate double")
    sent = catalog_more._sent_registers(p).select("timestamp", "rawmsg")
    flights = p.withColumn("icao24", F.lit("abcdef"))
    out = registers.extend(flights, sent).orderBy("event_id").collect()
    assert [r.selected_mcp for r in out] == [960.0] * 4
    assert [r.ground_speed for r in out] == [None, 400.0, 400.0, 400.0]
    assert [r.IAS for r in out] == [None, None, 392.0, 392.0]
    assert registers.extend(flights.limit(0), sent).count() == 0
    assert [r.roll for r in registers.extend(flights, sent.limit(0)).collect()] == [None] * 4
