"""Flights that raise, and the ones beside them."""

from datetime import datetime, timedelta

from trackweave import Trajectories
from trackweave.operators import faults

T0 = datetime(2024, 1, 1)


def test_one_poisoned_flight(spark):
    rows = [(f, f * 10 + k, T0 + timedelta(seconds=9 - k), float(k), None if k == 2 else "x") for f in range(6) for k in range(4)] + [(None, 99, T0, 7.0, "y")]
    df = spark.createDataFrame(rows, "flight long, event_id long, timestamp timestamp, altitude double, note string")

    def climb(pdf):
        assert pdf["timestamp"].is_monotonic_increasing
        if pdf["flight"].iloc[0] == 3:
            raise KeyError("poisoned")
        return None if pdf["flight"].iloc[0] == 4 else pdf.assign(altitude=pdf["altitude"] + 1)

    good, bad = Trajectories(df, ["flight"]).guarded(climb)
    key = lambda r: (r[0] is None, r[1])
    assert sorted(map(tuple, good.df.collect()), key=key) == sorted([(f, e, t, a + 1, n) for f, e, t, a, n in rows if f not in (3, 4)], key=key)
    (r,) = bad.collect()
    assert (r.flight, r.error, r.message, r.n) == (3, "KeyError", "'poisoned'", 4) and "climb" in r.trace
    assert good.df.schema == df.schema


def test_results_that_dont_fit(spark):
    df = spark.createDataFrame([(f, float(f)) for f in range(4)] + [(None, 1.0)], "flight long, v double")
    wrong = lambda pdf: pdf.assign(v="text") if pdf["flight"].isna().any() or pdf["flight"].iloc[0] == 2 else pdf.drop(columns="v") if pdf["flight"].iloc[0] == 1 else pdf
    good, bad = faults.guarded(df, ["flight"], wrong)
    assert sorted(r.flight for r in good.collect()) == [0, 3]
    assert sorted((r.flight is None, r.flight, r.error) for r in bad.collect()) == [(False, 1, "KeyError"), (False, 2, "ArrowInvalid"), (True, None, "ArrowInvalid")]
    good, bad = faults.guarded(df.limit(0), ["flight"], wrong)
    assert good.count() == bad.count() == 0
