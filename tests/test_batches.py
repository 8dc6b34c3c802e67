"""Flights that share Arrow batches, cut anywhere, give what each gives alone."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.operators import faults, grouped

T0 = datetime(2024, 1, 1)


@pytest.fixture(params=[1, 7, 10_000])
def batch(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def table(spark):
    """Flights of 1 to 25 rows, a null key, a null value and a large whole number; rows out of order."""
    rows = [(f or None, f * 100 + k + 2**60, T0 + timedelta(minutes=20 * k), None if (f, k) == (3, 1) else float(k * f)) for f in range(14) for k in range(f * 2 or 1)]
    return rows, spark.createDataFrame(rows[::-1], "flight long, event_id long, timestamp timestamp, v double").repartition(5)


def test_columns_and_rows(spark, batch):
    rows, df = table(spark)

    def run(f):
        assert (np.diff(f["timestamp"]) > 0).all()
        return np.flatnonzero(np.arange(len(f)) % 2 == 0), {"n": np.full((len(f) + 1) // 2, len(f))}

    got = grouped.per_flight(df, ["flight"], run, n="long").collect()
    size = lambda f: f * 2 if f else 1
    key = lambda r: r[1]
    assert sorted(map(tuple, got), key=key) == sorted(((*r, size(r[0])) for r in rows if (r[1] - 2**60) % 100 % 2 == 0), key=key)
    assert grouped.per_flight(df.limit(0), ["flight"], run, n="long").count() == 0


def test_any_function_by_time(spark, batch):
    rows, df = table(spark)
    got = grouped.apply_time(df, ["flight"], "1 h", n=lambda f: len(f), most=lambda f: np.fmax.reduce(f["v"])).collect()
    want = df.groupBy("flight", F.expr("timestamp_micros(cast(bround(unix_micros(timestamp) / 3600000000D, 0) as bigint) * 3600000000)").alias("rounded")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("v").alias("most"))
    assert {tuple(r) for r in got} == {tuple(r) for r in want.collect()}


def test_faults(spark, batch):
    rows, df = table(spark)

    def run(pdf):
        if pdf["flight"].iloc[0] in (2, 5):
            raise ValueError("no")
        return pdf.assign(v=1) if pdf["flight"].iloc[0] == 7 else pdf

    good, bad = faults.guarded(df, ["flight"], run)
    key = lambda r: r[1]
    assert sorted(map(tuple, good.collect()), key=key) == sorted(((*r[:3], 1.0) if r[0] == 7 else r for r in rows if r[0] not in (2, 5)), key=key)
    assert sorted(tuple(r)[:3] for r in bad.select("flight", "error", "n").collect()) == [(2, "ValueError", 4), (5, "ValueError", 10)]


def test_many_short_flights_take_no_group_each(spark):
    """A group of its own for each flight cost far more than its rows (2,156 flights took 24 to 44 s)."""
    df = spark.range(40_000).select((F.col("id") / 2).cast("long").alias("flight"), F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("timestamp"))
    plan = grouped.sliding_windows(df, ["flight"], "1 min", "1 min")
    assert "FlatMapGroups" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 40_000


def test_a_message_is_computed_once(spark):
    """The check sum read its message at each of eleven bytes, so a computed message was made again for each."""
    from trackweave.sources import modes

    message = F.concat(F.lit("8D"), F.sha1(F.col("id").cast("string").cast("binary")))
    plan = spark.range(3).select(modes.valid(message).alias("ok"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") == 1


def test_central_row_of_several_blocks(spark, monkeypatch):
    """Blocks meet as matrix products; every pair was a row of a join before."""
    from trackweave.operators import ml

    v = np.random.default_rng(3).normal(size=(90, 5)) + 1e4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[7].tolist())], "k long, features array<double>")
    monkeypatch.setattr(ml, "CENTRAL_BLOCK", 16)
    keys, all_ = np.array([*range(90), 0]), np.vstack([v, v[7]])
    d = np.linalg.norm(all_[:, None] - all_[None], axis=2) * (keys[:, None] != keys[None])
    mean = [d[keys == k].sum() / (keys[None] != keys[keys == k][:, None]).sum() for k in range(90)]
    found = ml.centroid(df, "k")
    (r,) = found.collect()
    assert r.k == int(np.argmin(mean)) and abs(r.mean_distance - min(mean)) < 1e-6
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "FlatMapCoGroups" in found._jdf.queryExecution().toString()
