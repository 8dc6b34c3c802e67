"""Hand vectors and properties."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackweave import Trajectories
from trackweave.functions import codec, geo
from trackweave.functions.timeunits import micros
from trackweave.operators import grouped, intervals, resample, windows
from trackweave.streaming.flows import beast_frames

T0 = dt.datetime(2024, 1, 1, 12)


def series(spark, values, step=5):
    rows = [("f", T0 + dt.timedelta(seconds=i * step), float(v) if v is not None else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "flight_id string, timestamp timestamp_ntz, altitude double")


def test_resample_lines_and_steps(spark):
    df = series(spark, [30000, 25000, 27000])
    line = [r.altitude for r in resample.resample(df, ["flight_id"], "1s", interpolate=("altitude",)).orderBy("timestamp").collect()]
    assert line == [30000, 29000, 28000, 27000, 26000, 25000, 25400, 25800, 26200, 26600, 27000]
    step = [r.altitude for r in resample.resample(df, ["flight_id"], "1s", ffill=("altitude",)).orderBy("timestamp").collect()]
    assert step == [30000] * 5 + [25000] * 5 + [27000]


def test_unwrap_crosses_north(spark):
    df = series(spark, [345, 355, 5, None, 15], 30).withColumnRenamed("altitude", "track")
    got = [r.track_unwrapped for r in windows.unwrap(df, ["flight_id"], "track").orderBy("timestamp").collect()]
    assert got == [345, 355, 365, None, 375]


def test_split_drops_single_rows_and_keeps_equal_gaps(spark):
    rows = [("a", "c", T0 + dt.timedelta(minutes=m)) for m in (0, 10, 21, 60, 65)]
    df = spark.createDataFrame(rows + [(None, "c", T0)], "icao24 string, callsign string, timestamp timestamp_ntz")
    got = Trajectories(df).iterate("10 min").df.groupBy("flight_id").count().collect()
    assert sorted(r["count"] for r in got) == [2, 2]


def test_simplify_keeps_a_vertex_at_the_tolerance():
    assert grouped.douglas_peucker(np.array([[0, 0, 0], [100, 1, 0], [200, 0, 0]], float), 1).all()
    with pytest.raises(ValueError):
        grouped.douglas_peucker(np.zeros((3, 2)), -1)


def test_interval_algebra(spark):
    h = lambda k: T0 + dt.timedelta(minutes=k)
    make = lambda *p: spark.createDataFrame([("k", h(a), h(b)) for a, b in p], "k string, start timestamp_ntz, stop timestamp_ntz")
    read = lambda d: sorted(((r.start - T0).seconds // 60, (r.stop - T0).seconds // 60) for r in d.collect())
    assert read(intervals.consolidate(make((0, 2), (3, 6), (6, 8), (1, 5)), ["k"])) == [(0, 8)]
    assert read(intervals.difference(make((0, 8)), make((3, 6)), ["k"])) == [(0, 3), (6, 8)]
    assert read(intervals.difference(make((1, 5), (0, 8)), make((7, 8)), ["k"])) == [(0, 7)]
    assert read(intervals.intersection(make((0, 2)), make((1, 5)), ["k"])) == [(1, 2)]
    assert read(intervals.intersection(make((0, 2), (3, 6)), make((7, 8)), ["k"])) == []


@pytest.mark.parametrize("icao, n", [("a00001", "N1"), ("a00002", "N1A"), ("a00003", "N1AA"), ("a0001a", "N1AZ"), ("a0001b", "N1B"), ("a00259", "N1ZZ"), ("a0025a", "N10")])
def test_registrations(spark, icao, n):
    r = spark.range(1).select(codec.icao_to_n_number(F.lit(icao)).alias("n"), codec.n_number_to_icao(F.lit(n)).alias("i")).first()
    assert (r.n, r.i) == (n, icao)


def test_frames_of_a_byte_stream():
    body = bytes([0x1A, 0x33]) + bytes(range(20)) + b"\x1a\x1a"
    got = beast_frames([body[:7], body[7:], b"\x1a\x31\x00"])
    assert got == [bytes([0x1A, 0x33]) + bytes(range(20)) + b"\x1a"]


@given(st.integers(1, 10**6), st.sampled_from(["s", "min", "h", "d"]))
def test_durations(n, unit):
    assert micros(f"{n} {unit}") == n * micros(f"1{unit}")


@given(st.lists(st.lists(st.booleans(), min_size=3, max_size=3), min_size=1, max_size=9))
def test_longest_chain_matches_search(ok):
    ok = np.array(ok)
    n = len(ok)

    def longest(i):
        return 1 + max([longest(i + h + 1) for h in range(3) if i + h + 1 < n and ok[i, h]], default=0)

    assert grouped.longest_consistent(ok).sum() == max(longest(i) for i in range(n))


def test_facade(spark):
    df = series(spark, range(10)).withColumn("icao24", F.lit("a"))
    t = Trajectories(df)
    assert t.first("20 s").df.count() == 4
    assert (t + t).df.count() == 20 and (t - t).df.count() == 0 and (t & t).df.count() == 10
    assert t.pipe("longer_than('10 s')").df.count() == 10
    assert t["f"].df.count() == 10
    with pytest.raises(AttributeError):
        t.no_such_thing


def test_polygons(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    r = spark.range(1).select(ring.alias("r")).select(geo.in_ring(F.lit(1.0), F.lit(1.0), "r").alias("a"), geo.in_ring(F.lit(5.0), F.lit(1.0), "r").alias("b"), geo.ring_distance(F.lit(1.0), F.lit(2.0), "r").alias("d"), geo.ring_area("r").alias("s")).first()
    assert (r.a, r.b, r.d, r.s) == (True, False, 1.0, 16.0)


def test_distance_of_nothing(spark):
    """A missing position has no distance, and a flight's first row adds none."""
    from trackweave.functions import geo
    from trackweave.operators import windows

    rows = [("a", "2024-01-01 00:00:00", 0.0, 0.0), ("a", "2024-01-01 00:10:00", 0.0, 1.0), ("a", "2024-01-01 00:20:00", None, None)]
    df = spark.createDataFrame(rows, "flight_id string, t string, latitude double, longitude double").selectExpr("flight_id", "cast(t as timestamp_ntz) timestamp", "latitude", "longitude")
    got = windows.cumulative_distance(df, ["flight_id"]).orderBy("timestamp").select("cumdist").collect()
    assert [round(r[0]) for r in got] == [0, 60, 60]
    assert df.filter("latitude is null").select(geo.distance("latitude", "longitude", "latitude", "longitude")).first()[0] is None
    ends = [F.lit(x) for x in (90.0, 0.0, -90.0, 0.0)]
    far, nan = df.select(geo.distance(*ends), geo.distance(*ends[:3], F.lit(float("nan")))).first()
    assert round(far) == round(geo.R_NM * np.pi) and np.isnan(nan)


def test_local_files(spark, tmp_path):
    """What pandas writes is read back; too many rows and unknown suffixes are refused."""
    import pytest

    from trackweave.sources import exchange, files

    df = spark.range(5)
    exchange.write_local(df, str(tmp_path / "a.feather"))
    exchange.write_local(df, str(tmp_path / "a.pkl"))
    assert files.read(spark, str(tmp_path / "a.feather")).count() == files.read(spark, str(tmp_path / "a.pkl")).count() == 5
    with pytest.raises(ValueError):
        exchange.write_local(df, str(tmp_path / "b.pkl"), rows=4)
    with pytest.raises(ValueError):
        exchange.write_local(df, str(tmp_path / "b.doc"))
    with pytest.raises(ValueError):
        exchange.raw_messages(df, "time, other")


def test_central_row_without_copies(spark, monkeypatch):
    """Before, every row was shuffled once for each block of rows (F6); bounds and rounds must lose no row."""
    from trackweave.operators import ml

    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "k long, features array<double>")
    assert ml.centroid(few, "k")._jdf.queryExecution().optimizedPlan().toString().count("explode(") == 1
    rng = np.random.default_rng(6)
    tables = {
        "round": rng.normal(size=(300, 6)) / 3,
        "groups": np.concatenate([rng.normal(size=(200, 6)) * 0.05, rng.normal(size=(100, 6)) + 4, np.zeros((9, 6))]),
        "same": np.ones((50, 3)),
    }
    for name, x in tables.items():
        keys = np.arange(len(x)) if name != "groups" else np.arange(len(x)) % 280
        df = spark.createDataFrame([(int(k), r.astype("float32").tolist()) for k, r in zip(keys, x)] + [(None, [9.0] * x.shape[1]), (7777, None)], "k long, features array<float>").repartition(3)
        x = x.astype("float32").astype(float)
        d = np.linalg.norm(x[:, None] - x[None], axis=2) * (keys[:, None] != keys[None])
        mean = {int(k): d[keys == k].sum() / (keys[None] != keys[keys == k][:, None]).sum() for k in np.unique(keys)}
        want = min(mean, key=lambda k: (round(mean[k], 12), k))
        bounds = {r.a: r for r in ml._mean_bounds(df.select(F.col("k").alias("a"), F.col("features").alias("va")).dropna()).collect()}
        assert set(bounds) == set(mean) and all(bounds[k].lower <= m <= bounds[k].upper for k, m in mean.items()), name
        for last, round_, rows, cells_ in ((4096, 16_384, 65_536, 2_000_000), (0, 40, 70, 100)):
            for c, value in (("CENTRAL_BLOCK", last), ("CENTRAL_ROUND", round_), ("CENTRAL_ROWS", rows), ("CENTRAL_CELLS", cells_)):
                monkeypatch.setattr(ml, c, value)
            (r,) = ml.centroid(df, "k").collect()
            assert r.k == want and abs(r.mean_distance - mean[want]) < 1e-7, (name, last)
    assert ml.centroid(df.limit(0), "k").count() == 0
