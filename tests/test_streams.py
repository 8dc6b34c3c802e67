"""Streams against the same data in one batch: frames cut anywhere, positions, landings, restarts, late rows."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackweave.operators import detectors
from trackweave.plans import catalog_more
from trackweave.sources import modes
from trackweave.streaming import beast, flows

T0 = datetime(2024, 1, 1)


def wire(kind, clock, level, message):
    body = bytes([kind]) + clock.to_bytes(6, "big") + bytes([level]) + message
    return b"\x1a" + body[:1] + body[1:].replace(b"\x1a", b"\x1a\x1a")


def stream_of_frames(n, seed):
    rng = random.Random(seed)
    out, want = b"", []
    for _ in range(n):
        kind = rng.choice([0x31, 0x32, 0x33])
        size = {0x31: 2, 0x32: 7, 0x33: 14}[kind]
        # Escapes are common, in runs and at both ends.
        message = bytes(rng.choice([0x1A, 0x1A, 0x31, 0x33, rng.randrange(256)]) for _ in range(size))
        clock, level = rng.choice([rng.randrange(1 << 48), 0x1A1A1A1A1A1A]), rng.choice([0x1A, 7])
        want.append((chr(kind), clock, level, message.hex()))
        out += wire(kind, clock, level, message)
    return out, want


def test_frames_of_chunks_of_any_size():
    data, want = stream_of_frames(60, 1)
    as_row = lambda f: (chr(f[1]), int.from_bytes(f[2:8], "big"), f[8], f[9:].hex())
    for size in (1, 2, 3, 7, 50, len(data)):
        got = list(beast.frames_of(data[i : i + size] for i in range(0, len(data), size)))
        assert [as_row(f) for f in got] == want
    # Cut at every byte: what ends before the cut and what ends after it are all frames, each once.
    for cut in range(len(data) + 1):
        low = max(0, cut - beast.LONGEST)
        while low and data[low] == 0x1A:
            low -= 1
        n = len(list(beast.frames(data[:cut]))) + len(list(beast.frames(data[low:], cut - low)))
        assert n == len(want), cut


def collected(query_of, spark, name):
    """Rows that a stream has put in a memory table."""
    q = query_of.queryName(name).format("memory").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_source_follows_growing_files(spark, tmp_path):
    beast.register(spark)
    folder, check = tmp_path / "feed", tmp_path / "check"
    folder.mkdir()
    feeds = {f"r{k}.bin": stream_of_frames(200, k) for k in range(2)}
    rng = random.Random(5)
    told = dict.fromkeys(feeds, 0)
    out = str(tmp_path / "out")
    for _ in range(4):  # each round is a restart from the checkpoint
        for name, (data, _) in feeds.items():
            to = min(len(data), told[name] + rng.randrange(1, len(data) // 2))
            with (folder / name).open("ab") as f:
                f.write(data[told[name] : to])
            told[name] = to
        s = spark.readStream.format("beast").option("path", str(folder)).option("range_bytes", 777).load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination()
    for name, (data, _) in feeds.items():
        with (folder / name).open("ab") as f:
            f.write(data[told[name] :])
    s = spark.readStream.format("beast").option("path", str(folder)).load()
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted((r.file.rsplit("/", 1)[-1], r.at, r.kind, r.received, r.signal, r.rawmsg) for r in df.collect())
    got = rows(spark.read.parquet(out))
    assert [(r[0], *r[2:]) for r in got] == [(name, *w) for name, (_, want) in feeds.items() for w in want]
    for size in (100, 1 << 20):
        assert rows(spark.read.format("beast").option("path", str(folder)).option("range_bytes", size).load()) == got


def positions(spark, n):
    """Frames of three aircraft, even and odd in turn, some of them without a position."""
    rows = spark.range(n).select(F.col("id").alias("event_id"), (F.lit(0xABC000) + F.col("id") % 3).alias("icao"), F.floor(F.col("id") / 3).alias("k"))
    odd, lat, lon = F.col("k") % 2, 43 + F.col("k") * 0.01, 1 + F.col("k") * 0.02
    d_lat = 360.0 / (60 - odd)
    yz = F.pmod(F.floor(131072 * F.pmod(lat, d_lat) / d_lat + 0.5), F.lit(131072))
    d_lon = 360.0 / F.greatest(F.lit(1), modes.zones(d_lat * (yz / 131072.0 + F.floor(lat / d_lat))) - odd)
    xz = F.pmod(F.floor(131072 * F.pmod(lon, d_lon) / d_lon + 0.5), F.lit(131072))
    position = catalog_more._bits((11, 5), (0, 3), (16, 12), (0, 1), (odd, 1), (yz, 17), (xz, 17))
    speed = catalog_more._bits((19, 5), (1, 3), (0, 5), (0, 1), (101, 10), (0, 1), (51, 10), (0, 1), (0, 1), (1, 9), (0, 10))
    me = F.when(F.col("k") % 5 == 4, speed).otherwise(position)
    at = F.timestamp_add("SECOND", F.col("k").cast("int"), F.lit(T0))
    return rows.select("event_id", at.alias("timestamp"), catalog_more._message(F.lpad(F.hex("icao"), 6, "0"), me).alias("rawmsg"))


def test_positions_of_a_stream_equal_the_batch(spark, tmp_path):
    p = positions(spark, 180).toPandas()
    want = {r.event_id: (r.latitude, r.longitude) for r in modes.decode(spark.createDataFrame(p)).collect()}
    assert sum(v[0] is not None for v in want.values()) > 100
    folder, check, out = tmp_path / "in", str(tmp_path / "check"), str(tmp_path / "out")
    rng = random.Random(3)
    p = p.sort_values("timestamp", kind="stable").reset_index(drop=True)
    p["batch"] = [min(4, int(i // 36) + (rng.random() < 0.2)) for i in range(len(p))]  # some rows come a batch later
    last = pd.DataFrame({"event_id": [10_000 + i for i in range(3)], "timestamp": [T0 + timedelta(hours=1)] * 3, "rawmsg": [p.rawmsg[i] for i in range(3)]})
    late = pd.DataFrame({"event_id": [20_000], "timestamp": [T0], "rawmsg": [p.rawmsg[0]]})
    parts = [p[p.batch == b].drop(columns="batch") for b in range(5)] + [last, late]
    for part in parts:
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(folder))
        s = spark.readStream.schema("event_id long, timestamp timestamp, rawmsg string").parquet(str(folder))
        d = beast.decode_stream(s, late="20 seconds", tie=("event_id",))
        d.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: (r.latitude, r.longitude) for r in spark.read.parquet(out).collect()}
    assert 20_000 not in got  # too late
    assert {k: v for k, v in got.items() if k < 10_000} == want


@pytest.mark.parametrize("rounds", [1, 3])
def test_landings_of_a_stream_equal_the_batch(spark, tmp_path, rounds):
    rng = random.Random(8)
    rows = []
    for a in range(6):
        t = T0 + timedelta(minutes=3 * a)
        for run in range(3):  # approaches from the south, the runway's bearing is north; each ends apart from the next
            for k in range(40):
                rows.append((f"a{a}", t + timedelta(seconds=5 * k), 43.0 - 0.4 + 0.008 * k + rng.uniform(-1e-4, 1e-4), 1.0, 3000.0 - 50 * k, 0.0))
            t += timedelta(seconds=5 * 39 + rng.choice([20, 21, 200]))
    rows.sort(key=lambda r: r[1])
    schema = "icao24 string, timestamp timestamp, latitude double, longitude double, altitude double, track double"
    runways = spark.createDataFrame([("36", 43.0, 1.0, 0.0), ("09", 43.0, 1.0, 90.0)], "name string, latitude double, longitude double, bearing double")
    want = {(r.icao24, r.ILS, r.start, r.stop, r.n, r.altitude_min) for r in detectors.ils_aligned(spark.createDataFrame(rows, schema), runways, ["icao24"]).collect()}
    assert len(want) > 6
    folder, check, out = str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")
    size = -(-len(rows) // rounds)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[("end", T0 + timedelta(days=1), 42.9, 1.0, 0.0, 0.0)]]
    for part in parts:  # each is a restart from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        s = flows.landings(spark.readStream.schema(schema).parquet(folder), runways)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = [(r.icao24, r.ILS, r.start, r.stop, r.n, r.altitude_min) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_reports_heard_twice_and_sessions(spark, tmp_path):
    """distinct_reports, sessions and bucket_stats as streams, with a restart and late rows."""
    schema = "icao24 string, timestamp timestamp, altitude double"
    at = lambda s: T0 + timedelta(seconds=s)
    parts = [[("a", at(0), 1.0), ("a", at(0), 2.0), ("a", at(60), 3.0)], [("a", at(60), 4.0), ("a", at(5000), 5.0), ("b", at(5000), 6.0)], [("a", at(1), 9.0), ("c", at(50_000), 0.0)]]
    folder = str(tmp_path / "in")
    jobs = {"reports": flows.distinct_reports, "sessions": flows.sessions, "buckets": flows.bucket_stats}
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        for name, job in jobs.items():
            s = job(spark.readStream.schema(schema).parquet(folder))
            s = s.withColumn("window", F.col("window.start")) if name == "buckets" else s
            s.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start().awaitTermination()
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}").collect()
    assert sorted((r.icao24, r.timestamp) for r in read("reports")) == [("a", at(0)), ("a", at(60)), ("a", at(5000)), ("b", at(5000)), ("c", at(50_000))]
    assert sorted((r.icao24, r.start, r.stop, r.n) for r in read("sessions")) == [("a", at(0), at(60), 4)]
    buckets = {(r.icao24, r.window): (r.n, r.altitude_max) for r in read("buckets")}
    assert buckets == {("a", at(0)): (2, 2.0), ("a", at(60)): (2, 4.0), ("a", at(4980)): (1, 5.0), ("b", at(4980)): (1, 6.0)}
