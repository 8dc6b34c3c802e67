"""The least row of each pair of aircraft, block by block."""

import random

from pyspark.sql import functions as F

from trackweave.operators import joins


def test_blocks_give_the_rows_of_the_join(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"a{rng.randrange(12)}", 1_700_000_000 + rng.randrange(20_000), rng.choice([43.0, 43.1, 43.5]) + rng.choice([0.0, 0.01]), rng.choice([1.0, 1.2, None]), rng.choice([10.0, 40.0, 90.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "event_id long, icao24 string, s long, latitude double, longitude double, altitude double").withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))
    names = ["icao24_x", "icao24_y", "timestamp_x", "timestamp_y", "event_id_x", "event_id_y", F.round("lateral", 9), "vertical"]
    want = sorted(map(tuple, joins.cpa_min(joins.closest_approach(df, 20, 60, "1 h"), "lateral").select(*names).collect()))
    # Before, each close pair of rows was shuffled twice, with all its columns (there was no closest_pairs()).
    for rows_, pairs in ((50_000, 2_000_000), (20, 7)):
        monkeypatch.setattr(joins, "PAIR_ROWS", rows_)
        monkeypatch.setattr(joins, "PAIRS_AT_ONCE", pairs)
        got = sorted(map(tuple, joins.closest_pairs(df, 20, 60, "1 h").select(*names).collect()))
        assert got == want and len(got) > 20
    assert joins.closest_pairs(df.limit(0), 20, 60, "1 h").count() == 0


def test_dme_errors_are_those_of_plain_loops(spark):
    """Least error and names, with ties, a station without a name, and rows that see none."""
    import math

    names = ["B", "A", None, "A_", "C"]
    rows = [[(n, 10.0 + 40 * (k * i % 4), (i * 40 * k + 17 * (i % 3)) % 360.0) for k, n in enumerate(names[: i % 6])] for i in range(60)] + [None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, v array<struct<name:string,d:double,b:double>>")
    got = {r.i: r.e for r in df.select("i", joins.least_dme_error()("v").alias("e")).collect()}
    for i, row in enumerate(rows):
        best = None
        for k, (n, d, b) in enumerate(row or []):
            for n2, d2, b2 in row[k + 1 :]:
                turn = (b - b2) % 360
                angle = min(turn, 360 - turn)
                if 30 <= angle <= 150:
                    e = 2 * math.sqrt(max(0.085, 0.00125 * d) ** 2 + max(0.085, 0.00125 * d2) ** 2 + 2 * 0.05**2) / math.sin(math.radians(angle))
                    x = (round(e, 12), "_".join(z for z in (n, n2) if z is not None))
                    best = x if best is None or x < best else best
        assert (got[i] and (round(got[i].e, 12), got[i].pair)) == best, i


def test_rows_go_once_to_where_they_meet(spark):
    """Before, a row was sent to each cell around it: seven records a row (F14)."""
    df = spark.range(2000).selectExpr("id event_id", "id % 50 icao24", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 7) timestamp", "43 + id % 97 / 20 latitude", "1 + id % 89 / 20 longitude", "double(id % 31) altitude")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to broadcast
    try:
        j = joins.closest_approach(df, 40, 60, "1 h").select("event_id_x", "event_id_y")
        assert len(j.collect()) > 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

    def sent(plan):
        inner = "executedPlan" if plan.nodeName() == "AdaptiveSparkPlan" else "plan" if plan.nodeName().endswith("QueryStage") else None
        kids = [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
        own = plan.metrics().get("shuffleRecordsWritten").get().value() if plan.nodeName() == "Exchange" else 0
        # The numbers of rows by slot are a few records of their own.
        return own + sum(map(sent, kids)) if plan.nodeName() != "BroadcastExchange" else 0

    assert 2000 <= sent(j._jdf.queryExecution().executedPlan()) < 3000


def test_tiles_and_blocks_give_all_close_pairs(spark, monkeypatch):
    """Date line, both poles, tile edges, equal rows, odd values; whole tiles, then blocks of few rows."""
    import math

    rng = random.Random(5)
    places = [(0.0, 179.99), (0.01, -180.0), (89.98, 10.0), (89.97, -170.0), (90.0, 0.0), (-89.99, 77.0), (-90.0, 5.0), (5.333, 5.33), (-5.334, 360.0), (50.0, 0.0), (50.01, 719.99), (10.0, -0.01)]
    rows = []
    for i in range(400):
        y, x = rng.choice(places)
        y, x = y + rng.choice([0.0, 0.0, rng.uniform(-0.4, 0.4)]), x + rng.choice([0.0, 0.0, rng.uniform(-0.5, 0.5)])
        rows.append((i // 2 if i % 20 == 1 else i, f"a{rng.randrange(9)}", rng.randrange(9000), max(-90.0, min(90.0, y)), x, rng.choice([10.0, 40.0, 70.0, 99.5])))
    rows += [(i // 2, k, 100, 0.0, 180.0, 40.0) for i in range(6) for k in ("a1", "b")]
    odd = [(900, None, 1, 0.0, 180.0, 40.0), (901, "c", None, 0.0, 180.0, 40.0), (902, "c", 1, float("nan"), 180.0, 40.0), (903, "c", 1, 0.0, float("inf"), 40.0), (904, "c", 1, 0.0, 180.0, float("nan")), (905, "c", 1, 0.0, None, 40.0), (906, "c", 1, 1e18, 7.0, 40.0)]
    df = spark.createDataFrame(rows + odd, "event_id long, icao24 string, s long, latitude double, longitude double, altitude double").withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))

    def apart(p, q):
        a, b, c, d = (math.radians(v) for v in (p[3], p[4], q[3], q[4]))
        return 2 * joins.geo.R_NM * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    want = sorted((p[0], q[0], p[1], q[1], p[2] // 3600, round(apart(p, q), 6), abs(p[5] - q[5])) for p in rows for q in rows if p[1] != q[1] and p[2] // 3600 == q[2] // 3600 and abs(p[5] - q[5]) <= 30 and apart(p, q) <= 20)
    names = ["event_id_x", "event_id_y", "icao24_x", "icao24_y", F.col("bucket") % 100000, F.round("lateral", 6), "vertical"]
    for group, at_once, tile in ((20_000, 200_000, 16), (7, 50, 16), (30, 3, 1)):
        for name, value in (("GROUP_ROWS", group), ("MEETINGS_AT_ONCE", at_once), ("TILE", tile)):
            monkeypatch.setattr(joins, name, value, raising=False)
        got = joins.closest_approach(df, 20, 30, "1 h")
        assert got.columns == [f"{c}_x" for c in ("timestamp", "icao24", "latitude", "longitude", "altitude", "event_id")] + ["bucket"] + [f"{c}_y" for c in ("timestamp", "icao24", "latitude", "longitude", "altitude", "event_id")] + ["lateral", "vertical"]
        assert sorted(map(tuple, got.select(*names).collect())) == want and len(want) > 1000
    assert joins.closest_approach(df.limit(0), 20, 30, "1 h").count() == 0
    few = joins.closest_approach(df, 20, 30, "1 h", keep=["event_id"])
    assert few.columns == ["event_id_x", "event_id_y", "lateral", "vertical"] and few.count() == len(want)


def test_rows_of_blocks_are_not_copied(spark, monkeypatch):
    """Before, each row was shuffled once for every block of aircraft (F5); equal rows, ties and aircraft of one row, with and without places for all pairs."""
    rng = random.Random(8)
    rows = [(i // 2 if i % 9 == 1 else i, rng.randrange(40) if i % 3 else 1000 + i, 1_700_000_000 + rng.randrange(3) * 3600, 43.0 + rng.randrange(3) / 4, 1.0 + rng.randrange(2) / 8, float(rng.randrange(4) * 30)) for i in range(240)]
    rows += [(999, 7, 1_700_000_000, float("nan"), 1.0, 30.0), (998, 7, 1_700_000_000, 43.0, None, 30.0), (997, 7, 1_700_000_000, 43.0, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "event_id long, icao24 long, s long, latitude double, longitude double, altitude double").withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))
    names = ["icao24_x", "icao24_y", "timestamp_x", "timestamp_y", "event_id_x", "event_id_y", F.round("lateral", 9), "vertical"]
    want = sorted(map(tuple, joins.cpa_min(joins.closest_approach(df, 20, 40, "1 h"), "lateral").select(*names).collect()))
    for rows_, pairs, places, batch in ((50_000, 2_000_000, 5_000_000, 100_000), (25, 9, 5_000_000, 4), (25, 9, 0, 100_000)):
        for name, value in (("PAIR_ROWS", rows_), ("PAIRS_AT_ONCE", pairs), ("PAIR_PLACES", places), ("RESULT_ROWS", batch)):
            monkeypatch.setattr(joins, name, value, raising=False)
        found = joins.closest_pairs(df, 20, 40, "1 h")
        assert sorted(map(tuple, found.select(*names).collect())) == want and len(want) > 1000
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroups" not in plan and "hashpartitioning" not in plan
