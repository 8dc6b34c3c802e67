"""Work that is done once for many flights or parts, where it was done for each."""

from pyspark.sql import functions as F

from trackweave.operators import clip, graphs, grouped, matching


def test_a_path_is_sought_once_for_flights_with_the_same_ends(spark):
    # Before, each flight was a group of its own that sought its path (0.9 ms a row).
    nodes = spark.createDataFrame([(i, 0.0, float(i)) for i in range(5)], "node long, latitude double, longitude double")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.0)], "u long, v long, w double")
    rows = [(f, t, 0.1, x) for f in range(20) for t, x in ((1, 0.1), (2, 9.0), (3, 3.2))] + [(99, 1, 0.0, 0.0), (99, 2, 0.0, 4.0)]
    df = spark.createDataFrame(rows, "f long, s long, latitude double, longitude double").select("f", F.timestamp_seconds("s").alias("timestamp"), "latitude", "longitude")
    out = graphs.map_match(df, ["f"], nodes, edges)
    assert sorted(map(tuple, out.collect())) == [(f, n, n) for f in range(20) for n in range(4)]  # no way to node 4
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert grouped.shortest_path(grouped.steps_of([(0, 1, 2.0)]), 1, 0) == [1, 0]


def test_chains_of_short_flights_share_batches(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(7, 1, 2)], "edge long, u long, v long")
    df = spark.range(40).select((F.col("id") % 20).alias("flight"), F.timestamp_seconds("id").alias("timestamp"), (F.col("id") * 2.0).alias("x"), F.lit(1.0).alias("y"))
    out = matching.match(df, ["flight"], nodes, edges)
    assert [r.edge for r in out.collect()] == [7] * 40
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_legs_meet_zones_by_box_before_they_are_cut(spark):
    # Before, all legs and zones of a cell were cut with each other, and a leg's cuts were computed anew for each part.
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1))])
    zones = spark.range(1).select(F.lit("z").alias("name"), ring.alias("ring"))
    df = spark.createDataFrame([(1, 1, 0.05, -0.1), (1, 2, 0.05, 0.2), (2, 1, 0.3, 0.3), (2, 2, 0.4, 0.4)], "f long, s long, latitude double, longitude double")
    df = df.select("f", F.timestamp_seconds("s").alias("timestamp"), "latitude", "longitude")
    parts = clip.parts_inside(df, zones, ["f"])
    assert [r.f for r in parts.collect()] == [1]
    cuts = parts._jdf.queryExecution().optimizedPlan().toString()
    assert cuts.count("array_distinct(") == 1 and "(greatest(x0" in cuts.split("Join")[1].split("\n")[0]
