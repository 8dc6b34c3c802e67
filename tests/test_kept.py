"""Results kept by content: hits read no source, changed sources and plans miss."""

import os
import time

from pyspark.sql import functions as F

from trackweave import Trajectories
from trackweave.operators import kept


def test_hits_and_misses(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "kept")
    rows = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("icao24"), (F.col("id") * 2.0).alias("altitude"))
    rows(0, 50).coalesce(1).write.parquet(source)
    plan = lambda over=10: Trajectories(spark.read.parquet(source), ["icao24"]).query(f"altitude > {over}")
    entries = lambda: sorted(e for e in os.listdir(folder) if not e.startswith("."))
    first = plan().kept(folder)
    assert first.df.count() == 44 and len(entries()) == 1 and not any(source in f for f in first.df.inputFiles())
    stamp = os.stat(f"{folder}/{entries()[0]}/_SUCCESS").st_mtime_ns
    again = plan().kept(folder)
    assert again.df.count() == 44 and len(entries()) == 1 and os.stat(f"{folder}/{entries()[0]}/_SUCCESS").st_mtime_ns == stamp
    assert not any(source in f for f in again.df.inputFiles())
    assert plan(20).kept(folder).df.count() == 39 and len(entries()) == 2
    assert Trajectories(spark.read.parquet(source).withColumnRenamed("altitude", "height"), ["icao24"]).query("height > 10").kept(folder).df.columns == ["icao24", "height"]
    assert len(entries()) == 3
    rows(50, 60).write.mode("append").parquet(source)
    assert plan().kept(folder).df.count() == 54 and len(entries()) == 4
    time.sleep(0.05)
    plan().kept(folder, max_age=0.01)
    assert len(entries()) == 4 and not any(e.startswith("_") for e in entries())


def test_what_has_no_key(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(5).write.parquet(source)
    df = spark.read.parquet(source)
    twice = df.mapInPandas(lambda it: it, df.schema)
    assert kept.content_key(twice) is None and kept.content_key(twice, "one") != kept.content_key(twice, "two")
    assert kept.content_key(df.withColumn("r", F.rand())) is None
    assert kept.content_key(spark.createDataFrame([(1,)], "a int")) is None
    assert kept.kept(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "k")).count() == 1
    a, b = df.filter("id > 1"), spark.read.parquet(source).filter(F.col("id") > 1)
    assert kept.content_key(a) == kept.content_key(b) != kept.content_key(df)
