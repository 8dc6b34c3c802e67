"""Holding patterns by a learned classifier of time windows (pyspark.ml).

A window's features are sums over its rows, so they are partial before the
shuffle; neighbouring windows that look like holding become one segment.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.timeunits import micros, us
from .keys import TIME, ordered
from .scratch import discard, materialize

#: Windows, and how far apart they begin.
LENGTH, STEP = "8 minutes", "2 minutes"
#: Generated flights in a task.
FLIGHTS = 2000
FEATURES = ["turned", "turned_all", "straight", "reached", "height", "pace"]


def windows(df: DataFrame, by: list[str], length: str = LENGTH, step: str = STEP) -> DataFrame:
    """by, start, stop and FEATURES of each time window of a flight with ten rows or more.

    turned: the sum of turns without sign, in circles; turned_all: that of
    turns with sign; straight: the share of rows that hardly turn; reached: the
    distance between the window's ends over the way flown; height: the change
    of altitude in 1,000 ft; pace: rows' turns a minute where they turn.
    """
    w = ordered(df, by)
    turn = F.pmod(F.col("track") - F.lag("track").over(w) + 180.0, F.lit(360.0)) - 180.0
    way = geo.distance(F.lag("latitude").over(w), F.lag("longitude").over(w), "latitude", "longitude")
    minutes = (us(TIME) - us(F.lag(TIME).over(w))) / 6e7
    rows = df.filter("latitude is not null and longitude is not null and track is not null").select(*by, TIME, "latitude", "longitude", F.col("altitude").cast("double").alias("_alt"), F.coalesce(turn, F.lit(0.0)).alias("_turn"), F.coalesce(way, F.lit(0.0)).alias("_way"), F.coalesce(minutes, F.lit(0.0)).alias("_min"))
    still = F.abs(F.col("_turn")) < 30.0 * F.col("_min")
    at = F.struct("latitude", "longitude", "_alt")
    # Numbers of the windows that a row lies in, by a generator: unlike F.window() it leaves flights where they are.
    size, pace = micros(length), micros(step)
    last = F.floor(us(TIME) / F.lit(pace))
    rows = rows.filter(F.col(TIME).isNotNull()).withColumn("_w", F.explode(F.sequence(last - (-(-size // pace) - 1), last))).filter(us(TIME) < F.col("_w") * pace + size)
    each = rows.groupBy(*by, "_w").agg(
        F.count(F.lit(1)).alias("_n"), F.min(TIME).alias("start"), F.max(TIME).alias("stop"), F.min_by(at, TIME).alias("_a"), F.max_by(at, TIME).alias("_b"), F.sum("_way").alias("_path"),
        (F.sum(F.abs("_turn")) / 360).alias("turned"), (F.abs(F.sum("_turn")) / 360).alias("turned_all"), F.avg(F.when(still, 1.0).otherwise(0.0)).alias("straight"),
        (F.try_divide(F.sum(F.when(~still, F.abs("_turn"))), F.sum(F.when(~still, F.col("_min")))) / 180).alias("pace"),
    ).filter("_n >= 10")
    reached = geo.distance("_a.latitude", "_a.longitude", "_b.latitude", "_b.longitude") / F.greatest(F.col("_path"), F.lit(0.1))
    height = F.coalesce(F.abs(F.col("_b._alt") - F.col("_a._alt")) / 1000, F.lit(0.0))
    return each.select(*by, "start", "stop", "turned", "turned_all", "straight", F.least(reached, F.lit(1.5)).alias("reached"), height.alias("height"), F.coalesce("pace", F.lit(0.0)).alias("pace"))


def fit(labelled: DataFrame, regularised: float = 1e-4) -> PipelineModel:
    """A logistic regression over FEATURES and their products; labelled: windows() with label 0.0 or 1.0.

    The model is saved and loaded as any of pyspark.ml: write().save(path),
    PipelineModel.load(path).
    """
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="_raw"), PolynomialExpansion(degree=2, inputCol="_raw", outputCol="_wide"),
        StandardScaler(inputCol="_wide", outputCol="_scaled"), LogisticRegression(featuresCol="_scaled", labelCol="label", regParam=regularised, probabilityCol="_p", rawPredictionCol="_r", predictionCol="predicted"),
    ]
    return Pipeline(stages=stages).fit(labelled)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scored(found: DataFrame, model: PipelineModel) -> DataFrame:
    """windows() with p, the probability of holding."""
    return model.transform(found).withColumn("p", F.get(vector_to_array("_p"), F.lit(1))).drop("_raw", "_wide", "_scaled", "_r", "_p", "predicted")


def learned(df: DataFrame, by: list[str], model: PipelineModel, least: float = 0.5, length: str = LENGTH, step: str = STEP) -> DataFrame:
    """Segments (by, seg_idx, start, stop, n windows, p_max) of windows that look like holding; those that overlap or touch are one."""
    hits = scored(windows(df, by, length, step), model).filter(F.col("p") >= least)
    gap = hits.select(*by, F.col("start").alias(TIME), "stop", "p")
    w = W.partitionBy(*by).orderBy(TIME)
    open_ = F.when(us(TIME) > us(F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))), 1).otherwise(0)
    runs = gap.withColumn("_open", open_).withColumn("_leg", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy(*by, "_leg").agg(F.min(TIME).alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n"), F.max("p").alias("p_max"))
    return out.select(*by, (F.row_number().over(W.partitionBy(*by).orderBy("start")) - 1).cast("long").alias("seg_idx"), "start", "stop", "n", "p_max")


def generated(seeds: DataFrame, seed: int = 0) -> DataFrame:
    """Made flights, one for each row of ``seeds`` (flight_id long): flight_id, holds, rows every ten seconds for twenty minutes.

    Flights with an even hash (those that ``holds`` in seeds names, if it is
    there) hold from the seventh minute on, in circuits of legs and half turns
    to one side; the others fly straight on, turn once or
    twice, weave or descend.  All have noise in their tracks.  Seeds are dealt
    by flight_id before rows are made of them, so flights needn't move later.
    """
    seeds = seeds.repartition(-(-seeds.count() // FLIGHTS) or 1, "flight_id")
    h = lambda k, n: F.pmod(F.xxhash64("flight_id", F.lit(seed), F.lit(k)), F.lit(n))
    f = seeds.select("flight_id", (F.col("holds") if "holds" in seeds.columns else h(0, 2) == 0).alias("holds"), h(1, 360).alias("head"), F.when(h(2, 2) == 0, 1).otherwise(-1).alias("side"), (3 + h(3, 4)).alias("leg"), h(4, 4).alias("kind"), (180 + h(5, 200)).cast("double").alias("groundspeed"), (h(6, 80) / 10.0).alias("lat0"))
    f = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(119))))
    k = F.col("i") - 42
    cycle = F.pmod(k, 2 * (F.col("leg") + 6))  # a leg and six rows of half a turn, twice
    half = F.col("leg") + 6
    part = F.least(F.greatest(F.pmod(cycle, half) - F.col("leg"), F.lit(0)), F.lit(6)) * 30.0
    circuit = F.floor(k / half) * 180.0 + part
    ramp = lambda a, rows, angle: F.least(F.greatest(F.col("i") - a, F.lit(0)), F.lit(rows)) / rows * angle
    other = F.when(F.col("kind") == 0, 0.0).when(F.col("kind") == 1, ramp(50, 9, 90.0)).when(F.col("kind") == 2, ramp(40, 9, 110.0) - ramp(75, 9, 80.0)).otherwise(25.0 * F.sin(F.col("i") / 6.0))
    turned = F.when(F.col("holds"), F.when(k > 0, circuit).otherwise(0.0)).otherwise(other) * F.col("side")
    noise = F.pmod(F.xxhash64("flight_id", "i", F.lit(seed)), F.lit(200)) / 100.0 - 1.0
    f = f.withColumn("track", F.pmod(F.col("head") + turned + noise, F.lit(360.0)))
    w = W.partitionBy("flight_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    step = F.col("groundspeed") * (10 / 3600.0) / 60
    north, east = F.sum(step * F.cos(F.radians("track"))).over(w), F.sum(step * F.sin(F.radians("track"))).over(w)
    f = f.withColumns({"latitude": 40 + F.col("lat0") + north, "longitude": 3 + east / F.cos(F.radians(40 + F.col("lat0")))})
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") * 10)
    altitude = F.when(F.col("holds") | (F.col("kind") < 2), 12_000.0).otherwise(12_000.0 - 40.0 * F.col("i"))
    return f.select("flight_id", "holds", at.alias(TIME), "latitude", "longitude", altitude.alias("altitude"), "track", "groundspeed")


def trained(spark: SparkSession, seeds: DataFrame, seed: int = 0) -> PipelineModel:
    """fit() on generated flights: windows that lie in the circuits against those of flights that don't hold."""
    found = windows(generated(seeds, seed), ["flight_id", "holds"])
    inside = F.unix_timestamp("start") >= 1_700_000_000 + 420
    labelled = materialize(found.filter(~F.col("holds") | inside).select(*FEATURES, F.col("holds").cast("double").alias("label")))
    model = fit(labelled)
    discard(labelled)
    return model
