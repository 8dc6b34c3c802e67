"""Flight plans: routes as text to tokens, and tokens to points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec, geo
from .joins import small
from .references import sub_route


def tokens(plans: DataFrame, key: str, route: str = "route") -> DataFrame:
    """(key, i, token, kind, name, speed, level, latitude, longitude) of every word of each plan.

    A word with a slash is a point with a change of speed and level; a coded
    word is a departure route at the start (after speed and level, if they come
    first), an arrival route at the end, and an airway in between.
    """
    words = F.filter(F.split(F.trim(route), r"\s+"), lambda x: x != "")
    each = plans.select(key, F.size(words).alias("_n"), F.posexplode(words).alias("i", "token"))
    w = W.partitionBy(key).orderBy("i")
    before = F.lag("token").over(w)
    raw = codec.token_kind("token", before)
    coded = raw.isin("airway", "sid")
    starts = (F.col("i") == 0) | ((F.col("i") == 1) & before.rlike(codec.SPEED_LEVEL))
    kind = F.when(coded & starts, "sid").when(coded & (F.col("i") == F.col("_n") - 1), "star").when(coded, "airway").otherwise(raw)
    name = F.when(F.col("token").contains("/"), F.substring_index("token", "/", 1)).otherwise(F.col("token"))
    rated = F.when(F.col("token").contains("/"), F.substring_index("token", "/", -1)).otherwise(F.col("token"))
    speed, level = codec.speed_level(rated)
    lat, lon = codec.coordinate(name)
    return each.select(key, F.col("i").cast("long").alias("i"), "token", kind.alias("kind"), name.alias("name"), speed.alias("speed"), level.alias("level"), lat.alias("latitude"), lon.alias("longitude"))


def points(toks: DataFrame, key: str, fixes: DataFrame, routes: DataFrame | None = None, all_points: bool = False) -> DataFrame:
    """(key, n, name, latitude, longitude): the points of each plan in order, each name once, at its first place.

    fixes: name, latitude, longitude; of fixes that share a name the one nearest
    to the plan's last point with a single meaning is taken.  routes: route and
    points (array of names); with ``all_points`` an airway adds those between
    the points beside it.  Points that no fix names are left out.
    """
    own = toks.filter(F.col("kind").isin("point", "speed_level_change", "coordinate")).select(key, "i", F.lit(0).cast("long").alias("j"), "name", "latitude", "longitude")
    if all_points and routes is not None:
        w = W.partitionBy(key).orderBy("i")
        beside = toks.withColumns({"_from": F.lag("name").over(w), "_to": F.lead("name").over(w)}).filter("kind = 'airway'")
        r = routes.select(F.col("route").alias("name"), F.col("points").alias("_pts"))
        part = sub_route(F.col("_pts"), F.col("_from"), F.col("_to"))
        between = beside.join(small(r), "name").select(key, "i", F.posexplode(part).alias("j", "name"), "_from", "_to").filter("name <> _from and name <> _to")
        none = F.lit(None).cast("double")
        own = own.unionByName(between.select(key, "i", F.col("j").cast("long").alias("j"), "name", none.alias("latitude"), none.alias("longitude")))
    same = fixes.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("latitude").alias("y"), F.col("longitude").alias("x")))).alias("_at"))  # fixes of one name
    known = own.join(small(same), "name", "left")
    w = W.partitionBy(key).orderBy("i", "j")
    sure = F.when(F.col("latitude").isNotNull(), F.struct(F.col("latitude").alias("y"), F.col("longitude").alias("x"))).when(F.size("_at") == 1, F.col("_at")[0])
    known = known.withColumn("_sure", sure)
    ref = F.coalesce(F.last_value("_sure", True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first_value("_sure", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    known = known.withColumn("_ref", ref)
    far = F.transform("_at", lambda p: F.struct(F.coalesce(geo.distance(p["y"], p["x"], F.col("_ref.y"), F.col("_ref.x")), F.lit(0.0)).alias("d"), p.alias("p")))
    at = F.coalesce("_sure", F.array_min(far)["p"])
    placed = known.withColumn("_p", at).filter(F.col("_p").isNotNull())
    once = placed.withColumn("_k", F.row_number().over(W.partitionBy(key, "name").orderBy("i", "j"))).filter("_k = 1")
    return once.select(key, (F.row_number().over(w) - 1).cast("long").alias("n"), "name", F.col("_p.y").alias("latitude"), F.col("_p.x").alias("longitude"))
