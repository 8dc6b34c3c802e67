"""Ground networks: nodes and edges from polylines, merging, components, nearest edges, paths of flights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from . import grouped
from .joins import small
from .ml import neighbours
from .scratch import materialize

#: Nodes and edges of a graph that paths are searched in: each task holds it.
GRAPH_ROWS = 100_000


def from_ways(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, x, y; edges: u, v, way, length) of polylines: way, points (array of struct x, y, in metres).

    Equal corners of different ways are one node, numbered by a hash of its place.
    """
    corner = F.posexplode(F.transform("points", lambda p, i: F.struct(p.alias("p"), F.get("points", i + 1).alias("q")))).alias("i", "_s")
    at = ways.select("way", corner)
    number = lambda p: F.xxhash64(f"_s.{p}.x", f"_s.{p}.y")
    nodes = at.select(number("p").alias("node"), F.col("_s.p.x").alias("x"), F.col("_s.p.y").alias("y")).distinct()
    steps = at.filter("_s.q is not null")
    edges = steps.select(number("p").alias("u"), number("q").alias("v"), "way", F.hypot(F.col("_s.p.x") - F.col("_s.q.x"), F.col("_s.p.y") - F.col("_s.q.y")).alias("length"))
    return nodes, edges


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reached; labels spread by shuffles until none changes."""
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    label = materialize(nodes.select("node", F.col("node").alias("component")))
    changed = 1
    while changed:
        heard = both.join(label.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("c"))
        near = label.join(heard, "node", "left").select("node", F.least("component", "c").alias("c"), F.col("component").alias("old"))
        far = label.select(F.col("node").alias("c"), F.col("component").alias("far"))
        new = materialize(near.join(far, "c").select("node", F.least("c", "far").alias("component"), "old"))
        changed = new.filter("component <> old").limit(1).count()
        label = new.drop("old")
    return label


def largest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of the component with the most nodes (ties: the smallest number)."""
    c = components(nodes, edges)
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    kept = c.join(F.broadcast(top), "component").select("node")
    return nodes.join(kept, "node"), edges.join(kept.withColumnRenamed("node", "u"), "u", "left_semi")


def merge_nodes(nodes: DataFrame, edges: DataFrame, tolerance: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``tolerance`` metres, directly or over others, become one, at the place of the smallest; edges follow and loops go."""
    near = neighbours(nodes.select("node", F.array("x", "y").alias("features")), tolerance, "node")
    to = components(nodes, near.withColumnsRenamed({"a": "u", "b": "v"}))
    kept = nodes.join(to.filter("node = component").select("node"), "node")
    end = lambda c: to.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    moved = edges.join(end("u"), "u").join(end("v"), "v").filter("_u <> _v").drop("u", "v").withColumnsRenamed({"_u": "u", "_v": "v"})
    return kept, moved.select(*edges.columns)


def nearest_edge(df: DataFrame, ways: DataFrame, max_dist: float = 85.0, x: str = "x", y: str = "y") -> DataFrame:
    """Adds way and way_distance: the straight piece of a polyline nearest to the row, within ``max_dist`` metres, else null.

    ways: way, points (array of struct x, y).  Rows and pieces meet by cells of
    twice the distance; one array of pieces per cell, so rows are not repeated.
    """
    size = 2.0 * max_dist
    piece = F.explode(F.filter(F.transform("points", lambda p, i: F.struct(p.alias("p"), F.get("points", i + 1).alias("q"))), lambda s: s["q"].isNotNull())).alias("_s")
    at = ways.select("way", piece)
    low = lambda k: F.least(F.col(f"_s.p.{k}"), F.col(f"_s.q.{k}")) - max_dist
    high = lambda k: F.greatest(F.col(f"_s.p.{k}"), F.col(f"_s.q.{k}")) + max_dist
    lists = at.select("way", "_s", F.explode(cells.box_cells(low("x"), low("y"), high("x"), high("y"), size)).alias("_cell")).groupBy("_cell").agg(F.array_sort(F.collect_list(F.struct("way", "_s"))).alias("_pieces"))

    def away(e):
        dx, dy = e["_s"]["q"]["x"] - e["_s"]["p"]["x"], e["_s"]["q"]["y"] - e["_s"]["p"]["y"]
        len2 = dx * dx + dy * dy
        px, py = F.col(x) - e["_s"]["p"]["x"], F.col(y) - e["_s"]["p"]["y"]
        t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / len2))).otherwise(F.lit(0.0))
        return F.struct(F.hypot(px - t * dx, py - t * dy).alias("d"), e["way"].alias("way"))

    j = df.withColumn("_cell", cells.plane_cell(y, x, size)).join(small(lists), "_cell", "left")
    j = j.withColumn("_best", F.array_min(F.transform("_pieces", away)))
    ok = F.col("_best.d") <= max_dist
    return j.withColumns({"way": F.when(ok, F.col("_best.way")), "way_distance": F.when(ok, F.col("_best.d"))}).drop("_cell", "_pieces", "_best")


def map_match(df: DataFrame, by: list[str], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (n, node) of the shortest path of each flight from its first to its last position over a small graph.

    nodes: node, latitude, longitude; edges: u, v, w.  Each task holds the graph,
    so it must have GRAPH_ROWS rows at most.  Only the ends of flights move.
    """
    if max(nodes.limit(GRAPH_ROWS + 1).count(), edges.limit(GRAPH_ROWS + 1).count()) > GRAPH_ROWS:
        raise ValueError(f"more than {GRAPH_ROWS} nodes or edges")
    places = {r[0]: (r[1], r[2]) for r in nodes.select("node", "latitude", "longitude").collect()}
    links = [tuple(r) for r in edges.select("u", "v", "w").orderBy("u", "v").collect()]
    tie = [c for c in ("event_id",) if c in df.columns]
    end = lambda f: f(F.struct("latitude", "longitude"), F.struct("timestamp", *tie))
    ends = df.groupBy(*by).agg(end(F.min_by).alias("_a"), end(F.max_by).alias("_b"))
    ends = ends.select(*by, *[F.col(f"_{e}.{c}").cast("double").alias(f"{n}{k}") for k, e in enumerate("ab") for n, c in (("lat", "latitude"), ("lon", "longitude"))])
    return grouped.map_match(ends, by, places, links)
