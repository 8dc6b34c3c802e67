"""Connected components of an edge list, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root: the smallest node reached.

    Each round sends labels over the edges and then follows each label's own
    label, so chains shorten by powers of two.  Labels live in the shared
    folder between rounds, and a round's table is deleted when the next one is
    whole; nothing but the number of changes reaches the driver.
    """
    both = edges.filter("u <> v").select("u", "v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both, "cc-edges")
    every = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    near = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    labels = materialize(every.join(near, "node", "left").select("node", F.least("node", "m").alias("root")), "cc")
    for _ in range(most_rounds):
        of = labels.select(F.col("node").alias("v"), "root")
        best = both.join(of, "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        spread = labels.join(best, "node", "left").select("node", F.least("root", "m").alias("new"), F.col("root").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        last, labels = labels, materialize(spread.join(jump, "new", "left").select("node", F.least("new", "far").alias("root"), "old"), "cc")
        discard(last)
        if labels.filter("root <> old").limit(1).count() == 0:
            discard(both)
            return labels.select("node", "root")
        labels = labels.select("node", "root")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
