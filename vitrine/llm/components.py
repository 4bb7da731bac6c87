"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest node it knows."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """No node hangs on two others, or on one while another hangs on it."""
    ends = edges.selectExpr("a node", "1 hangs", "0 holds").unionAll(edges.selectExpr("b node", "0 hangs", "1 holds"))
    counted = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return counted.where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """`node` and `label` (the smallest node reachable) of every node of `edges` (`a`, `b`, of any orderable type).

    Both steps aggregate neighbours to a minimum before they join it back, so a node with very many neighbours is
    combined map-side. Each round is written to the shared folder. Loops and repeated edges do no harm; a node whose
    only edge is a loop is not listed; no edges give no rows.
    """
    edges = materialise(_small_star(edges.select("a", "b").where("a <> b")), "stars")
    while not _all_stars(edges):
        edges = materialise(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
