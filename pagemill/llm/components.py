"""Connected components of a link table by alternating large-star and small-star steps, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.session import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    kept = edges.join(least, "src").where("dst > least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return kept.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (src, dst), where component is the smallest node reachable.

    Each round is written to the shared folder; the rounds end when one changes no edge. Nodes without links are not in
    the result. Self links and repeated links are harmless.
    """
    spark = links.sparkSession
    oriented = links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges = materialise(oriented, "links")
    seen = None
    while True:
        sign = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen or sign[0] == 0:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        seen = tuple(sign)
        last, edges = edges, materialise(_small_star(_large_star(edges)), "links")
        discard(spark, last)
