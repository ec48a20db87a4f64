"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_join, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (a, b) with a > b; each node points its larger (or smaller-or-equal) neighbours to its least one."""
    near = edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
    if large:
        near = near.union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    least = near.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("least"))
    seen = fresh_join(near, least, ["node"], "inner")
    if large:
        out = seen.where(F.col("to") > F.col("node")).select(F.col("to").alias("a"), F.col("least").alias("b"))
    else:
        out = seen.select(F.col("to").alias("a"), F.col("least").alias("b")).union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b): root is the least node it is connected to. Links to oneself and nulls are ignored."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = materialize(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "links")
    mark = F.bit_xor(F.xxhash64("a", "b")).alias("mark")
    last = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), mark).first()
        if now == last:
            break
        last = now
        edges = materialize(_star(_star(edges, True), False), "stars")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
