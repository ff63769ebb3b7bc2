"""Distributed connected components by alternating large-star and small-star steps.

Every step joins the edges with the smallest neighbour of each vertex. That
minimum is pre-aggregated in each task and the join is an ordinary one that
Spark may split, so a vertex with very many neighbours is no group in one task.
The edges are written to the shared folder after each round; nothing but two
sums comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step; ``edges`` are (u, v) with u > v, distinct."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:  # larger neighbours go to the smallest one
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours and the vertex itself
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) for every vertex that occurs in a pair of different ids.

    component_id is the smallest id that can be reached. Pairs with a null on
    either side, loops and repeated pairs change nothing; an empty table gives an
    empty one.
    """
    edges = stored(
        pairs.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    )
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        last, edges = edges, stored(_star(_star(edges, True), False))
        drop_stored(last)
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots.withColumn("component_id", F.col("id")))
