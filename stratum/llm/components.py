"""Connected components of links, by alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, shared_path, written

#: Parts that the neighbours of a node are dealt to where they are joined with its minimum.
SALTS = 16


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with the minimum m of u: a hub's edges are dealt to SALTS parts, and its minimum goes to each."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.withColumn("part", parts), ["u", "part"]).drop("part")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node of its component.

    Each round, every node passes its larger neighbours (large star) and then its smaller ones (small star) to its
    least neighbour; a number of rounds that grows with the logarithm of the component's size ends in stars. Minima
    are aggregated before they move; each round's edges are written, and those of the round before are deleted.
    """
    spark = edges.sparkSession
    path = shared_path(spark, "links")
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Only nodes with a larger neighbour pass any on.
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).where("most > u")
        least = least.select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        several = least.where("m < most").select("u", "m")  # others have nothing to pass on
        small = _with_least(large, several).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, path = path, shared_path(spark, "links")
        edges = written(small, path)
        delete_path(spark, old)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
