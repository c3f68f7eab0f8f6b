"""Connected components of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickweir.session import scratch


def _stored(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, tuple]:
    path = scratch(spark, "stars")
    edges.write.parquet(path)
    edges = spark.read.parquet(path)
    mark = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return edges, tuple(mark)


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (u, v); component is the smallest node reachable.

    Each round points all larger neighbours of a node at its smallest neighbour, then all smaller ones, until the
    links form stars around the smallest nodes. Both steps are a partial aggregate and one join, so a node with very
    many links is pre-aggregated and its join partition can be split. Each round is a written table; nothing but the
    count and a checksum of the links comes to the driver.
    """
    edges = (links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    edges, mark = _stored(spark, edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = (both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
                 .where("u <> v").distinct())
        edges, now = _stored(spark, small)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
