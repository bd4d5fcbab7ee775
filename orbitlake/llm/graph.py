"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitlake.llm import shared


#: Edges that one task of a round reads at least, where there are as many.
EDGES = 100_000


def _mins(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the smaller of u and its least v."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def _round(edges: DataFrame, tasks: int) -> DataFrame:
    """Every edge has v < u.  First the larger neighbours of each node are tied to its least one,
    then the smaller ones; fewer edges than tasks' worth are read by fewer tasks."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (_mins(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .coalesce(tasks).distinct().coalesce(tasks))
    near = _mins(large)
    return (near.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(near.select("u", F.col("m").alias("v"))).where("u != v")
            .coalesce(tasks).distinct())


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                 .first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) for every node but the least of each component; v is that least node.

    `links` has columns u and v of any type that has an order; loops and repeats are harmless, no
    link at all gives no row.  Each round is a few equal joins of edges with their nodes' minima;
    the edges never leave the executors, only their count and a checksum are looked at.
    """
    most = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = shared.settle(links.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while (now := _print(edges)) != last:
        last = now
        tasks = min(most, max(8, now[0] // EDGES))
        edges = shared.settle(_round(edges.coalesce(tasks), tasks).coalesce(tasks))
    return edges
