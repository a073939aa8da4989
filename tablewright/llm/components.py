"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import drop_written, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of its neighbourhood to its larger neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of its smaller neighbours to the others and to itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them; equal marks mean equal tables."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the smallest node it can reach.

    Repeated and reversed edges change nothing; a loop u = v is left out; no edges give no
    rows. Every round is written to the shared folder, and only its size and a checksum come
    to the driver. The number of rounds grows with the logarithm of the longest chain.
    """
    now = written(edges.select("u", "v").filter("u != v"), "edges")
    mark = None
    while True:
        then = written(_small_star(_large_star(now)), "edges")
        drop_written(now)
        now, before, mark = then, mark, _mark(then)
        if mark == before or not mark[0]:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
