"""Connected components over an edge table, by alternating star contractions.

Each round hangs every node's larger neighbours on its smallest one (large
star) and its smaller neighbours on the smallest of them (small star); after
O(log n) rounds the edges are stars around the smallest node.  Edges never
leave Spark; a round ends in a written table, so a lost executor costs a round
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendermill.llm.common import materialise, new_path, remove


#: Neighbours of a hub at least, and hubs at most: their table is broadcast.
HUB, HUBS = 100_000, 100_000


def _with_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``edges`` with the ``m`` of ``u``, from ``least(u, m, n)``.

    Nodes with very many edges meet theirs by broadcast where these lie; as the
    edges are counted at the start of a round, and a star has no more than it was
    made of, there are no more such nodes than ``HUBS``.  Fewer edges than one hub
    has meet by a plain join.
    """
    if 2 * n_edges <= HUB:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("n") > max(HUB, 2 * n_edges // HUBS)).select("u", "m"))
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(others)


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    out = _with_least(both, least, n_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hung = _with_least(edges, least, n_edges).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(u, v)``; component is the smallest node."""
    flat = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    now = materialise(flat, "edges", path)
    seen = _digest(now)
    while seen[0]:
        done, path = path, new_path(spark, "edges")
        now = materialise(_small_star(_large_star(now, seen[0]), seen[0]), "edges", path)
        remove(done)
        if (again := _digest(now)) == seen:
            break
        seen = again
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
