"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import tasks_for
from tidemark.session import settle


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Hang the larger (or smaller) neighbours of every node on its least neighbour."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = near.filter(F.col("v") > F.col("u")) if large else near.filter(F.col("v") < F.col("u"))
    joined = near.join(least, "u")
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        hung = hung.union(least.select("u", F.col("m").alias("v")))
    return hung.filter(F.col("u") != F.col("v")).distinct().coalesce(tasks)


def components(edges: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """One row per node that has an edge: the smallest node it reaches.

    ``edges`` has two long columns, ``u`` and ``v``; loops, repeats and either direction
    are fine, null ends are left out.  Rounds run until the edge set repeats; every round
    is written to the checkpoint folder, so a lost executor costs a re-read.  Only a count
    and a checksum of a round come to the driver.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
    current = settle(edges.filter(F.col("u") != F.col("v")).distinct())
    last = None
    while True:
        mark = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.hash("u", "v"))
        ).first()
        if mark[0] == 0 or tuple(mark) == last:
            break
        last = tuple(mark)
        # A round has no more edges than about the one before, so few edges are few tasks.
        tasks = tasks_for(mark[0])
        current = settle(_star(_star(current.coalesce(tasks), True, tasks), False, tasks))
    return (
        current.select(F.col("u").alias(node), F.col("v").alias(component))
        .union(current.select(F.col("v"), F.col("v")).distinct())
    )
