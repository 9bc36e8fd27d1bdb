"""Connected components of an edge table, by alternating large and small stars (Kiveris et al. 2014).

Each round hangs nodes onto the smallest neighbour they know; a logarithmic number of rounds leaves one star per
component. Rounds end in a written table, so lineage stays short and a lost executor costs at most a round. Only two
sums per round come to the driver. A node with very many edges is a maximum that Spark combines before the shuffle,
and is dealt to SALTS parts where its edges meet that maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Parts that a node's edges are dealt to where they meet its least neighbour, so that a hub isn't one task's work.
SALTS = 8


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with ``least`` of each ``u``."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt")
    each = least.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return edges.select("*", salt).join(each, ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    return _met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = _met(down, least).where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) of each node of ``edges`` (``u, v``; order and repeats don't matter).

    Defined cases: an edge of a node with itself, or with a null, counts for nothing; nodes without an edge aren't told;
    an empty table gives an empty result.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == before or not told[0]:
            break
        before = told
        now = written(_small_star(_large_star(now)))
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select("v", "v").distinct())
