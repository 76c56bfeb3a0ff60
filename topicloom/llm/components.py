"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import cut

_ROUNDS = 64


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    lower = links.join(least, "u").where(F.col("v") != F.col("m"))
    return lower.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every linked node but the roots; a root is its component's least number.

    Large and small stars in turn, each round one written table, until nothing
    changes: a number of rounds that grows with the logarithm of the size. Only
    minima are taken of a node's links, so a node may have any number of them.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = cut(links.where(F.col(a) != F.col(b)).select(u, v).distinct())
    mark = None
    for _ in range(_ROUNDS):
        total = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not total[0] or tuple(total) == mark:
            break
        mark = tuple(total)
        now = cut(_small_star(_large_star(now).distinct()).distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
