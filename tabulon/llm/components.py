"""Connected components of a graph whose edges are rows, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _distinct(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u")
    return _distinct(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u and v, 64-bit integers); root is the least node reachable.

    Each step shuffles rows of two integers and is checkpointed; a node of many edges is split by Spark's skew join,
    and minima are taken before the shuffle. The steps needed grow with the logarithm of the longest chain. Ends when a step changes nothing.
    """
    stars = cut(_distinct(edges.select("u", "v")))
    before = None
    for _ in range(most_steps):
        stars = cut(_small_star(_large_star(stars)))
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # settled edges point from every node to its root
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
