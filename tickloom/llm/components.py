"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point down (u > v): a node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node reachable) of every node of the edges (u, v).

    A round costs four shuffles of the edges; chains halve in each, so rounds grow as the
    logarithm of the longest one. Each round is written to the shared folder. Loops and repeated
    edges are dropped; an empty table gives an empty result.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, mark = stored(now, "edges"), None
    for _ in range(most_rounds):
        now = stored(_small_star(_large_star(now)), "edges")
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (r["n"], r["h"]) == mark:
            break
        mark = (r["n"], r["h"])
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
