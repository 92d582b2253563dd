"""Connected components by alternating stars; edges stay distributed and each round is kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import parts, settle

#: Tables of at most this many rows (16 bytes each) are broadcast.
MOST_BROADCAST = 500_000


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node of its component), for every node of an edge between different nodes.

    edges may hold repeated rows and both directions; self-links and rows with a null end are left out.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    now = settle(now.distinct())
    mark = _mark(now)
    while True:
        # The number of edges never grows: it bounds every table of a round.
        few, small_enough = parts(mark[0]), mark[0] <= MOST_BROADCAST
        side = F.broadcast if small_enough else lambda df: df
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        # Large star: the greater neighbours go to the least of the neighbourhood.
        large = both.filter(F.col("v") > F.col("u")).join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(few)
        # Small star: a node and its lesser neighbours go to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few)
        joined = large.join(side(least), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        now = settle(small.distinct())
        new = _mark(now)
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component")).coalesce(parts(mark[0]))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
