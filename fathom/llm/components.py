"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import scratch


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): for each node of edges (a, b) the smallest node that it reaches. Null ends are ignored."""
    return components_table(edges, max_rounds)[0]


def components_table(edges: DataFrame, max_rounds: int = 64) -> tuple[DataFrame, str]:
    """components() and the scratch table that it is read from.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones, until all edges point
    at roots. A node's neighbours are only aggregated, never gathered, so a large component or hub stays distributed.
    Rounds are cut by written tables; their number grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    now, at = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionAll(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a go to the least of a and its neighbours
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its smaller neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new, new_at = scratch.keep(small)
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(spark, at)
        now, at = new, new_at
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")), at
