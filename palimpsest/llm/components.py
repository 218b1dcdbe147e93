"""Connected components over link tables, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_written, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a, b), root being the component's smallest node; drop_written() deletes its table.

    Links may repeat, run either way or lead to themselves; nulls are dropped. Every round is two
    grouped minima and two joins on the same key, written to the shared folder: nothing of the
    links comes to the driver but their count and a checksum.
    """
    edges = written(_ordered(links), "links")
    mark = None
    for _ in range(most_rounds):
        after = written(_small_star(_large_star(edges)), "links")
        drop_written(edges)
        edges = after
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    rooted = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    rooted._palimpsest_path = edges._palimpsest_path
    return rooted


def _ordered(links: DataFrame) -> DataFrame:
    pair = links.where("a <> b")
    return pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
