"""Connected components of an edge table by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, root): the smallest node that links reach, for every node with a link.

    Self links and nulls are ignored; an empty table gives an empty table. A round rewrites the edge table twice
    (large star, small star) and checkpoints it, so neither the driver nor a task sees a component whole; minima are
    combined before the shuffle, and the joins on hub nodes are plain sort-merge joins that AQE may split. Rounds end
    when the table stays the same, which takes about the logarithm of the longest path.
    """
    u, v = (F.col(c).cast("long") for c in edges.columns[:2])
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now, seen = checkpointed(now), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        now = checkpointed(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
