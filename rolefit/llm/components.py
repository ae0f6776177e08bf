"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every node that has an edge to another one; the root is the smallest node of its component, and its own.

    Each round hangs the neighbours of a node on its smallest neighbour; edges stay at most as many as they were, and a number of
    rounds logarithmic in the diameter ends in stars. Minima are combined before each shuffle, and the joins with them can be split where
    a node is in very many edges.
    """
    now = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (found.n, found.s):
            break
        state = (found.n, found.s)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.union(least).where("u <> v").distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
