"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.storage import written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list of two long columns; root is the component's smallest node.

    Alternating large-star and small-star rounds: rows never exceed the edges by more than a constant
    factor, rounds grow with the logarithm of the largest component, and each round's edges are written to
    the shared folder. A centre with very many neighbours is joined against one row, its minimum; the minima
    are written first, so that both sides of the join are plain shuffles, of which Spark splits a skewed
    partition. Self-loops and repeated edges change nothing; an empty list gives no rows.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    e, seen = written(e), None
    for _ in range(MAX_ROUNDS):
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = written(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large)
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")))
        linked = large.join(least.hint("merge"), "hi")
        small = linked.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = written(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
