"""Connected components of an edge table by alternating large and small stars.

Every round rewrites the edges with one aggregate and one join on the node;
no node's neighbours are ever gathered, so a centre with millions of edges
costs partial minima and a join that adaptive execution can split. The rounds
end when the edges no longer change (a logarithmic number of them), each cut
by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import cut


def _with_minimum(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_minimum(down)
    others = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(joined.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """node, root (the smallest node it reaches) for every node with an edge
    to another node. Loops, repeated edges and nulls are left out first."""
    current = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return (current.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
        seen = state
        current = cut(_small_star(_large_star(current)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
