"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import written

#: Rounds after which something is wrong: each round at least halves depths.
MOST_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least of it and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and no parent has one."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    found = roles.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not found.filter("up > 1 or (up > 0 and least = 0)").count()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that joins two nodes; ``root`` is
    the least node that it can reach.  Edges may repeat and may be self-loops.

    Each round writes its edges to the shared folder, and only a number comes to
    the driver; it ends when every node points straight at its root.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = written(now, "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            break
        now = written(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
