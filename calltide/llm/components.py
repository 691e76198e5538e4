"""Connected components of edge lists that no machine holds, by alternating large-star and small-star rounds.

Each round is two aggregations over the edges, combined on the map side, and two joins with their results, which AQE splits
where a node has many edges: no task needs all edges of a node. Edges are written to the shared folder every round, so
lineage stays short and a lost executor costs one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import drop_table, materialize

MOST_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: every neighbour of a node (large: the larger ones; small: the smaller ones) gets the least of them."""
    both = edges.select("a", "b") if small else edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # small: a > b, so a's group holds its smaller neighbours only
    least = both.join(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "a")
    if small:
        out = least.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*")
    else:
        out = least.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: any two longs); a component is named by its least node.

    Nulls and loops are left out; repeated edges count once. Without edges the result is empty.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialize(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        then = materialize(_star(_star(now, small=False), small=True))
        # a fixed point is a set of stars; equal count and checksum of two rounds' edge sets tell it
        row = then.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        drop_table(now)
        now, before, mark = then, mark, tuple(row)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
