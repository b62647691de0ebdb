"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.cut import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b of type long); root is the smallest node that it reaches.

    Alternates large-star and small-star steps: every step hangs neighbours on the smallest node seen, so
    the number of rounds grows with the logarithm of the longest path.  Each round is cut in the checkpoint
    folder.  Nodes without an edge, and loops, aren't returned unless a loop is the only edge of its node.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    tree, done = pairs.where("a > b"), False
    while not done:
        both = tree.union(tree.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        tree = cut(small.select("a", F.col("m").alias("b")).union(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        # Done when all are stars: nobody has two parents, and no parent has one.
        ends = tree.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(tree.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        done = ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()
    roots = tree.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = tree.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return roots.union(tops).union(loops).groupBy("node").agg(F.min("root").alias("root"))
