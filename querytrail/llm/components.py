"""Connected components by repeated contraction, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an undirected graph; nodes of one component share a root.

    Each round every node moves to its neighbour (or itself) of the lowest random rank,
    the ranks being drawn anew per round, and the edges follow. A node's neighbours are
    pre-aggregated before the shuffle, a hub's edges collapse in the first round, and the
    rounds grow with the logarithm of the graph. Edges and labels are written to the shared
    folder in every round, so a lost executor costs at most one round.

    Rows with a NULL end are ignored, loops give a component of one, repeated edges count
    once, and no edges give no rows. The root is one of the nodes, not necessarily the least.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stored(pairs.union(pairs.select("b", "a")).distinct())
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    live = both.where("a <> b")
    turn = 0
    while not live.isEmpty():
        turn += 1

        def ranked(name: str):
            return F.struct(F.xxhash64(F.lit(turn), F.col(name)).alias("rank"),
                            F.col(name).alias("id"))

        moves = stored(live.groupBy("a").agg(F.min(ranked("b")).alias("best")).select(
            "a", F.least(ranked("a"), F.col("best"))["id"].alias("to")))
        from_a = moves.select(F.col("a").alias("a"), F.col("to").alias("to_a"))
        from_b = moves.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        live = stored(live.join(from_a, "a").join(from_b, "b")
                      .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
                      .where("a <> b").distinct())
        step = moves.select(F.col("a").alias("root"), "to")
        labels = stored(labels.join(step, "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")))
    return labels
