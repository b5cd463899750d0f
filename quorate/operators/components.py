"""Connected components by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an undirected graph; root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour (a map-side combined minimum, so
    a hub's edges never meet in one task), shortens the pointers by jumping, and rewrites
    the edges to the pointers' ends; edges inside a tree vanish, so the rounds work on a
    graph that shrinks fast. Tables between rounds are written to the shared folder.
    Edges with a null end and self-loops link nothing; an empty graph gives no rows.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    labels = None
    left, n = materialize(pairs.distinct(), "edges", rows=True)
    if not n:
        return left.select(F.col("a").alias("node"), F.col("a").alias("root"))
    while n:
        both = left.union(left.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
        hook = materialize(hook, "hooks")
        for _ in range(2):
            to = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            hook = hook.join(to, "root").select("node", F.col("next").alias("root"))
        hook = materialize(hook, "hooks")
        if labels is None:
            labels = hook
        else:
            to = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        ends = left.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
            hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b"
        )
        ends = ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        left, n = materialize(ends.distinct(), "edges", rows=True)
    return labels
