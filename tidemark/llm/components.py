"""Connected components by repeated hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of the edges (a, b): root is the same within a component. No row for a node without an edge to another.

    Each round, every node hooks to its smallest neighbour if that is smaller, and what it hooks to is followed to the end by doubling. Only nodes without a
    smaller neighbour are left, at most half of them; so both kinds of rounds are as many as the logarithm of the nodes. Edges and labels are shuffled by
    key; nothing is collected.
    """

    def unequal(e: DataFrame) -> DataFrame:
        return durable(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    e, labels = unequal(edges.select("a", "b")), None
    while not e.isEmpty():
        hook = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a")).groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        hook = durable(hook, "hooks")
        moved = True
        while moved:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            hook = durable(hook.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "hooks")
            moved = not hook.where("moved").isEmpty()
            hook = hook.select("u", "p")
        if labels is None:
            labels = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = durable(labels.join(hook, F.col("root") == F.col("u"), "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        a, b = hook.select(F.col("u").alias("a"), F.col("p").alias("pa")), hook.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        e = unequal(e.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
