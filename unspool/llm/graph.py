"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unspool.llm.common import delete, materialize, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (a, b): label is the smallest node that can be reached.

    In each round every node hooks to its smallest neighbour if that is smaller, chains are halved,
    and edges are drawn between what is left of their ends until none is left. Hooks go to smaller
    nodes only, so a label is a component's smallest node. Neighbours are reduced before they are
    shuffled; a node with very many of them is split by the skew join.
    """
    spark, before = edges.sparkSession, len(written(edges.sparkSession))
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ends = materialize(ends, "edges")
    labels = None
    while not ends.isEmpty():
        both = ends.select(F.col("a").alias("node"), F.col("b").alias("other")).union(ends.select(F.col("b"), F.col("a")))
        hooks = materialize(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up")), "hooks")
        far = hooks.alias("h").join(hooks.select(F.col("node").alias("up"), F.col("up").alias("top")), "up")
        hooks = materialize(far.select("node", F.col("top").alias("up")), "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("label"))
        else:
            moved = labels.join(hooks.select(F.col("node").alias("label"), "up"), "label", "left")
            labels = moved.select("node", F.coalesce("up", "label").alias("label"))
        labels = materialize(labels, "labels")
        new = ends.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(hooks.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        new = new.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        ends = materialize(new, "edges")
        # The last two tables, labels and edges, are whole by themselves: those before them go.
        delete(spark, written(spark)[before:-2])
    return labels if labels is not None else ends.select(F.col("a").alias("node"), F.col("b").alias("label"))
