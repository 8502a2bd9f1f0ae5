"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Tables


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, label): for every node of the edges (a, b), the smallest node it is connected with.

    Each round maps every node to its smallest neighbour's smallest neighbour and the edges to the images of their
    ends. A map of that kind keeps components and their smallest nodes, and stars, of which the edges here consist,
    shrink to a point in a round or two; it ends when no edge is left. All state is in shared tables.
    """
    tables = tables or Tables(edges.sparkSession)
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left, labels = tables.written(left, "edges"), None
    while labels is None or left.limit(1).count():
        both = left.union(left.select("b", "a"))
        up = tables.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "up")
        jumped = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("to")), "up").select("node", "to")
        jumped = tables.written(jumped, "jumped")
        if labels is None:
            labels = jumped.withColumnRenamed("to", "label")
            labels = tables.written(labels, "labels")
        else:
            moved = labels.join(jumped.withColumnRenamed("node", "label"), "label", "left")
            last, labels = labels, tables.written(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
            tables.drop(last)
        ends = left.join(jumped.withColumnRenamed("node", "a").withColumnRenamed("to", "x"), "a")
        ends = ends.join(jumped.withColumnRenamed("node", "b").withColumnRenamed("to", "y"), "b")
        last, left = left, tables.written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
        tables.drop(last, up, jumped)
    return labels
