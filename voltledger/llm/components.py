"""Connected components of an edge table, by rounds of hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.llm.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of edges (x, y) the smallest node it can reach.

    Each round contracts the graph: a node hooks to its smallest neighbour if that is smaller, hooks are shortened to
    their roots, and edges inside one root go. At least half of the nodes that still have edges stop being roots.
    """
    edges = saved(edges.select("x", "y").where("x <> y").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        hooks = saved(both.groupBy(F.col("x").alias("node")).agg(F.least("node", F.min("y")).alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = saved(hooks.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        x = hooks.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        y = hooks.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        edges = saved(edges.join(x, "x").join(y, "y").where("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct())
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            labels = saved(labels.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
    return labels if labels is not None else edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
