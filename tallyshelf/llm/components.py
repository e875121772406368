"""Connected components of a graph given as edges, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node that edges (u, v) reach from it, for every node with an edge.

    Each round hands every node the smallest label next to it, and then that label's own label, so a
    label's way roughly doubles from round to round. Rounds end when no label changes. Labels are written
    to the shared folder after each round, which also cuts the lineage. A node with very many neighbours
    is a hot join key on one side only, which adaptive execution can split.
    """
    once = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    once = keep(once, "edges")
    both = once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        of_v = labels.select(F.col("u").alias("v"), F.col("label").alias("label_v"))
        best = both.join(of_v, "v").groupBy("u").agg(F.min("label_v").alias("near"))
        near = labels.join(best, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        beyond = labels.select(F.col("u").alias("mid"), F.col("label").alias("far"))
        moved = near.join(beyond, "mid", "left").select(
            "u", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"
        )
        moved = keep(moved.select("u", "label", (F.col("label") != F.col("old")).alias("changed")), "labels")
        labels = moved.select("u", "label")
        if moved.where("changed").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
