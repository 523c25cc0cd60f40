"""Connected components of an edge table by contraction and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any orderable type -> (node, label), label being the least node of its component.

    A round lets every node point at its least neighbour (or itself), shortens the pointers until they
    reach their roots, and renames the edges' ends by them; only edges between roots remain.  Every node
    that has an edge appears once; loops and repeated edges do no harm.
    """
    edges = materialize(edges.filter("a <> b").distinct(), "cc-edges")
    labels, used = None, []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = materialize(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("up")), "cc-up")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = materialize(up.join(above, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "cc-jump")
            release(up)
            up = jumped.drop("moved")
            up._written_at = jumped._written_at
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels, used = up.select("node", F.col("up").alias("label")), [up]
        else:
            renamed = up.select(F.col("node").alias("label"), "up")
            labels = materialize(labels.join(renamed, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "cc-labels")
            release(*used)
            used = [labels]
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        before, edges = edges, materialize(ends.filter("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(), "cc-edges")
        release(before)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
