"""Connected components of a graph that no single machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any ordered type to (node, label), label being the same for all nodes of a component.

    In every round each node takes the smaller of itself and its smallest neighbour as its new name, and edges are renamed;
    what they say about names is the same, and the graph shrinks. Rounds are written to the shared folder. Loops and repeated
    edges do no harm, nodes without an edge are not returned, and no edges give no rows.
    """
    edges = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    names: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")), "names")
        if names is None:
            names = up.select("node", F.col("up").alias("label"))
        else:
            next_ = up.select(F.col("node").alias("n"), "up")
            names = stash(names.join(next_, F.col("label") == F.col("n"), "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        left = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        renamed = edges.join(left, "a").select("b", "x").join(right, "b").where("x <> y")
        edges = stash(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return names if names is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
