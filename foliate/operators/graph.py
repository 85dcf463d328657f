"""Paths and components of graphs in tables, and groups of similar names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.trigrams import similar_pairs
from .storage import written


def two_hop_paths(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges (id, source_id, target_id) to all paths of two edges from a node that none enters to one that none leaves.

    Parallel edges make a path each. nodes (id), if given, are the nodes that may begin a path.
    """
    entered = edges.select(F.col("target_id").alias("start_node_id")).distinct()
    left = edges.select(F.col("source_id").alias("end_node_id")).distinct()
    first = edges.select(F.col("source_id").alias("start_node_id"), F.col("id").alias("first_edge_id"), F.col("target_id").alias("middle_node_id"))
    if nodes is not None:
        first = first.join(nodes.select(F.col("id").alias("start_node_id")).distinct(), "start_node_id", "left_semi")
    first = first.join(entered, "start_node_id", "left_anti")
    second = edges.select(F.col("source_id").alias("middle_node_id"), F.col("id").alias("second_edge_id"), F.col("target_id").alias("end_node_id")).join(left, "end_node_id", "left_anti")
    return first.join(second, "middle_node_id").select("start_node_id", "first_edge_id", "middle_node_id", "second_edge_id", "end_node_id")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, group_id): the smallest node that can be reached. Labels shrink along edges and then jump, until none changes."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "graph-edges")
    labels = written(nodes.select("node", F.col("node").alias("group_id")), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group_id").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.least("group_id", F.coalesce("near", "group_id")).alias("group_id"), F.col("group_id").alias("before"))
        up = lower.select(F.col("node").alias("n"), F.col("group_id").alias("jump"))
        new = written(lower.join(up, F.col("group_id") == F.col("n")).select("node", F.least("group_id", "jump").alias("group_id"), "before"), "graph-labels")
        labels = new.select("node", "group_id")
        if new.where("group_id <> before").isEmpty():
            return labels


def similar_name_groups(items: DataFrame, name: str, amount: str, threshold: float) -> DataFrame:
    """(names, total_amount, n) of groups of similar names, over names whose amounts sum to more than 0.

    Names are similar at or above the threshold in lower case; a group is a component of that relation. Sums are exact if
    amounts are decimals; null amounts don't count, and a name with no other is left out.
    """
    sums = items.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.sum(amount).alias("total"), F.count("*").alias("n")).where("total > 0")
    sums = written(sums, "name-sums")  # a row a name
    pairs = similar_pairs(sums, "name", "name", threshold)
    groups = connected_components(pairs, sums.select(F.col("name").alias("node")))
    joined = sums.join(groups, F.col("name") == F.col("node"))
    return joined.groupBy("group_id").agg(F.sort_array(F.collect_list("name")).alias("names"), F.sum("total").alias("total_amount"), F.sum("n").alias("n")).drop("group_id")
