"""Connected components of a graph in DataFrames, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexengine.llm.common import join_hot, stored


def _relabel(rows: DataFrame, key: str, parents: DataFrame, many: str, total: int) -> DataFrame:
    """rows with the column key replaced by its parent, whatever share of the rows a key has."""
    known = parents.select(F.col("node").alias(key), "parent", F.col(many).alias("_size"))
    return join_hot(rows, known, key, "_size", total).drop(key, "_size").withColumnRenamed("parent", key)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); component is the smallest node that is reachable.

    In each round every node hooks to its smallest neighbour if that is smaller, and links are carried over to the
    parents; nodes that hooked are gone from the graph. Rounds grow with the logarithm of the graph if names are
    in no order along its paths, as hashes are; on a chain whose names rise they grow with its length. Loops and repeated links do
    no harm. Nodes with very many links are joined apart (see join_hot). No links give no rows.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    rounds = []
    while count := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("parent"), F.count(F.lit(1)).alias("degree"))
        parents = stored(parents)
        rounds.append(parents)
        moved = _relabel(_relabel(edges, "a", parents, "degree", count), "b", parents, "degree", count)
        edges = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    found = None
    for parents in reversed(rounds):
        own = parents.select("node", F.col("parent").alias("component"))
        if found is None:
            found = own
            continue
        children = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        sized = found.join(children, found.node == children.parent).select("node", F.col("component").alias("parent"), "n")
        # Parents that hooked no further are their own component.
        done = own.join(found.select(F.col("node").alias("component")), "component", "left_anti").select("node", "component")
        later = _relabel(own, "component", sized, "n", parents.count())
        found = stored(later.select("node", "component").unionByName(done))
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
