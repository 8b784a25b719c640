"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a few shuffles with map-side minima; no node's neighbours are gathered in one task, nothing but a yes or no
comes to the driver. The number of rounds grows with the logarithm of the longest path. Lineage is cut by writing each
round's edges to the shared folder.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared_store import written


def _settled(parent: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one: then all components are stars around their smallest node."""
    ends = parent.select(F.col("node").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("held")).unionByName(parent.select(F.col("to").alias("k"), F.lit(0).alias("out"), F.lit(1).alias("held")))
    return ends.groupBy("k").agg(F.sum("out").alias("out"), F.max("held").alias("held")).where("out > 1 OR out = 1 AND held = 1").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of an edge; empty for no edges."""
    parent = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("to")).where("node <> to").distinct()
    parent = written(parent, "edges")
    while not _settled(parent):
        # Large star: larger neighbours of a node move on to the smallest of its neighbours and itself.
        both = parent.unionByName(parent.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("to > node").select(F.col("to").alias("node"), F.col("m").alias("to")).where("node <> to")
        # Small star: a node and its smaller neighbours move on to the smallest of them.
        low = large.groupBy("node").agg(F.min("to").alias("m"))
        small = large.join(low, "node").select(F.col("to").alias("node"), F.col("m").alias("to")).where("node <> to").unionByName(low.select("node", F.col("m").alias("to"))).distinct()
        parent = written(small, "edges")
    roots = parent.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct()
    return parent.select("node", F.col("to").alias("component")).unionByName(roots)


def with_components(nodes: DataFrame, ident: str, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """nodes with component; a node without an edge is its own."""
    found = components(edges, a, b).select(F.col("node").alias(ident), "component")
    return nodes.join(found, ident, "left").withColumn("component", F.coalesce("component", ident))
