"""Connected components of a graph given as a table of edges, by alternating stars.

Every round is a group-by and a join; no vertex's neighbours are ever gathered
in one place, so a vertex of any degree is fine. What reaches the driver is one
checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import Tables


def _pointed(pairs: DataFrame, tables: Tables) -> DataFrame:
    """For directed pairs (u, v): u and v with the least of u and all its v."""
    # Written first: the join then has an exchange of its own on both sides, and a node with very many edges can be split.
    least = tables.put(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an edge between different nodes; root is the least node that it reaches."""
    tables = Tables(edges.sparkSession, "components")
    edges = tables.put(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Larger neighbours of a node move to its least neighbour ...
        large = _pointed(both, tables).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # ... then a node and its smaller neighbours move to the least of them.
        small = _pointed(tables.put(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), tables)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = tables.put(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        tables.drop(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
