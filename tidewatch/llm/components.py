"""Connected components of a link table: union-find as alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.session import materialize


def _largest_to_least(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour instead (the node itself, if that is least)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("least")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _smaller_to_least(links: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are linked to the least of them. ``a`` is larger than ``b`` in every link."""
    least = materialize(links.groupBy("a").agg(F.min("b").alias("least")), "least")
    others = links.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return others.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``); a component is named by its least node.

    Each round keeps the components and shortens every path; it ends when a round changes nothing. Rounds grow
    with the logarithm of the number of nodes. Self-links and repeated links are allowed; no
    links give no rows.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = materialize(links, "links"), None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        links = materialize(_smaller_to_least(materialize(_largest_to_least(links), "links")), "links")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
