"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import durable


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of long ids to (node, component): of each linked node, the smallest node that it reaches.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest one, then its
    smaller neighbours. Both keep at most one edge for each edge before, also around a hub that holds most nodes.
    Links of a node with itself or with null are ignored; no links give no rows.
    """
    edges = durable(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = durable(
            large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(root.select("u", F.col("m").alias("v")))
            .distinct()
        )
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
