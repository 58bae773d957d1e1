"""Candidate pairs with the token sets of both nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.durable import durable

MAX_BROADCAST_PAIRS = 500_000  # of 16 bytes; more pairs are joined by shuffles


def with_sets(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) pairs with all columns of ``nodes`` as x_... of a and y_... of b.

    Few pairs go to the sets, so that only the sets that a pair names cross a shuffle, and those of b in one copy.
    """
    pairs = durable(pairs.select("a", "b"), release=True)
    few = pairs.count() <= MAX_BROADCAST_PAIRS
    small = F.broadcast if few else (lambda df: df)
    x, y = (nodes.select(*(F.col(c).alias(f"{side}_{c}") for c in nodes.columns)) for side in "xy")
    first = x.join(small(pairs), F.col("x_node") == F.col("a"))
    named = y.join(small(pairs.select("b").distinct().withColumnRenamed("b", "_b")), F.col("y_node") == F.col("_b"), "left_semi")
    return first.join(named, F.col("b") == F.col("y_node"))
