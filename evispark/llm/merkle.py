"""Merkle trees over the groups of a table, with a proof for each leaf.

Each parent's children are spread into as many slot columns as the fan-out by conditional aggregates over the parent's rows;
the slots concatenated give the parent's digest, and without a child's own slot they are its siblings. Several levels share
one exchange: rows are dealt by the subtree that holds them and sorted once by their slots, outermost first, so that every
level's window finds its rows together and in order. Subtrees of at most SUBTREE leaves then become the rows of the next
round, and what they learn there is handed down to their own rows, so no group meets in one task, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evispark.llm.durable import durable

SUBTREE = 256
PROOF = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the strings, concatenated; null ones count as empty."""
    return F.sha2(F.encode(F.concat_ws("", *values), "utf-8"), 256)


def field(value: Column) -> Column:
    """A value that cannot run into the next: its UTF-8 byte count, a colon and itself; "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda below, step: digest(step["left"], below, step["right"]))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``at``, the row's number from 0 within its ``group``, and ``n``, the rows of the group. Rows are numbered by ranges
    of all rows, so a group of any size is dealt over many tasks; rows equal in all of ``order`` are numbered in any order."""
    ties = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["group", *order, "tie"]
    placed = durable(
        ties.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
        .withColumn("seat", F.monotonically_increasing_id())
        .withColumn("range", F.spark_partition_id())
    )
    counts = placed.groupBy("group", "range").agg(F.min("seat").alias("first"), F.count("*").alias("many"))
    group = W.partitionBy("group")
    before = F.sum("many").over(group.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("group", "range", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("many").over(group).alias("n"))
    at = F.col("seat") - F.col("first") + F.col("before")
    return placed.join(starts, ["group", "range"]).withColumn("at", at).drop("seat", "range", "first", "before")


def climb(nodes: DataFrame, fanout: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes (group, at, n, digest and columns to keep) with ``path``, the proof up to the top, and ``top``.

    ``crown`` takes (group, digest) of the tops and returns group, ``above``, the proof that goes on from there, and ``top``.
    """
    levels = 1
    while fanout ** (levels + 1) <= SUBTREE:
        levels += 1
    kept = [c for c in nodes.columns if c not in ("n", "digest")]
    slot = [f"slot{k}" for k in range(levels)]
    child = [f"child{k}" for k in range(fanout)]
    rows = nodes.withColumn("block", F.floor(F.col("at") / (fanout**levels)))
    rows = rows.withColumns({slot[k]: F.floor(F.col("at") / fanout**k) % fanout for k in range(levels)})
    outer = ["group", "block", *reversed(slot)]
    rows = rows.repartition("group", "block").sortWithinPartitions(*outer)
    for level in range(levels):
        own = F.col(slot[level])
        parent = W.partitionBy(*outer[: len(outer) - 1 - level])
        rows = rows.withColumns({child[k]: F.max(F.when(own == k, F.col("digest"))).over(parent) for k in range(fanout)})
        left = F.concat_ws("", *(F.when(own > k, F.col(child[k])) for k in range(fanout)))
        right = F.concat_ws("", *(F.when(own < k, F.col(child[k])) for k in range(fanout)))
        joins = F.col("n") > 1
        rows = rows.withColumns(
            {
                f"step{level}": F.when(joins, F.struct(left.alias("left"), right.alias("right"))),
                "digest": F.when(joins, digest(*map(F.col, child))).otherwise(F.col("digest")),
                "n": F.ceil(F.col("n") / fanout),
            }
        ).drop(*child)
    path = F.filter(F.array(*(F.col(f"step{k}") for k in range(levels))), lambda step: step.isNotNull()).cast(PROOF)
    rows = durable(rows.select(*kept, "block", "n", "digest", path.alias("path")))
    if (rows.agg(F.max("n")).first()[0] or 0) > 1:
        subtrees = rows.groupBy("group", "block").agg(F.max("n").alias("n"), F.max("digest").alias("digest")).withColumnRenamed("block", "at")
        above = climb(subtrees, fanout, crown).select("group", F.col("at").alias("block"), F.col("path").alias("above"), "top")
        whole = rows.join(above, ["group", "block"])
    else:
        # Every group is one subtree now.
        whole = rows.join(crown(rows.groupBy("group").agg(F.max("digest").alias("digest"))), "group")
    return whole.select(*kept, F.concat("path", "above").alias("path"), "top")


def merkle_manifest(rows: DataFrame, *, leaf_col: str, group_col: str, order_cols: Sequence[str], fanout: int = 2) -> DataFrame:
    """One row per row: row (a struct of all its columns), subroot, root (strings) and proof (array of left and right).

    ``leaf_col`` holds the leaf's digest in hex. The leaves of a group stand in order of ``order_cols``, then of the digest; while there
    are several nodes, every ``fanout`` consecutive ones (the last run may be shorter) become the digest of their concatenated
    digests. What remains is the subroot; a lone leaf is its own. Subroots in order of the group (null first, then by UTF-8
    bytes of its text) give the root likewise. A step of the proof has the digests left and right of the own one, joined;
    ``fold`` leads back to the root.

    Nulls come first in any order; a null group is a group. A null leaf counts as the empty string. Rows equal in order and leaf
    hold neighbouring places, in any order. An empty table gives an empty result. Names of columns cannot clash, since the row
    keeps them to itself. Select the columns to keep beforehand: whole rows travel.
    """
    if fanout < 2:
        raise ValueError("the fan-out must be two or more")
    order = [f"order{k}" for k in range(len(order_cols))]
    group = F.coalesce(F.concat(F.lit("."), F.col(group_col).cast("string")), F.lit(""))
    leaves = rows.select(
        group.alias("group"), F.struct(*(F.col(c) for c in rows.columns)).alias("row"), F.coalesce(F.col(leaf_col), F.lit("")).alias("digest"),
        *(F.col(c).alias(name) for c, name in zip(order_cols, order, strict=True)),
    )
    none = F.array().cast(PROOF)

    def crown(tops: DataFrame) -> DataFrame:
        seats = tops.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("digest").alias("subroot"), "digest")
        last = climb(numbered(seats, ["name"]), fanout, lambda top: top.select("group", none.alias("above"), F.col("digest").alias("top")))
        return last.select(F.col("name").alias("group"), F.col("path").alias("above"), F.struct("subroot", F.col("top").alias("root")).alias("top"))

    placed = numbered(durable(leaves), [*order, "digest"]).drop(*order)
    return climb(placed, fanout, crown).select("row", "top.subroot", "top.root", F.col("path").alias("proof"))
