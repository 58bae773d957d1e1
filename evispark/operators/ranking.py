"""Ranked selection shared by all retrieval steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.session import cut_lineage


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. The literal bound lets Spark cut every partition before the shuffle."""
    return ranked(df, group, order, name).where(F.col(name) <= k)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, key, order, 1, "_first").drop("_first")


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the row's number from 0 in order of all rows, which are numbered by ranges and never meet in one task.

    Rows equal in ``order`` are numbered in any order.
    """
    keys = [*order, "_tie"]
    placed = cut_lineage(
        df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
        .withColumn("_seat", F.monotonically_increasing_id())
        .withColumn("_range", F.spark_partition_id())
    )
    # As many rows as ranges.
    counts = placed.groupBy("_range").agg(F.min("_seat").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.col("_seat") - F.col("_first") + F.col("_before")
    return placed.join(F.broadcast(starts), "_range").withColumn(name, number).drop("_seat", "_range", "_first", "_before")
