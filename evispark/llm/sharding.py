"""Weighted rendezvous sharding with DataFrame operations only.

Each key draws a number in (0, 1) for each shard from a hash of both; the shard with the smallest -ln(number) / weight
takes it. A further shard draws its own numbers and so takes rows only into itself, in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evispark.llm.durable import durable


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of MD5 of "key:shard"."""
    digest = F.md5(F.encode(F.concat(key, F.lit(":"), shard.cast("string")), "utf-8"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of a key; a weight of 0 takes nothing. Ties go to the smaller number."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one weight must be positive")
    draws = [
        F.struct((-F.log(draw(key, F.lit(i))) / float(w)).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], *, key_col: str = "doc_id", text_col: str = "text", grow_by: float = 1.0) -> DataFrame:
    """One row per document: key_col, size, text_crc32 (long), law ('key'), shard (int), slot (long) and grown_shard (int).

    size is the UTF-8 bytes of the text (null: none) plus 16, text_crc32 its unsigned CRC-32, slot the row's number from 0
    within its shard, without gaps, in order of key, size and checksum. grown_shard is the shard after one more, of weight
    ``grow_by``, has been added. Shards depend on the key and the weights alone, so equal texts may part.

    A null key counts as the empty string, a null text as empty. Rows that repeat a key share its shard, however many they
    are, but their slots are numbered by ranges of rows, never by one task for a key or shard. An empty table gives an
    empty result; other columns are not looked at.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    n = len(weights)
    one = rendezvous(key, weights)
    rows = docs.select(
        F.col(key_col).alias("_key"), key.alias("_name"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        one.alias("shard"), (-F.log(draw(key, F.lit(n))) / float(grow_by)).alias("_new"),
    )
    own = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("shard") + 1)
    grown = F.when(F.col("_new") < -F.log(draw(F.col("_name"), F.col("shard"))) / own, F.lit(n)).otherwise(F.col("shard"))
    # Ranges of rows in order; a row number ends the order, so rows that are equal in all else can still part.
    ordered = rows.select("_key", "size", "text_crc32", "shard", grown.cast("int").alias("grown_shard"), F.monotonically_increasing_id().alias("_row"))
    placed = durable(
        durable(ordered).repartitionByRange("shard", "_key", "size", "text_crc32", "_row")
        .sortWithinPartitions("shard", "_key", "size", "text_crc32", "_row")
        .withColumn("_range", F.spark_partition_id())
    )
    # As many rows as ranges and shards.
    counts = placed.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("shard", "_range").orderBy("_key", "size", "text_crc32", "_row")
    numbered = placed.withColumn("_rank", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "_range"]).select(
        F.col("_key").alias(key_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_before") + F.col("_rank")).alias("slot"), "grown_shard",
    )
