"""Rank fusion and the merge of local and web candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators.ranking import first_per_key, ranked


def reciprocal_rank_fusion(candidates: DataFrame, k: Column, limit: Column, payload: list[str] | None = None) -> DataFrame:
    """Sum of weight / (k + rank) per chunk.

    ``candidates``: query_id, list_no, rank, chunk_id, source, score, weight, plus what ``k`` and
    ``limit`` refer to. Blank ids score nothing but keep their rank; a chunk listed twice scores twice;
    ties keep the order of first appearance; the first appearance supplies the payload.
    """
    first_seen = F.struct("list_no", "rank")
    rows = candidates.where(T.strip(F.coalesce("chunk_id", F.lit(""))) != "").withColumn("_limit", limit)
    fused = rows.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("raw"),
        F.min(first_seen).alias("_first"),
        F.array_sort(
            F.collect_list(F.struct("list_no", "rank", "source", F.coalesce("score", F.lit(0.0)).alias("score")))
        ).alias("_seen"),
        F.max("_limit").alias("_limit"),
        *[F.min_by(c, first_seen).alias(c) for c in payload or []],
    )
    fused = fused.withColumn("sources", F.array_distinct(F.transform("_seen", lambda s: s["source"])))
    # The last score seen of a source stands.
    per_source = F.map_from_entries(
        F.transform(
            F.col("sources"),
            lambda s: F.struct(s, F.element_at(F.filter("_seen", lambda x: x["source"] == s), -1)["score"]),
        )
    )
    scored = fused.withColumn("score", F.round("raw", 12)).withColumn("retrieval_scores", per_source)
    order = [F.desc("score"), F.asc("_first.list_no"), F.asc("_first.rank")]
    return ranked(scored, ["query_id"], order).where(F.col("rank") <= F.col("_limit")).drop("raw", "_first", "_seen", "_limit")


def candidate_key(source: Column, chunk_id: Column, url: Column, title: Column, content: Column) -> Column:
    raw = F.coalesce(F.nullif(url, F.lit("")), F.concat_ws("\n", title, content))
    return F.when(source == "web", F.concat(F.lit("web:"), T.sha256_hex(raw))).otherwise(
        F.coalesce(chunk_id, F.lit(""))
    )


def merge_candidates(local: DataFrame, web: DataFrame) -> DataFrame:
    """Local rows before web rows, first occurrence of a candidate wins, blank ids go."""
    both = local.withColumn("_side", F.lit(0)).unionByName(web.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("milvus"))
    keyed = both.withColumn(
        "candidate_id",
        candidate_key(source, F.col("chunk_id"), F.col("url"), F.col("display_title"), F.col("content")),
    ).where(F.col("candidate_id") != "")
    first = first_per_key(keyed, ["query_id", "candidate_id"], [F.asc("_side"), F.asc("rank")])
    merged = ranked(first.withColumnRenamed("rank", "_rank"), ["query_id"], [F.asc("_side"), F.asc("_rank")], "upstream_rank")
    return merged.drop("_side", "_rank").withColumn("rerank_score", F.lit(0.0))
