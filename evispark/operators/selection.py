"""From merged candidates to the final evidence: scoring, cut at the score cliff, spread over documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators.ranking import ranked

# Fixed values.
MAX_INPUT_TOKENS = 512
RESERVED_TOKENS = 4


def rerank_text(display_title: Column, content: Column) -> Column:
    return F.concat_ws("\n", T.blank_to_null(display_title), T.blank_to_null(content))


def fitted_rerank_text(question: Column, text: Column) -> Column:
    """Scoring copy within the token budget: a longer text keeps its first tokens."""
    tokens = F.regexp_extract_all(text, F.lit(T.TOKEN_PATTERN), F.lit(0))
    room = F.greatest(F.lit(1), MAX_INPUT_TOKENS - T.token_estimate(question) - RESERVED_TOKENS)
    return F.when(F.size(tokens) <= room, text).otherwise(F.array_join(F.slice(tokens, F.lit(1), room), " "))


def lexical_score(question: Column, text: Column) -> Column:
    """Share of common distinct words: the offline stand-in for a pair scorer, between 0 and 1."""
    a, b = F.array_distinct(T.words(question)), F.array_distinct(T.words(text))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 9)).otherwise(F.lit(0.0))


def pair_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """Wrap a model as a pair-scoring column function; ``load`` runs once per Python worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, texts in batches:
            scores = model(questions.tolist(), texts.tolist())
            if len(scores) != len(questions):
                raise ValueError("scorer returned another number of scores than pairs")
            yield pd.Series(scores, dtype="float64")

    # Marked so that no filter above it is pushed down with a second run of the model.
    return score.asNondeterministic()


def score_ranked(df: DataFrame, score: Column, group: str = "query_id") -> DataFrame:
    """Rank by score; equal scores keep the upstream order."""
    return ranked(df.withColumn("score", score), [group], [F.desc("score"), F.asc("upstream_rank")])


def dynamic_top_k(df: DataFrame, strict_single_file: bool = False, group: str = "query_id") -> DataFrame:
    """Cut each ranking at its first score cliff, then fill the places under the per-document cap.

    Columns used: rank, score, document_id, candidate_id and the settings rerank_min_topk,
    rerank_max_topk, rerank_gap_ratio, rerank_gap_abs, rerank_max_per_document.
    """
    by_rank = Window.partitionBy(group).orderBy("rank")
    whole = Window.partitionBy(group)
    longest = F.least(F.col("rerank_max_topk"), F.count("*").over(whole).cast("int"))
    current = F.coalesce("score", F.lit(0.0))
    drop = current - F.lead(current).over(by_rank)
    relative = F.when(current > 0, drop / current).otherwise(F.lit(0.0))
    cliff = (drop >= F.col("rerank_gap_abs")) | (relative >= F.col("rerank_gap_ratio"))
    cut = df.withColumn("_max", longest).withColumn("_cliff", cliff)
    inside = F.col("_cliff") & (F.col("rank") >= F.col("rerank_min_topk")) & (F.col("rank") <= F.col("_max") - 1)
    cut = cut.withColumn("top_k", F.coalesce(F.min(F.when(inside, F.col("rank"))).over(whole), F.col("_max"))).drop(
        "_max", "_cliff"
    )
    if strict_single_file:
        return cut.where(F.col("rank") <= F.col("top_k")).withColumn("final_rank", F.col("rank"))
    document = F.coalesce(F.nullif("document_id", F.lit("")), F.col("candidate_id"), F.lit(""))
    within = F.row_number().over(Window.partitionBy(group, document).orderBy("rank"))
    spread = cut.withColumn("_within", within).where(F.col("_within") <= F.col("rerank_max_per_document"))
    placed = ranked(spread, [group], [F.asc("rank")], "final_rank")
    return placed.where(F.col("final_rank") <= F.col("top_k")).drop("_within")


def degraded_order(df: DataFrame, group: str = "query_id") -> DataFrame:
    """Upstream order, first ``rerank_max_topk`` rows: what remains when scoring failed."""
    return (
        ranked(df, [group], [F.asc("upstream_rank")], "final_rank")
        .where(F.col("final_rank") <= F.col("rerank_max_topk"))
        .withColumn("reranker_status", F.lit("failed"))
    )


def rerank(df: DataFrame, failed: Column, group: str = "query_id") -> DataFrame:
    """Scored selection where scoring worked, upstream order where it failed."""
    good = dynamic_top_k(df.where(~failed), group=group).withColumn("reranker_status", F.lit("success"))
    return good.drop("top_k").unionByName(degraded_order(df.where(failed), group), allowMissingColumns=True)


def public_evidence(df: DataFrame, top_k: int, group: str = "query_id") -> DataFrame:
    """Rows fit to be shown: ids, name and content present, finite score, first ``top_k`` in order."""
    if not 1 <= top_k <= 6:
        raise ValueError("top_k must be between 1 and 6")
    score = F.coalesce("rerank_score", "score")
    usable = (
        (T.first_text(F.col("chunk_id")) != "")
        & (T.first_text(F.col("document_id")) != "")
        & (T.first_text(F.col("file_title")) != "")
        & (T.first_text(F.col("content")) != "")
        & score.isNotNull()
        & ~F.isnan(score)
        & (F.abs(score) < float("inf"))
    )
    kept = df.where(usable).select(
        group,
        "rank",
        T.first_text(F.col("chunk_id")).alias("chunk_id"),
        T.first_text(F.col("document_id")).alias("document_id"),
        T.first_text(F.col("file_title")).alias("document_name"),
        T.first_text(F.col("section_title")).alias("section_title"),
        "content",
        score.alias("score"),
    )
    return ranked(kept.withColumnRenamed("rank", "_rank"), [group], [F.asc("_rank")]).where(F.col("rank") <= top_k).drop("_rank")


def local_candidates(hits: DataFrame, retrieval_source: str) -> DataFrame:
    """Search hits in the common candidate shape; hits without id, content or file title go."""
    empty = F.array().cast("array<string>")
    return hits.where(
        (T.first_text(F.col("chunk_id")) != "")
        & (T.first_text(F.col("content")) != "")
        & (T.first_text(F.col("file_title")) != "")
    ).select(
        "query_id",
        "rank",
        T.first_text(F.col("chunk_id")).alias("chunk_id"),
        "document_id",
        "chunk_index",
        T.first_text(F.col("file_title")).alias("file_title"),
        T.first_text(F.col("section_title")).alias("section_title"),
        T.display_title(F.col("file_title"), F.col("section_title")).alias("display_title"),
        T.first_text(F.col("content")).alias("content"),
        F.coalesce(F.nullif("context_type", F.lit("")), F.lit("text")).alias("context_type"),
        F.coalesce("region_names", empty).alias("region_names"),
        F.coalesce(F.nullif("document_type", F.lit("")), F.lit("其他")).alias("document_type"),
        F.coalesce("topics", empty).alias("topics"),
        F.coalesce("keywords", empty).alias("keywords"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.lit("milvus").alias("source"),
        F.lit(retrieval_source).alias("retrieval_source"),
        F.lit("").alias("url"),
    )
