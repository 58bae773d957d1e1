"""The answering chain for a batch of queries: retrieval, web hits, reranking, selection, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.operators import context as X
from evispark.operators import selection as S
from evispark.operators.fusion import merge_candidates
from evispark.plans.hybrid import hybrid_retrieval

PAYLOAD = (
    "chunk_id", "document_id", "chunk_index", "file_title", "section_title", "content", "context_type", "region_names", "document_type", "topics", "keywords", "token_count",
)
SELECTION = ("rerank_min_topk", "rerank_max_topk", "rerank_gap_ratio", "rerank_gap_abs", "rerank_max_per_document", "answer_max_context_chars")


def answer_evidence(queries: DataFrame, chunks: DataFrame, web: DataFrame, score: Callable[[Column, Column], Column] = S.lexical_score) -> DataFrame:
    """The evidence that each query is answered from: query_id, final_rank, candidate_id, the candidate's fields, rerank score,
    reranker_status and the context budget.

    ``queries``: query_id, text, settings (as ``operators.config.resolve`` gives them) and optional filters; ``chunks``: the chunk
    table, with stored vectors (dense, terms, weights) or without; ``web``: query_id, rank, url, display_title, content.
    Chunks are fetched for the fused hits alone. Web hits count where a query's settings allow them, up to their number. A
    query for which ``score`` gives a null keeps the order of its candidates.
    """
    asked = queries.select("query_id", F.col("text").alias("question"), "settings")
    fused = hybrid_retrieval(queries, chunks).select("query_id", "chunk_id", "rank", "score")
    local = S.local_candidates(fused.join(chunks.select(*PAYLOAD), "chunk_id"), "rrf")
    offered = web.join(asked.select("query_id", "settings"), "query_id").where("settings.web_enabled AND rank <= settings.web_top_k")
    found = offered.select("query_id", "rank", "url", "display_title", "content", F.lit("web").alias("source"), F.lit("").alias("chunk_id"))
    paired = merge_candidates(local.drop("score"), found).drop("rerank_score").join(asked, "query_id")
    text = S.fitted_rerank_text(F.col("question"), S.rerank_text(F.col("display_title"), F.col("content")))
    scored = S.score_ranked(paired, score(F.col("question"), text)).withColumns({c: F.col(f"settings.{c}") for c in SELECTION})
    failed = F.max(F.col("score").isNull()).over(Window.partitionBy("query_id"))
    return S.rerank(scored.drop("settings").withColumn("_failed", failed), F.col("_failed")).drop("_failed")


def answer_contexts(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per query: context, n_sections, labels (what an answer may cite, in order) and candidate_ids.

    Sections follow the evidence until the query's budget of characters is used up. A query without evidence has an empty
    context; ``operators.context.answer_text`` gives it the fixed answer.
    """
    label = X.source_label(F.col("source"), F.col("file_title"), F.col("section_title"), F.col("url"))
    rows = evidence.withColumn("rank", F.col("final_rank")).withColumn("section", X.evidence_section(F.col)).withColumn("label", label)
    kept = X.within_budget(rows, F.col("answer_max_context_chars"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "section", "label", "candidate_id")))
    told = kept.groupBy("query_id").agg(ordered.alias("_r"))
    of = lambda name: F.coalesce(F.transform("_r", lambda r: r[name]), F.array().cast("array<string>"))
    return queries.select("query_id").join(told, "query_id", "left").select(
        "query_id", F.array_join(of("section"), "\n\n").alias("context"), F.size(of("section")).alias("n_sections"),
        of("label").alias("labels"), of("candidate_id").alias("candidate_ids"),
    )
