"""End-to-end batch retrieval: two query forms, two vector arms, weighted fusion, rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import embedding as E
from evispark.operators import retrieval as R
from evispark.operators.fusion import reciprocal_rank_fusion


# The balanced preset.
BALANCED = {
    "ann_limit": 20,
    "search_top_k": 10,
    "dense_weight": 0.6,
    "sparse_weight": 0.4,
    "rrf_k": 60,
    "rrf_embedding_weight": 1.0,
    "rrf_hyde_weight": 0.8,
    "rrf_top_k": 12,
}
ANN_LIMIT_MAX = 50
HYDE_MAX_CHARS = 300
FILTER_COLUMNS = ("only", "document_types", "regions")
CHUNK_FILTER_COLUMNS = ("group", "document_type", "region_names")
HYDE_LABEL = "\n相关文档可能表述："


def hypothetical_passage(text):
    """Offline stand-in for a model: the query's distinct words in order."""
    passage = F.array_join(F.array_sort(F.array_distinct(T.words(text))), " ")
    return F.substring(passage, 1, HYDE_MAX_CHARS)


def query_forms(queries: DataFrame) -> DataFrame:
    """The plain form of every query, and the form extended by its hypothetical passage unless that is empty, or unless the
    query's settings switch it off."""
    passage = hypothetical_passage(F.col("text"))
    plain = F.struct(F.lit("embedding").alias("source"), F.lit(0).alias("list_no"), F.col("text").alias("text"))
    extended = F.struct(
        F.lit("hyde").alias("source"),
        F.lit(1).alias("list_no"),
        F.concat("text", F.lit(HYDE_LABEL), passage).alias("text"),
    )
    more = (passage != "") & F.col("settings.hyde_enabled") if "settings" in queries.columns else passage != ""
    forms = F.when(more, F.array(plain, extended)).otherwise(F.array(plain))
    own = [c for c in (*FILTER_COLUMNS, "settings") if c in queries.columns]
    return queries.select(F.col("query_id").alias("base_id"), F.explode(forms).alias("f"), *own).select(
        F.concat_ws("#", "base_id", "f.source").alias("query_id"), "base_id", "f.source", "f.list_no", "f.text", *own
    )


def search_forms(forms: DataFrame, chunks: DataFrame, config: dict = BALANCED, encode=None) -> DataFrame:
    """Both vector arms for every query form: query_id, chunk_id, score, rank.

    ``chunks`` may bring stored vectors (dense, terms, weights); else its content is encoded here, one
    narrow step of the scan. Filters that the queries bring restrict both arms before their cut. Queries with ``settings``
    have their own number of hits and weights, and the result keeps that column.
    """
    stored = {"dense", "terms", "weights"} <= set(chunks.columns)
    own = [c for c in CHUNK_FILTER_COLUMNS if c in chunks.columns]
    vectors = chunks if stored else E.search_vectors(chunks.select("chunk_id", "content", *own), "chunk_id", "content", encode, own)
    filters = [c for c in FILTER_COLUMNS if c in forms.columns]
    if "settings" not in forms.columns:
        asked = E.search_vectors(forms.select("query_id", "text", *filters), "query_id", "text", encode, filters)
        found = R.search(asked, vectors, config["ann_limit"])
        return R.weighted_hybrid(found, config["dense_weight"], config["sparse_weight"], config["search_top_k"])
    limit = F.col("settings.ann_limit").alias("k")
    asked = E.search_vectors(forms.select("query_id", "text", *filters, limit), "query_id", "text", encode, [*filters, "k"])
    settings = forms.select("query_id", "settings")
    found = R.search(asked, vectors, ANN_LIMIT_MAX).join(settings, "query_id")
    weights = (F.col(f"settings.{c}") for c in ("dense_weight", "sparse_weight", "search_top_k"))
    return R.weighted_hybrid(found, *weights).join(settings, "query_id")


def stored_chunks(table: DataFrame) -> DataFrame:
    """Rows of the chunk table with their stored vectors as a search takes them; nothing is encoded again."""
    sparse = F.col("sparse_vector")
    return table.withColumns({"dense": F.col("dense_vector"), "terms": F.map_keys(sparse), "weights": F.map_values(sparse)}).drop("dense_vector", "sparse_vector")


def hybrid_retrieval(queries: DataFrame, chunks: DataFrame, config: dict = BALANCED) -> DataFrame:
    """Fused ranking per query. ``queries``: query_id, text, and optional filters and ``settings``, a struct as
    ``operators.config.resolve`` gives it, so that one batch serves queries of every mode; ``config`` holds for queries without.
    ``chunks``: chunk_id, content."""
    forms = query_forms(queries)
    hits = search_forms(forms, chunks, config)
    own = "settings" in queries.columns
    setting = lambda name: F.col(f"settings.{name}") if own else F.lit(config[name])
    named = hits.withColumn("base_id", F.substring_index("query_id", "#", 1)).withColumn(
        "source", F.substring_index("query_id", "#", -1)
    )
    first = F.col("source") == "embedding"
    lists = named.select(
        F.col("base_id").alias("query_id"),
        F.when(first, 0).otherwise(1).alias("list_no"),
        "rank",
        "chunk_id",
        "source",
        "score",
        F.when(first, setting("rrf_embedding_weight")).otherwise(setting("rrf_hyde_weight")).alias("weight"),
        *(["settings"] if own else []),
    )
    return reciprocal_rank_fusion(lists, setting("rrf_k"), setting("rrf_top_k"))
