"""Retrieval settings as columns, so that one job serves queries of every mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions.text import clamp

# Field order and the three presets.
FIELDS = (
    "ann_limit",
    "search_top_k",
    "dense_weight",
    "sparse_weight",
    "hyde_enabled",
    "web_enabled",
    "web_top_k",
    "rrf_k",
    "rrf_embedding_weight",
    "rrf_hyde_weight",
    "rrf_top_k",
    "rerank_min_topk",
    "rerank_max_topk",
    "rerank_gap_ratio",
    "rerank_gap_abs",
    "rerank_max_per_document",
    "answer_max_context_chars",
)
PRESETS = {
    "balanced": (20, 10, 0.6, 0.4, True, True, 5, 60, 1.0, 0.8, 12, 2, 6, 0.2, 0.2, 2, 20000),
    "precision": (12, 6, 0.6, 0.4, True, False, 3, 40, 1.0, 0.4, 8, 1, 3, 0.10, 0.10, 2, 12000),
    "recall": (40, 20, 0.6, 0.4, True, True, 8, 60, 1.0, 1.0, 24, 6, 12, 0.35, 0.35, 3, 30000),
}
DENSE_WEIGHTS = {"keyword": 0.35, "balanced": 0.6, "semantic": 0.8}
SPARSE_WEIGHTS = {"keyword": 0.65, "balanced": 0.4, "semantic": 0.2}
HYDE_WEIGHTS = {"low": 0.4, "medium": 0.8, "high": 1.0}
MODE_LABELS = {"balanced": "均衡", "precision": "精确回答", "recall": "全面检索", "custom": "自定义"}


def _lookup(key: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def custom_settings(o: Column) -> Column:
    """Settings derived from the public options of the custom mode."""
    k, m = o["candidate_top_k"], o["max_reference_count"]
    values = (
        clamp(2 * k, 10, 50),
        k,
        _lookup(o["matching_preference"], DENSE_WEIGHTS),
        _lookup(o["matching_preference"], SPARSE_WEIGHTS),
        o["hyde_enabled"],
        F.coalesce(o["web_enabled"], F.lit(True)),
        F.lit(5),
        F.lit(60),
        F.lit(1.0),
        _lookup(o["hyde_influence"], HYDE_WEIGHTS),
        clamp(F.greatest(m, F.ceil(k * 6 / 5).cast("int")), 5, 30),
        F.least(F.lit(2), m),
        m,
        F.lit(0.2),
        F.lit(0.2),
        F.lit(2),
        clamp(m * 2500, 5000, 30000),
    )
    return F.struct(*[v.alias(f) for f, v in zip(FIELDS, values)])


def preset_settings(name: str) -> Column:
    return F.struct(*[F.lit(v).alias(f) for f, v in zip(FIELDS, PRESETS[name])])


def resolve(mode: Column, options: Column | None = None) -> Column:
    """Settings of a mode; null for an unknown mode."""
    out = F.when(mode == "balanced", preset_settings("balanced"))
    for name in ("precision", "recall"):
        out = out.when(mode == name, preset_settings(name))
    if options is not None:
        out = out.when(mode == "custom", custom_settings(options))
    return out


def option_problems(mode: Column, options: Column) -> list[tuple[str, Column]]:
    """Rules on the request: each pair names a rule and tells where it is broken."""
    is_custom = mode == "custom"
    k, m = options["candidate_top_k"], options["max_reference_count"]
    return [
        ("unknown_mode", ~mode.isin(*MODE_LABELS)),
        ("custom_needs_options", is_custom & options.isNull()),
        ("options_only_for_custom", ~is_custom & options.isNotNull()),
        ("candidate_top_k_range", is_custom & options.isNotNull() & ~F.coalesce(k.between(5, 25), F.lit(False))),
        ("max_reference_count_range", is_custom & options.isNotNull() & ~F.coalesce(m.between(1, 12), F.lit(False))),
        (
            "matching_preference_value",
            is_custom & options.isNotNull() & ~F.coalesce(options["matching_preference"].isin(*DENSE_WEIGHTS), F.lit(False)),
        ),
        (
            "hyde_influence_value",
            is_custom & options.isNotNull() & ~F.coalesce(options["hyde_influence"].isin(*HYDE_WEIGHTS), F.lit(False)),
        ),
    ]


def invariant_problems(c: Column) -> list[tuple[str, Column]]:
    """Hard limits every resolved setting must respect."""
    return [
        ("ann_limit", ~c["ann_limit"].between(10, 50)),
        ("search_top_k", ~c["search_top_k"].between(5, 25) | (c["search_top_k"] > c["ann_limit"])),
        ("weight_sum", F.abs(c["dense_weight"] + c["sparse_weight"] - 1.0) > 1e-9),
        ("weight_range", ~c["dense_weight"].between(0, 1) | ~c["sparse_weight"].between(0, 1)),
        ("rerank_order", c["rerank_min_topk"] > c["rerank_max_topk"]),
        ("rerank_min_topk", ~c["rerank_min_topk"].between(1, 12)),
        ("rerank_max_topk", ~c["rerank_max_topk"].between(1, 12)),
        ("rrf_top_k", (c["rrf_top_k"] < c["rerank_max_topk"]) | (c["rrf_top_k"] > 30)),
        ("rrf_k", ~c["rrf_k"].between(10, 100)),
        ("rrf_weights", ~c["rrf_embedding_weight"].between(0, 1) | ~c["rrf_hyde_weight"].between(0, 1)),
        ("web_top_k", ~c["web_top_k"].between(1, 10)),
        ("gap_ratio", ~c["rerank_gap_ratio"].between(0, 1)),
        ("gap_abs", ~c["rerank_gap_abs"].between(0, 1)),
        ("max_per_document", ~c["rerank_max_per_document"].between(1, 5)),
        ("context_chars", ~c["answer_max_context_chars"].between(5000, 30000)),
    ]


def search_breadth(c: Column) -> Column:
    k = c["search_top_k"]
    return F.when(k <= 6, F.lit("较窄")).when(k >= 20, F.lit("较广")).otherwise(F.lit("适中"))


def matching_label(c: Column) -> Column:
    return (
        F.when(c["dense_weight"] < c["sparse_weight"], F.lit("关键词优先"))
        .when(c["dense_weight"] > 0.6, F.lit("语义优先"))
        .otherwise(F.lit("均衡"))
    )


def mode_label(mode: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, label in MODE_LABELS.items():
        out = F.when(mode == name, F.lit(label)).otherwise(out)
    return out
