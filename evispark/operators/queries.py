"""Query understanding: filters, rewritten text, retrieval texts, request checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions import arrays as A
from evispark.functions import text as T

# Fixed values.
DOCUMENT_TYPES = ("政策", "标准", "规划", "技术文件", "其他")
HARD_FILTER_FIELDS = ("region_names", "document_types")
FILTER_FIELDS = ("file_titles", "region_names", "document_types", "topics", "keywords")
FILTER_MAX_VALUES = 10
REWRITTEN_MAX_CHARS = 200
RETRIEVAL_MAX_CHARS = 500
ORIGINAL_MAX_CHARS = 2000
RETRIEVAL_LABELS = {"file_titles": "文件", "region_names": "地域", "topics": "主题", "keywords": "关键词"}
SCOPE_LABELS = {"file_titles": "文件", "region_names": "地域", "document_types": "文档类型", "topics": "主题"}
NO_SCOPE = "无额外范围限制"
DEFAULT_CLARIFICATION = "当前问题中的指代或限定范围不明确，请补充具体问题。"


def _clean_lists(raw: Column) -> dict[str, Column]:
    out = {f: A.ordered_unique(raw[f], FILTER_MAX_VALUES) for f in FILTER_FIELDS}
    out["document_types"] = F.filter(out["document_types"], lambda x: x.isin(*DOCUMENT_TYPES))
    return out


def normalise_filters(raw: Column) -> Column:
    """Clean lists, known document types, hard fields only where their list has values."""
    lists = _clean_lists(raw)
    asked = A.ordered_unique(raw["hard_fields"], FILTER_MAX_VALUES)
    usable = F.array_compact(
        F.array(*[F.when(F.size(lists[f]) > 0, F.lit(f)) for f in HARD_FILTER_FIELDS])
    )
    return F.struct(
        *[c.alias(f) for f, c in lists.items()],
        F.array_intersect(asked, usable).alias("hard_fields"),
        F.coalesce(raw["strict"], F.lit(False)).alias("strict"),
    )


def normalise_understanding(raw: Column, original: Column) -> Column:
    """Trusted form of a model's answer about a query; hard fields follow from ``strict`` alone."""
    rewritten = T.collapse(F.coalesce(F.nullif(raw["rewritten_query"], F.lit("")), original))
    shortened = F.regexp_replace(F.substring(original, 1, REWRITTEN_MAX_CHARS), rf"[{T.SPACE}]+$", "")
    lists = _clean_lists(raw)
    strict = F.coalesce(raw["strict"], F.lit(False))
    hard = F.array_compact(
        F.array(*[F.when(strict & (F.size(lists[f]) > 0), F.lit(f)) for f in HARD_FILTER_FIELDS])
    )
    needs = F.coalesce(raw["needs_clarification"], F.lit(False))
    question = T.first_text(raw["clarification_question"])
    return F.struct(
        F.when(F.length(rewritten) > REWRITTEN_MAX_CHARS, shortened).otherwise(rewritten).alias("rewritten_query"),
        F.struct(*[c.alias(f) for f, c in lists.items()], hard.alias("hard_fields"), strict.alias("strict")).alias(
            "query_filters"
        ),
        needs.alias("needs_clarification"),
        F.when(~needs, F.lit(""))
        .when(question == "", F.lit(DEFAULT_CLARIFICATION))
        .otherwise(question)
        .alias("clarification_question"),
    )


def _unsaid(values: Column, said: Column) -> Column:
    return F.filter(values, lambda x: ~F.contains(said, x))


def retrieval_text(text: Column, filters: Column) -> Column:
    """Query plus labelled soft filters it does not already name; over-long results fall back to the query."""
    lines = [text]
    for field, label in RETRIEVAL_LABELS.items():
        values = _unsaid(filters[field], text)
        lines.append(F.when(F.size(values) > 0, F.concat(F.lit(label + "："), F.array_join(values, "、"))))
    built = F.concat_ws("\n", *lines)
    return F.when(F.length(built) > RETRIEVAL_MAX_CHARS, F.substring(text, 1, RETRIEVAL_MAX_CHARS)).otherwise(built)


def web_search_text(text: Column, filters: Column) -> Column:
    parts = [text]
    for field in ("file_titles", "region_names", "document_types"):
        values = _unsaid(filters[field], text)
        parts.append(F.when(F.size(values) > 0, F.array_join(values, " ")))
    return F.substring(F.concat_ws(" ", *parts), 1, RETRIEVAL_MAX_CHARS)


def scope_text(filters: Column) -> Column:
    parts = [
        F.when(F.size(filters[f]) > 0, F.concat(F.lit(label + "："), F.array_join(filters[f], "、")))
        for f, label in SCOPE_LABELS.items()
    ]
    return F.coalesce(F.nullif(F.concat_ws("；", *parts), F.lit("")), F.lit(NO_SCOPE))
