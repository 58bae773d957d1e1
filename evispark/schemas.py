"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as t

STRINGS = t.ArrayType(t.StringType())

CHUNK = t.StructType(
    [
        t.StructField("chunk_id", t.StringType()),
        t.StructField("document_id", t.StringType()),
        t.StructField("chunk_index", t.IntegerType()),
        t.StructField("file_title", t.StringType()),
        t.StructField("section_title", t.StringType()),
        t.StructField("content", t.StringType()),
        t.StructField("context_type", t.StringType()),
        t.StructField("region_names", STRINGS),
        t.StructField("document_type", t.StringType()),
        t.StructField("topics", STRINGS),
        t.StructField("keywords", STRINGS),
        t.StructField("token_count", t.IntegerType()),
        t.StructField("dense_vector", t.ArrayType(t.FloatType())),
        t.StructField("sparse_vector", t.MapType(t.IntegerType(), t.FloatType())),
    ]
)
LEGACY_CHUNK_COLUMNS = ("item_name", "title", "parent_title", "part")

QUERY_FILTERS = t.StructType(
    [
        t.StructField("file_titles", STRINGS),
        t.StructField("region_names", STRINGS),
        t.StructField("document_types", STRINGS),
        t.StructField("topics", STRINGS),
        t.StructField("keywords", STRINGS),
        t.StructField("hard_fields", STRINGS),
        t.StructField("strict", t.BooleanType()),
    ]
)

UNDERSTANDING = t.StructType(
    [t.StructField("rewritten_query", t.StringType())]
    + QUERY_FILTERS.fields
    + [
        t.StructField("needs_clarification", t.BooleanType()),
        t.StructField("clarification_question", t.StringType()),
    ]
)

DOCUMENT_METADATA = t.StructType(
    [
        t.StructField("document_type", t.StringType()),
        t.StructField("region_names", STRINGS),
        t.StructField("topics", STRINGS),
        t.StructField("keywords", STRINGS),
    ]
)

FINDING = t.StructType(
    [
        t.StructField("finding_id", t.StringType()),
        t.StructField("claim", t.StringType()),
        t.StructField("summary", t.StringType()),
        t.StructField("title", t.StringType()),
        t.StructField("source_ids", STRINGS),
        t.StructField("confidence", t.StringType()),
    ]
)
RISK = t.StructType(
    [
        t.StructField("risk_id", t.StringType()),
        t.StructField("description", t.StringType()),
        t.StructField("summary", t.StringType()),
        t.StructField("title", t.StringType()),
        t.StructField("source_ids", STRINGS),
        t.StructField("risk_type", t.StringType()),
        t.StructField("severity", t.StringType()),
    ]
)
SOURCE = t.StructType(
    [
        t.StructField("source_id", t.StringType()),
        t.StructField("id", t.StringType()),
        t.StructField("title", t.StringType()),
        t.StructField("url", t.StringType()),
        t.StructField("published_at", t.StringType()),
        t.StructField("source_type", t.StringType()),
        t.StructField("summary", t.StringType()),
    ]
)
SECTION = t.StructType(
    [
        t.StructField("project_id", t.StringType()),
        t.StructField("section_id", t.StringType()),
        t.StructField("title", t.StringType()),
        t.StructField("summary", t.StringType()),
        t.StructField("body", t.StringType()),
        t.StructField("key_findings", t.ArrayType(FINDING)),
        t.StructField("risks", t.ArrayType(RISK)),
        t.StructField("sources", t.ArrayType(SOURCE)),
    ]
)

GOLD_CONTEXT = t.StructType(
    [t.StructField(n, t.StringType()) for n in ("chunk_id", "file_title", "section_title", "content")]
)
GOLD_COLUMNS = (
    "case_id",
    "user_input",
    "reference",
    "gold_contexts_json",
    "must_hit_chunk_ids_json",
    "answerable",
    "split",
    "review_status",
    "notes",
)
