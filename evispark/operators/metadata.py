"""Document metadata: normal form, rules, and the push-down to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark import schemas
from evispark.functions import arrays as A
from evispark.functions import text as T

# Fixed values.
DOCUMENT_TYPES = ("政策", "标准", "规划", "技术文件", "其他")
EXCLUSIVE_REGIONS = ("全国", "不限")
REGIONS_MAX, TOPICS_MAX, KEYWORDS_MAX = 8, 5, 10
ITEM_MAX_CHARS = 128
CONTEXT_MAX_CHARS = 10_000
ID_PATTERN = "^[0-9a-f]{64}$"


def plain_newlines(text: Column) -> Column:
    """No leading byte-order marks, line feeds only."""
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff+", ""), "\r\n?", "\n")


def metadata_context(text: Column) -> Column:
    """What a metadata model gets to read."""
    return F.substring(plain_newlines(text), 1, CONTEXT_MAX_CHARS)


def normalise_metadata(raw: Column) -> Column:
    """Unknown fields are not in the schema; keywords lose what is already a topic after their own cap."""
    topics = A.ordered_unique(raw["topics"], TOPICS_MAX)
    return F.struct(
        T.first_text(raw["document_type"]).alias("document_type"),
        A.ordered_unique(raw["region_names"], REGIONS_MAX).alias("region_names"),
        topics.alias("topics"),
        A.without(A.ordered_unique(raw["keywords"], KEYWORDS_MAX), topics).alias("keywords"),
    )


def exclusive_region_conflict(regions: Column) -> Column:
    special = F.lit(False)
    for value in EXCLUSIVE_REGIONS:
        special = special | F.array_contains(regions, value)
    return special & (F.size(regions) > 1)


def metadata_rules(raw: Column) -> list[tuple[str, Column]]:
    regions = A.ordered_unique(raw["region_names"], REGIONS_MAX)
    rules = [("document_type_unknown", ~T.first_text(raw["document_type"]).isin(*DOCUMENT_TYPES))]
    for field in ("region_names", "topics", "keywords"):
        rules.append((f"{field}_missing", raw[field].isNull()))
        rules.append((f"{field}_item_null", F.coalesce(F.exists(raw[field], lambda x: x.isNull()), F.lit(False))))
        rules.append((f"{field}_item_too_long", F.coalesce(A.too_long(raw[field], ITEM_MAX_CHARS), F.lit(False))))
    rules.append(("region_names_empty", raw["region_names"].isNotNull() & (F.size(regions) == 0)))
    rules.append(("region_names_exclusive", exclusive_region_conflict(regions)))
    return rules


def parse_model_json(answer: Column, schema=schemas.DOCUMENT_METADATA) -> Column:
    """Model text to a struct; null when there is no JSON object in it."""
    return F.from_json(F.nullif(T.json_object_text(answer), F.lit("")), schema)


def apply_metadata(chunks: DataFrame, metadata: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Chunks with their document's fields; a chunk whose own non-empty value differs is marked a conflict."""
    renamed = metadata.select("document_id", *[F.col(f).alias(f"_m_{f}") for f in fields])
    joined = chunks.join(renamed, "document_id")
    conflict = F.lit(False)
    for f in fields:
        if f in chunks.columns:
            own = F.col(f)
            blank = own.isNull() | (own.cast("string").isin("", "[]"))
            conflict = conflict | (~blank & ~own.eqNullSafe(F.col(f"_m_{f}")))
    out = joined.withColumn("conflict", conflict)
    for f in fields:
        out = out.withColumn(f, F.col(f"_m_{f}"))
    return out.drop(*[f"_m_{f}" for f in fields])
