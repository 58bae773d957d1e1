"""The chunk table: row rules, batch rules, schema gate, idempotent replacement."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from evispark import schemas
from evispark.functions import arrays as A
from evispark.functions import text as T
from evispark.operators import ledger
from evispark.operators.metadata import DOCUMENT_TYPES, ID_PATTERN
from evispark.session import cut_lineage

# Fixed values.
TITLE_MAX, CONTENT_MAX, ITEM_MAX = 512, 65535, 128
REGIONS_MAX, TOPICS_MAX, KEYWORDS_MAX = 8, 5, 10
CONTEXT_TYPES = ("text", "table", "code")
VECTOR_DIM = 1024


def _text_rules(field: str, limit: int) -> list[tuple[str, Column]]:
    value = T.first_text(F.col(field))
    return [(f"{field}_empty", value == ""), (f"{field}_too_long", F.length(value) > limit)]


def _array_rules(field: str, limit: int) -> list[tuple[str, Column]]:
    values = F.col(field)
    bad_item = F.exists(values, lambda x: x.isNull() | (T.strip(x) == "") | (F.length(T.strip(x)) > ITEM_MAX))
    return [
        (f"{field}_size", values.isNull() | (F.size(values) > limit)),
        (f"{field}_item", F.coalesce(bad_item, F.lit(False))),
    ]


def vector_rules(dim: int = VECTOR_DIM) -> list[tuple[str, Column]]:
    dense, sparse = F.col("dense_vector"), F.col("sparse_vector")
    return [
        ("dense_vector_dimension", dense.isNull() | (F.size(dense) != dim)),
        ("dense_vector_value", ~A.all_finite(dense)),
        ("sparse_vector_missing", sparse.isNull()),
        (
            "sparse_vector_entry",
            sparse.isNotNull()
            & ~(F.forall(F.map_keys(sparse), lambda k: k >= 0) & A.all_finite(F.map_values(sparse))),
        ),
    ]


def chunk_rules(dim: int = VECTOR_DIM) -> list[tuple[str, Column]]:
    rules = [
        ("chunk_id_format", ~F.rlike(T.first_text(F.col("chunk_id")), F.lit(ID_PATTERN))),
        ("document_id_format", ~F.rlike(T.first_text(F.col("document_id")), F.lit(ID_PATTERN))),
    ]
    for field, limit in (("file_title", TITLE_MAX), ("section_title", TITLE_MAX), ("content", CONTENT_MAX)):
        rules += _text_rules(field, limit)
    rules += [
        ("context_type_unknown", ~T.first_text(F.col("context_type")).isin(*CONTEXT_TYPES)),
        ("document_type_unknown", ~T.first_text(F.col("document_type")).isin(*DOCUMENT_TYPES)),
    ]
    for field, limit in (("region_names", REGIONS_MAX), ("topics", TOPICS_MAX), ("keywords", KEYWORDS_MAX)):
        rules += _array_rules(field, limit)
    rules += [
        ("region_names_empty", F.size(F.coalesce("region_names", F.array().cast("array<string>"))) == 0),
        ("chunk_index_negative", F.col("chunk_index").isNull() | (F.col("chunk_index") < 0)),
        ("token_count_negative", F.col("token_count").isNull() | (F.col("token_count") < 0)),
    ]
    return rules + vector_rules(dim)


def contract_projection(df: DataFrame) -> DataFrame:
    """Exactly the contract columns: trimmed texts, cast to the declared types."""
    out = []
    for field in schemas.CHUNK.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, t.StringType):
            c = T.strip(c)
        elif field.dataType == schemas.STRINGS:
            c = F.transform(c, T.strip)
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)


def batch_problems(chunks: DataFrame) -> DataFrame:
    """Per document: are chunk ids unique and ordinals 0..n-1? Aggregates only, no rows collected.

    A chunk id may occur once in the whole batch; ids of two documents that collide show as ``shared``.
    """
    ids = chunks.groupBy("chunk_id").agg(
        F.count("*").alias("times"), F.min("document_id").alias("document_id"), F.max("document_id").alias("other")
    )
    repeated = ids.where("times > 1").groupBy("document_id").agg(
        F.count("*").alias("repeated_ids"), F.count_if(F.col("other") != F.col("document_id")).alias("shared_ids")
    )
    spans = chunks.groupBy("document_id").agg(
        F.count("*").alias("n"),
        F.min("chunk_index").alias("low"),
        F.max("chunk_index").alias("high"),
        F.count_distinct("chunk_index").alias("n_index"),
    )
    gap = (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("n_index") != F.col("n"))
    return spans.join(repeated, "document_id", "left").select(
        "document_id",
        F.col("n").alias("n_chunks"),
        F.coalesce("repeated_ids", F.lit(0)).alias("repeated_ids"),
        F.coalesce("shared_ids", F.lit(0)).alias("shared_ids"),
        gap.alias("index_gap"),
    )


def existing_ids(target: DataFrame, documents: DataFrame) -> DataFrame:
    return target.join(documents.select("document_id").distinct(), "document_id", "left_semi").select(
        "document_id", "chunk_id"
    ).distinct()


def stale_ids(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids the table holds for an incoming document that the new version no longer has."""
    return existing_ids(target, incoming).join(incoming.select("chunk_id"), "chunk_id", "left_anti")


def replaced(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after the import: documents of the batch as delivered, all others untouched."""
    kept = target.join(incoming.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(incoming.select(*target.columns))


def with_bucket(chunks: DataFrame, n_buckets: int) -> DataFrame:
    return chunks.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(n_buckets)).cast("int"))


def _stored_buckets(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema("n_buckets int").json(f"{path}/_layout").first()["n_buckets"]
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def check_target(spark: SparkSession, path: str, n_buckets: int) -> DataFrame | None:
    """The table at ``path``, None if there is none. Raises where its columns or its bucket count differ."""
    stored = _stored_buckets(spark, path)
    if stored is not None and stored != n_buckets:
        raise ValueError(f"the table has {stored} buckets, not {n_buckets}")
    target = ledger.if_there(lambda: spark.read.parquet(path))
    if target is None:
        return None
    found = schema_problems(target.schema)
    if found:
        raise ValueError(f"the table differs from the contract: {', '.join(found)}")
    return target


OUTCOME = "document_id string, path string, accepted boolean, reasons array<string>"


def write_replacing(
    spark: SparkSession, incoming: DataFrame, path: str, n_buckets: int = 64, batch_id: str = "", outcome: DataFrame | None = None
) -> None:
    """Replace the documents of ``incoming`` in the table, rewriting only the buckets that they fall into.

    The table is partitioned by a hash bucket of the document id; the touched bucket numbers, no more than ``n_buckets``,
    prune its scan. The new buckets are staged and entered in the ledger before they are swapped in, so a job that fails
    before its entry changes nothing, and one that fails later is completed by the next. A bucket may be written by many
    tasks. ``n_buckets`` is kept beside the table and must not change: choose it so that a bucket stays near a gigabyte.
    """
    target = check_target(spark, path, n_buckets)
    if _stored_buckets(spark, path) is None:
        spark.range(1).select(F.lit(n_buckets).alias("n_buckets")).coalesce(1).write.mode("overwrite").json(f"{path}/_layout")
    ledger.publish(spark, path)
    batch = cut_lineage(with_bucket(incoming, n_buckets))
    touched = [r.bucket for r in batch.select("bucket").distinct().collect()]
    merged = batch
    if target is not None and touched:
        merged = replaced(in_buckets(spark.read.parquet(path), touched), batch)
    if outcome is None:
        outcome = spark.createDataFrame([], OUTCOME)
    ledger.commit(spark, path, batch_id or uuid.uuid4().hex, merged, touched, outcome)


def in_buckets(target: DataFrame, buckets: list[int]) -> DataFrame:
    return target.where(F.col("bucket").isin(buckets))


def schema_problems(actual: t.StructType, contract: t.StructType = schemas.CHUNK) -> list[str]:
    """Differences that make a table unusable for the contract."""
    have = {f.name: f.dataType.simpleString() for f in actual.fields}
    out = [f"missing:{f.name}" for f in contract.fields if f.name not in have]
    out += [f"legacy:{n}" for n in schemas.LEGACY_CHUNK_COLUMNS if n in have]
    out += [
        f"type:{f.name}"
        for f in contract.fields
        if f.name in have and have[f.name] != f.dataType.simpleString()
    ]
    return out


def next_version(name: str) -> str:
    """``x`` -> ``x_v2``, ``x_v2`` -> ``x_v3``."""
    found = re.fullmatch(r"(.+)_v(\d+)", name)
    return f"{found[1]}_v{int(found[2]) + 1}" if found else f"{name}_v2"


def resolve_table(name: str, schema_of) -> str:
    """The table to write: the given one, else its next version; ``schema_of`` returns a schema or None."""
    if not name.strip():
        raise ValueError("table name must not be empty")
    for candidate in (name.strip(), next_version(name.strip())):
        found = schema_of(candidate)
        if found is None or not schema_problems(found):
            return candidate
    raise ValueError(f"{name} and {next_version(name)} both differ from the contract; nothing was changed")
