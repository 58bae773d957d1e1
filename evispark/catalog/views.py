"""Domain-shaped inputs derived from the given tables, on the Spark side and as SQL for the check."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import chunks as C
from evispark.session import table

# Document types.
DOCUMENT_TYPES = ("政策", "标准", "规划", "技术文件", "其他")

DOC_META_SQL = """doc_meta AS (
  SELECT doc_id, text, lang, source, source || '-' || doc_id AS file_title,
         sha256('filename:' || lower(source || '-' || doc_id || '.md')) AS document_id,
         CASE lang WHEN 'en' THEN '政策' WHEN 'fr' THEN '标准' WHEN 'de' THEN '规划' WHEN 'es' THEN '技术文件' ELSE '其他' END AS document_type,
         CASE WHEN source IN ('src0', 'src1') THEN '全国' ELSE source END AS region
  FROM documents)"""

CHUNKS_SQL = (
    DOC_META_SQL
    + """, chunks AS (
  SELECT sha256(document_id || '|' || i) AS chunk_id, document_id, i::INT AS chunk_index, file_title,
         substring(text, (i * 570 + 1)::BIGINT, 600) AS content, document_type, region, lang, source, doc_id
  FROM (SELECT *, unnest(range(0, greatest(1, ceil((len(text) - 30) / 570.0))::BIGINT)) AS i FROM doc_meta))"""
)


def documents_with_metadata(spark, sf):
    """One row per document with its id and filter fields."""
    lang, source = F.col("lang"), F.col("source")
    kind = (
        F.when(lang == "en", F.lit("政策"))
        .when(lang == "fr", F.lit("标准"))
        .when(lang == "de", F.lit("规划"))
        .when(lang == "es", F.lit("技术文件"))
        .otherwise(F.lit("其他"))
    )
    title = F.concat_ws("-", "source", F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id",
        "text",
        "lang",
        "source",
        title.alias("file_title"),
        C.document_id_from_name(F.concat(title, F.lit(".md"))).alias("document_id"),
        kind.alias("document_type"),
        F.when(source.isin("src0", "src1"), F.lit("全国")).otherwise(source).alias("region"),
    )


def document_chunks(spark, sf):
    """Fixed-size windows of every document."""
    return C.fixed_windows(documents_with_metadata(spark, sf)).withColumn(
        "chunk_id", C.chunk_id(F.col("document_id"), F.col("chunk_index"))
    )


# Ranked candidate lists: a supplier is a query, its lines are hits of two retrieval arms.
LISTS_SQL = """arm_lists AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey,
                                 l_quantity, l_discount, l_tax, l_shipdate, l_returnflag)::INT AS rank
    FROM (SELECT l_suppkey AS query_id, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS list_no,
                 CASE WHEN l_linestatus = 'F' THEN 'embedding' ELSE 'hyde' END AS layer,
                 'p' || (l_partkey % 97) AS chunk_id, 'd' || (l_partkey % 7) AS document_id,
                 round(l_extendedprice / 110000.0::DOUBLE, 3) AS score, l.* FROM lineitem l)))"""


def arm_lists(spark, sf):
    """All hits of each arm per query, ranked; parts recur, so lists hold duplicates and ties."""
    from evispark.operators.ranking import ranked

    first = F.col("l_linestatus") == "F"
    # Scaled before it is rounded, as the SQL does: rounding the decimal text of a price on a half goes the other way.
    score = F.round(F.col("l_extendedprice") / 110000.0 * 1000) / 1000
    hits = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"),
        F.when(first, 0).otherwise(1).alias("list_no"),
        F.when(first, F.lit("embedding")).otherwise(F.lit("hyde")).alias("layer"),
        F.concat(F.lit("p"), F.col("l_partkey") % 97).alias("chunk_id"),
        F.concat(F.lit("d"), F.col("l_partkey") % 7).alias("document_id"),
        score.alias("score"),
        *"l_orderkey l_linenumber l_partkey l_quantity l_discount l_tax l_shipdate l_returnflag".split(),
    )
    order = [F.desc("score")] + [
        F.asc(c)
        for c in "l_orderkey l_linenumber l_partkey l_quantity l_discount l_tax l_shipdate l_returnflag".split()
    ]
    return ranked(hits, ["query_id", "list_no"], order)


def as_text(c):
    return T.strip(F.coalesce(c.cast("string"), F.lit("")))
