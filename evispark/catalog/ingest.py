"""Metadata, chunk identity, chunk table and its maintenance over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.catalog import views as V
from evispark.catalog.registry import query
from evispark.catalog.sqltext import SPACE, collapse, strip
from evispark.functions import arrays as A
from evispark.functions import text as T
from evispark.operators import chunk_table as K
from evispark.operators import chunks as C
from evispark.operators import metadata as M
from evispark.operators import rules
from evispark.session import table


@query(
    "markdown_load",
    "S2",
    f"""SELECT doc_id, replace(replace(ltrim(raw, '\ufeff'), E'\\r\\n', E'\\n'), E'\\r', E'\\n') AS md,
              CASE WHEN source = 'src2' THEN '未命名文档' ELSE source || '-' || doc_id END AS file_title
        FROM (SELECT doc_id, source, CASE WHEN source = 'src4' THEN '  ' ELSE '\ufeff\ufeff' || replace(text, '. ', E'.\\r\\n') || E'\\r' END AS raw FROM documents)
        WHERE {strip('raw')} <> ''""",
)
def markdown_load(spark, sf):
    from evispark.sources.documents import load_markdown

    raw = F.when(F.col("source") == "src4", F.lit("  ")).otherwise(
        F.concat(F.lit("\ufeff\ufeff"), F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit("\r"))
    )
    docs = table(spark, sf, "documents").select(
        "doc_id",
        raw.alias("md_content"),
        F.when(F.col("source") != "src2", F.concat_ws("-", "source", F.col("doc_id").cast("string"))).alias("file_title"),
        F.lit("").alias("path"),
    )
    return load_markdown(docs).select("doc_id", F.col("md_content").alias("md"), "file_title")


# Raw metadata: word lists cut from the text, so they hold blanks, repeats and over-long items.
RAW_META_SQL = """raw_meta AS (
  SELECT doc_id, lang, source, split(replace(text, E'\\n', ' , '), ' ') AS words,
    CASE WHEN doc_id % 9 = 4 THEN repeat('y', 200) ELSE 'k' END AS odd,
    CASE WHEN source = 'src9' THEN '小说' ELSE ' 标准 ' END AS document_type,
    CASE WHEN doc_id % 5 = 0 THEN ['全国', source] WHEN doc_id % 5 = 1 THEN ['不限', ' 不限 '] WHEN doc_id % 5 = 2 THEN [' ', ''] ELSE [source, lang, source] END AS regions
  FROM documents)"""


def raw_metadata(spark, sf):
    d, source = F.col("doc_id"), F.col("source")
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" , ")), " ")
    odd = F.when(d % 9 == 4, F.lit("y" * 200)).otherwise(F.lit("k"))
    regions = (
        F.when(d % 5 == 0, F.array(F.lit("全国"), source))
        .when(d % 5 == 1, F.array(F.lit("不限"), F.lit(" 不限 ")))
        .when(d % 5 == 2, F.array(F.lit(" "), F.lit("")))
        .otherwise(F.array(source, F.col("lang"), source))
    )
    raw = F.struct(
        F.when(source == "src9", F.lit("小说")).otherwise(F.lit(" 标准 ")).alias("document_type"),
        regions.alias("region_names"),
        F.concat(F.array("lang"), words).alias("topics"),
        F.concat(words, F.array(odd)).alias("keywords"),
    )
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw"))


def _unique_cte(name: str, source: str, values: str, n: int) -> str:
    """Ordered distinct list: items by their first position, the first ``n`` of them."""
    return f"""{name} AS (SELECT doc_id, list(x ORDER BY pos) AS v FROM (
      SELECT doc_id, x, min(pos) AS pos FROM (SELECT doc_id, {collapse('raw')} AS x, pos FROM (
        SELECT doc_id, unnest({values}) AS raw, unnest(range(len({values}))) AS pos FROM {source})) WHERE x <> '' GROUP BY doc_id, x
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) <= {n}) GROUP BY doc_id)"""


TOPICS = _unique_cte("t", "raw_meta", "([lang] || words)", 5)
KEYWORDS = _unique_cte("k", "raw_meta", "(words || [odd])", 10)
REGIONS = _unique_cte("r", "raw_meta", "regions", 8)


@query(
    "ordered_unique_strings",
    "P1,P2",
    f"""WITH {RAW_META_SQL}, {TOPICS}, {KEYWORDS} SELECT doc_id, array_to_string(coalesce(t.v, []), '|') AS topics, array_to_string(coalesce(k.v, []), '|') AS keywords
        FROM raw_meta LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)""",
)
def ordered_unique_strings(spark, sf):
    raw = F.col("raw")
    return raw_metadata(spark, sf).select(
        "doc_id",
        A.join(A.ordered_unique(raw["topics"], 5)).alias("topics"),
        A.join(A.ordered_unique(raw["keywords"], 10)).alias("keywords"),
    )


@query(
    "metadata_normalisation",
    "P3",
    f"""WITH {RAW_META_SQL}, {TOPICS}, {KEYWORDS}, {REGIONS}
        SELECT doc_id, trim(document_type) AS document_type, array_to_string(coalesce(r.v, []), '|') AS region_names, array_to_string(coalesce(t.v, []), '|') AS topics,
               array_to_string(list_filter(coalesce(k.v, []), lambda x: NOT list_contains(coalesce(t.v, []), x)), '|') AS keywords
        FROM raw_meta LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)""",
)
def metadata_normalisation(spark, sf):
    out = raw_metadata(spark, sf).select("doc_id", M.normalise_metadata(F.col("raw")).alias("m"))
    return out.select(
        "doc_id", "m.document_type", *[A.join(F.col(f"m.{f}")).alias(f) for f in ("region_names", "topics", "keywords")]
    )


@query(
    "metadata_rejects",
    "P3,P4,P1",
    f"""WITH {RAW_META_SQL}, {REGIONS}, n AS (SELECT doc_id, source, odd, coalesce(r.v, []) AS r, len(list_filter(words, lambda x: len({collapse('x')}) > 128)) > 0 AS long
              FROM raw_meta LEFT JOIN r USING (doc_id))
        SELECT doc_id, 'document_type_unknown' AS reason FROM n WHERE source = 'src9'
        UNION ALL SELECT doc_id, 'keywords_item_too_long' FROM n WHERE len(odd) > 128 OR long
        UNION ALL SELECT doc_id, 'topics_item_too_long' FROM n WHERE long
        UNION ALL SELECT doc_id, 'region_names_empty' FROM n WHERE len(r) = 0
        UNION ALL SELECT doc_id, 'region_names_exclusive' FROM n WHERE len(r) > 1 AND (list_contains(r, '全国') OR list_contains(r, '不限'))""",
)
def metadata_rejects(spark, sf):
    return rules.rejects(raw_metadata(spark, sf), ["doc_id"], M.metadata_rules(F.col("raw")))


@query(
    "exclusive_regions",
    "P4",
    f"""WITH {RAW_META_SQL}, {REGIONS}
        SELECT doc_id, len(coalesce(r.v, [])) > 1 AND (list_contains(r.v, '全国') OR list_contains(r.v, '不限')) AS conflict FROM raw_meta LEFT JOIN r USING (doc_id)""",
)
def exclusive_regions(spark, sf):
    regions = A.ordered_unique(F.col("raw.region_names"), M.REGIONS_MAX)
    return raw_metadata(spark, sf).select("doc_id", M.exclusive_region_conflict(regions).alias("conflict"))


@query(
    "document_ids",
    "P5,X20",
    f"""SELECT doc_id, CASE WHEN source = 'src1' THEN sha256('explicit' || doc_id) WHEN source = 'src2' THEN sha256(lower({collapse("lang || '  ' || source || ' ' || doc_id")}))
            ELSE sha256('filename:' || lower(source || '-' || doc_id || '.MD')) END AS document_id FROM documents""",
)
def document_ids(spark, sf):
    s, d = F.col("source"), F.col("doc_id").cast("string")
    explicit = F.when(s == "src1", F.upper(F.sha2(F.concat(F.lit("explicit"), d), 256)))
    path = F.when(~s.isin("src1", "src2"), F.concat(F.lit("/in/2024/"), s, F.lit("-"), d, F.lit(".MD")))
    title = F.concat("lang", F.lit("  "), s, F.lit(" "), d)
    return table(spark, sf, "documents").select("doc_id", C.document_id(explicit, path, title).alias("document_id"))


_FOLD_SQL = "replace(replace(replace(lower(replace(replace({}, 'İ', 'i̇'), 'Σ', 'ς')), 'ß', 'ss'), 'ς', 'σ'), 'ﬁ', 'fi')"


@query(
    "folded_document_ids",
    "P5,X20",
    f"""WITH t AS (SELECT doc_id, source, {collapse("['STRASSE ', 'Straße ', 'ΣΟΦΟΣ ', 'İZ ', 'oﬁce '][doc_id % 5 + 1] || left(text, 40)")} AS title FROM documents)
        SELECT doc_id, CASE WHEN source = 'src1' THEN sha256({_FOLD_SQL.format("title")}) ELSE sha256('filename:' || {_FOLD_SQL.format("replace(title, '/', ' ') || '.MD'")}) END AS document_id FROM t""",
)
def folded_document_ids(spark, sf):
    """Ids from titles and file names whose letters fold to several or to other ones than their lower case."""
    begin = F.get(F.array(*(F.lit(x) for x in ("STRASSE ", "Straße ", "ΣΟΦΟΣ ", "İZ ", "oﬁce "))), (F.col("doc_id") % 5).cast("int"))
    title = T.collapse(F.concat(begin, F.left("text", F.lit(40))))
    path = F.when(F.col("source") != "src1", F.concat(F.lit("/in/"), F.replace(title, F.lit("/"), F.lit(" ")), F.lit(".MD")))
    return table(spark, sf, "documents").select("doc_id", C.document_id(F.lit(None).cast("string"), path, title).alias("document_id"))


@query(
    "metadata_context",
    "P6",
    "SELECT doc_id, left(replace(replace(ltrim(text, '\ufeff'), E'\\r\\n', E'\\n'), E'\\r', E'\\n'), 10000) AS context FROM documents",
)
def metadata_context(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.metadata_context(F.col("text")).alias("context"))


@query(
    "metadata_push_down",
    "P7",
    f"""WITH {V.CHUNKS_SQL} SELECT chunk_id, document_type, region, doc_id % 6 = 1 AND chunk_index = 0 AND document_type <> '其他' AS conflict FROM chunks""",
)
def metadata_push_down(spark, sf):
    own = F.when((F.col("doc_id") % 6 == 1) & (F.col("chunk_index") == 0), F.lit("其他")).when(
        F.col("doc_id") % 6 == 2, F.lit("")
    )
    chunks = V.document_chunks(spark, sf).select(
        "document_id", "chunk_id", "chunk_index", "doc_id", own.alias("document_type")
    )
    metadata = V.documents_with_metadata(spark, sf).select("document_id", "document_type", "region")
    return M.apply_metadata(chunks, metadata, ("document_type", "region")).select(
        "chunk_id", "document_type", "region", "conflict"
    )


@query(
    "fixed_window_chunks",
    "C13",
    f"WITH {V.CHUNKS_SQL} SELECT chunk_id, document_id, chunk_index, content FROM chunks",
)
def fixed_window_chunks(spark, sf):
    return V.document_chunks(spark, sf).select("chunk_id", "document_id", "chunk_index", "content")


@query(
    "chunk_finalisation",
    "C11,X1,X20",
    rf"""WITH {V.CHUNKS_SQL}, k AS (SELECT *, {strip('content')} AS c FROM chunks),
         o AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1)::INT AS ordinal FROM k WHERE c <> '')
        SELECT sha256(document_id || '|' || ordinal) AS chunk_id, document_id, ordinal AS chunk_index,
               len(regexp_extract_all(c, '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+|[^{SPACE}]'))::INT AS token_count,
               file_title || E'\n' || lang || E'\n' || document_type || E'\n' || region || E'\n' || source || '、' || lang || E'\n' || c AS embedding_text FROM o""",
)
def chunk_finalisation(spark, sf):
    from evispark.operators.chunking import finalised

    blocks = V.document_chunks(spark, sf).select(
        "document_id",
        F.col("chunk_index").alias("block_index"),
        "content",
        F.lit("text").alias("context_type"),
        "file_title",
        F.col("lang").alias("section_title"),
        "document_type",
        F.array("region").alias("region_names"),
        F.array("source", "lang").alias("topics"),
        F.array().cast("array<string>").alias("keywords"),
    )
    return finalised(blocks).select("chunk_id", "document_id", "chunk_index", "token_count", "embedding_text")


@query(
    "chunk_statistics",
    "C12",
    rf"""WITH {V.CHUNKS_SQL}, k AS (SELECT document_id, CASE chunk_index % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'code' END AS t,
            len(regexp_extract_all(content, '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+|[^{SPACE}]')) AS n FROM chunks)
        SELECT document_id, count(*) AS n_chunks, count(*) FILTER (WHERE t = 'text') AS n_text, count(*) FILTER (WHERE t = 'table') AS n_table,
               count(*) FILTER (WHERE t = 'code') AS n_code, sum(n)::BIGINT AS n_tokens FROM k GROUP BY document_id""",
)
def chunk_statistics(spark, sf):
    i = F.col("chunk_index")
    kind = F.when(i % 3 == 0, F.lit("text")).when(i % 3 == 1, F.lit("table")).otherwise(F.lit("code"))
    chunks = V.document_chunks(spark, sf).select(
        "document_id", kind.alias("context_type"), T.token_estimate(F.col("content")).alias("token_count")
    )
    return C.chunk_statistics(chunks)


def full_chunks(spark, sf, flawed: bool):
    """Contract-shaped rows joined with the vectors; flaws are put in by row position when asked."""
    d, i = F.col("doc_id"), F.col("chunk_index")
    bad = lambda cond, value, good: F.when(F.lit(flawed) & cond, value).otherwise(good)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id"), F.col("embedding"))
    size = vectors.agg(F.count("*").alias("n_vectors"))
    rows = V.document_chunks(spark, sf).join(F.broadcast(size)).withColumn("vec_id", d % F.col("n_vectors")).join(vectors, "vec_id")
    sparse = F.map_from_arrays(F.array(F.lit(1), F.lit(10)), F.array(F.lit(0.5), F.lit(0.2))).cast("map<int,float>")
    return rows.select(
        bad(d % 50 == 7, F.substring("chunk_id", 1, 63), F.col("chunk_id")).alias("chunk_id"),
        "document_id",
        bad(d % 50 == 8, F.lit(-1), i).alias("chunk_index"),
        bad(d % 50 == 9, F.lit(" "), F.col("file_title")).alias("file_title"),
        F.col("lang").alias("section_title"),
        F.concat(F.lit(" x"), "content").alias("content"),
        bad(d % 50 == 10, F.lit("image"), F.lit("text")).alias("context_type"),
        bad(d % 50 == 11, F.array().cast("array<string>"), F.array(F.concat(F.lit(" "), "region"))).alias("region_names"),
        bad(d % 50 == 12, F.lit("other"), F.col("document_type")).alias("document_type"),
        bad(d % 50 == 13, F.array_repeat(F.lit("t"), 6), F.array("source")).alias("topics"),
        bad(d % 50 == 14, F.array(F.lit("k"), F.lit("")), F.array("lang")).alias("keywords"),
        T.token_estimate(F.col("content")).alias("token_count"),
        bad(d % 50 == 15, F.slice("embedding", 1, 10), F.col("embedding")).alias("dense_vector"),
        bad(d % 50 == 16, F.map_from_arrays(F.array(F.lit(-1)), F.array(F.lit(0.5))).cast("map<int,float>"), sparse).alias("sparse_vector"),
    )


FLAWS = {
    7: "chunk_id_format",
    8: "chunk_index_negative",
    9: "file_title_empty",
    10: "context_type_unknown",
    11: "region_names_empty",
    12: "document_type_unknown",
    13: "topics_size",
    14: "keywords_item",
    15: "dense_vector_dimension",
    16: "sparse_vector_entry",
}


@query(
    "chunk_validation",
    "P12,V2",
    f"""WITH {V.CHUNKS_SQL}, r AS (SELECT doc_id % 50 AS m, count(*) AS n FROM chunks JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings) GROUP BY 1)
        SELECT CASE m {' '.join(f"WHEN {k} THEN '{v}'" for k, v in FLAWS.items())} END AS reason, n FROM r WHERE m BETWEEN 7 AND 16""",
)
def chunk_validation(spark, sf):
    found = rules.rejects(full_chunks(spark, sf, flawed=True), ["chunk_id"], K.chunk_rules(dim=64))
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "chunk_contract_projection",
    "P13",
    f"""WITH {V.CHUNKS_SQL} SELECT chunk_id, document_id, chunk_index, file_title, lang AS section_title, {strip("'x' || content")} AS content, 'text' AS context_type,
          region AS region_names, document_type, source AS topics, lang AS keywords, 64 AS n_dense, 2 AS n_sparse FROM chunks JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)""",
)
def chunk_contract_projection(spark, sf):
    wide = full_chunks(spark, sf, flawed=False).withColumn("embedding_text", F.lit("dropped"))
    out = K.contract_projection(rules.valid(wide, K.chunk_rules(dim=64)))
    return out.select(
        "chunk_id",
        "document_id",
        "chunk_index",
        "file_title",
        "section_title",
        "content",
        "context_type",
        A.join(F.col("region_names")).alias("region_names"),
        "document_type",
        A.join(F.col("topics")).alias("topics"),
        A.join(F.col("keywords")).alias("keywords"),
        F.size("dense_vector").alias("n_dense"),
        F.size("sparse_vector").alias("n_sparse"),
    )


@query(
    "chunk_batch_rules",
    "P14",
    """WITH c AS (SELECT l_orderkey AS document_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_linenumber - 1 AS i FROM lineitem),
       r AS (SELECT document_id, count(*) AS repeated_ids FROM (SELECT document_id, chunk_id FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY document_id)
       SELECT document_id, count(*) AS n_chunks, coalesce(max(repeated_ids), 0) AS repeated_ids, 0 AS shared_ids,
              min(i) <> 0 OR max(i) <> count(*) - 1 OR count(DISTINCT i) <> count(*) AS index_gap FROM c LEFT JOIN r USING (document_id) GROUP BY document_id""",
)
def chunk_batch_rules(spark, sf):
    chunks = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
        (F.col("l_linenumber") - 1).alias("chunk_index"),
    )
    return K.batch_problems(chunks)


# A re-import: some documents come again with their last chunk gone and their first chunk edited.
IMPORT_SQL = (
    V.CHUNKS_SQL
    + """, last_chunk AS (SELECT document_id, max(chunk_index) AS top FROM chunks GROUP BY document_id),
  incoming AS (SELECT c.chunk_id, c.document_id, c.chunk_index, 'new ' || content AS content FROM chunks c JOIN last_chunk USING (document_id)
               WHERE lang = 'en' AND (chunk_index < top OR top = 0)),
  target AS (SELECT chunk_id, document_id, chunk_index, content FROM chunks)"""
)


def import_batch(spark, sf):
    chunks = V.document_chunks(spark, sf).select("chunk_id", "document_id", "chunk_index", "content", "lang")
    tops = chunks.groupBy("document_id").agg(F.max("chunk_index").alias("top"))
    incoming = (
        chunks.join(tops, "document_id")
        .where((F.col("lang") == "en") & ((F.col("chunk_index") < F.col("top")) | (F.col("top") == 0)))
        .select("chunk_id", "document_id", "chunk_index", F.concat(F.lit("new "), "content").alias("content"))
    )
    return chunks.drop("lang"), incoming


@query(
    "chunk_table_replacement",
    "S4",
    f"""WITH {IMPORT_SQL} SELECT * FROM target WHERE document_id NOT IN (SELECT document_id FROM incoming) UNION ALL SELECT * FROM incoming""",
)
def chunk_table_replacement(spark, sf):
    return K.replaced(*import_batch(spark, sf))


@query(
    "existing_chunk_ids",
    "S5",
    f"WITH {IMPORT_SQL} SELECT DISTINCT document_id, chunk_id FROM target WHERE document_id IN (SELECT document_id FROM incoming)",
)
def existing_chunk_ids(spark, sf):
    return K.existing_ids(*import_batch(spark, sf))


@query(
    "stale_chunk_ids",
    "J1,S4",
    f"""WITH {IMPORT_SQL} SELECT DISTINCT document_id, chunk_id FROM target WHERE document_id IN (SELECT document_id FROM incoming)
        AND chunk_id NOT IN (SELECT chunk_id FROM incoming)""",
)
def stale_chunk_ids(spark, sf):
    return K.stale_ids(*import_batch(spark, sf)).select("document_id", "chunk_id")


MARKDOWN_SQL = r"""md AS (SELECT doc_id, source, lang, '# ' || source || E'\n' || replace(text, E'\n', E'\n\n## ' || lang || E' ##\n') AS md FROM documents)"""


def markdown_documents(spark, sf):
    """Every line of a document below its own heading."""
    heading = F.concat(F.lit("\n\n## "), "lang", F.lit(" ##\n"))
    return V.documents_with_metadata(spark, sf).select(
        "doc_id",
        "document_id",
        "file_title",
        "document_type",
        F.array("region").alias("region_names"),
        F.array("source").alias("topics"),
        F.array("lang").alias("keywords"),
        F.concat(F.lit("# "), "source", F.lit("\n"), F.replace("text", F.lit("\n"), heading)).alias("md_content"),
    ).repartition("doc_id")


@query(
    "heading_sections",
    "C1,X3",
    rf"""WITH {MARKDOWN_SQL}, l AS (SELECT doc_id, source, lang, unnest(split(md, E'\n')) AS line, unnest(range(len(split(md, E'\n')))) AS n FROM md),
         s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*#{{1,6}}\s+.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l),
         b AS (SELECT doc_id, any_value(source) AS source, any_value(lang) AS lang, sec, {strip("string_agg(line, E'\\n' ORDER BY n)")} AS content FROM s GROUP BY doc_id, sec)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INT AS block_index, content,
               CASE WHEN sec = 1 THEN source ELSE source || '/' || lang END AS section_path, CASE WHEN sec = 1 THEN source ELSE lang END AS section_title FROM b""",
)
def heading_sections(spark, sf):
    from evispark.operators.chunking import heading_sections as sections

    return sections(markdown_documents(spark, sf)).select(
        "doc_id", "block_index", "content", A.join(F.col("section_path"), "/").alias("section_path"), "section_title"
    )


def import_inputs(spark, sf):
    """Documents to import; by number, some have a title or a heading that is too long."""
    d = F.col("doc_id")
    long = F.array_join(F.array_repeat(F.lit("x"), 600), "")
    return markdown_documents(spark, sf).select(
        F.concat(F.lit("/in/"), "file_title", F.lit(".md")).alias("path"),
        F.when(d % 50 == 7, long).otherwise(F.col("file_title")).alias("file_title"),
        F.when(d % 50 == 8, F.concat("md_content", F.lit("\n\n# "), long, F.lit("\ntext"))).otherwise(F.col("md_content")).alias("md_content"),
    )


@query(
    "import_outcome",
    "S4,P12,P14,T5,U3",
    """SELECT '/in/' || source || '-' || doc_id || '.md' AS path, doc_id % 50 NOT IN (7, 8) AS accepted,
         CASE doc_id % 50 WHEN 7 THEN 'file_title_too_long' WHEN 8 THEN 'section_title_too_long' ELSE '' END AS reasons FROM documents""",
)
def import_outcome(spark, sf):
    """Of each document of a batch, whether the import takes it, and why not."""
    from evispark.plans.ingest import judged_records

    _, outcome = judged_records(import_inputs(spark, sf))
    title = F.filter("reasons", lambda r: (r == "file_title_too_long") | ~F.array_contains("reasons", "file_title_too_long"))
    return outcome.select("path", "accepted", F.array_join(title, ",").alias("reasons"))
