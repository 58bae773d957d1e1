"""Vector search and fusion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.catalog import views as V
from evispark.catalog.registry import query
from evispark.catalog.sqltext import SPACE, strip
from evispark.operators import config as S
from evispark.operators import embedding as E
from evispark.operators import fusion
from evispark.operators import retrieval as R
from evispark.operators.ranking import ranked
from evispark.plans import answering, hybrid
from evispark.session import table

POSTINGS_SQL = r"""toks AS (
  SELECT chunk_id, term, count(*) AS tf FROM (
    SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS term FROM chunks) GROUP BY ALL),
postings AS (
  SELECT chunk_id, term, (1 + ln(tf)) / sqrt(sum((1 + ln(tf)) * (1 + ln(tf))) OVER (PARTITION BY chunk_id)) AS w FROM toks)"""

FORMS_SQL = r"""forms AS (
  SELECT item_id || '#embedding' AS query_id, text FROM benchmark
  UNION ALL
  SELECT item_id || '#hyde', text || E'\n相关文档可能表述：' || passage FROM (
    SELECT item_id, text, left(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))), ' '), 300) AS passage
    FROM benchmark) WHERE passage <> '')"""

QUERY_WEIGHTS_SQL = r"""qtoks AS (
  SELECT query_id, term, count(*) AS tf FROM (
    SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM forms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings WHERE term IN (SELECT term FROM qtoks) GROUP BY term),
qraw AS (SELECT query_id, term, (1 + ln(tf)) * ln(1 + (SELECT count(*) FROM chunks) / df) AS w FROM qtoks JOIN dfs USING (term)),
qweights AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qraw)"""

SPARSE_SQL = """sparse AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
    SELECT query_id, chunk_id, round(sum(q.w * p.w), 9) AS score FROM qweights q JOIN postings p USING (term) GROUP BY ALL))
  WHERE rank <= 20)"""


def _dense_sql(name: str, postings: str, key: str) -> str:
    return f"""{name}_cells AS (
  SELECT {key}, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS b,
         sum(w * CASE WHEN ('0x' || substr(sha256(term), 9, 1))::BIGINT % 2 = 1 THEN -1.0 ELSE 1.0 END::DOUBLE) AS w
  FROM {postings} GROUP BY ALL),
{name}_unit AS (SELECT {key}, b, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}_cells),
{name} AS (
  SELECT {key}, list(coalesce(w, 0)::FLOAT ORDER BY b) AS v
  FROM (SELECT k.{key}, r.b FROM (SELECT DISTINCT {key} FROM {name}_unit) k, (SELECT unnest(range(64)) AS b) r)
  LEFT JOIN {name}_unit USING ({key}, b) GROUP BY {key})"""


# Sparse vectors as stored: hashed terms with single-precision weights.
SLOTS_SQL = """qunit AS (SELECT query_id, term, (1 + ln(tf)) / sqrt(sum((1 + ln(tf)) * (1 + ln(tf))) OVER (PARTITION BY query_id)) AS w FROM qtoks),
cslots AS (SELECT chunk_id, ('0x' || substr(sha256(term), 1, 7))::BIGINT AS slot, sum(w)::FLOAT AS w FROM postings GROUP BY ALL),
qslots AS (SELECT query_id, ('0x' || substr(sha256(term), 1, 7))::BIGINT AS slot, sum(w)::FLOAT AS w FROM qunit GROUP BY ALL),
sparse AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
    SELECT query_id, chunk_id, round(sum(q.w::DOUBLE * c.w::DOUBLE), 9) AS score FROM qslots q JOIN cslots c USING (slot) GROUP BY ALL))
  WHERE rank <= 20)"""
QTOKS_SQL = QUERY_WEIGHTS_SQL.split("),\ndfs AS")[0] + ")"

DENSE_SQL = (
    "qplain AS (SELECT query_id, term, (1 + ln(tf)) AS w FROM qtoks), "
    + _dense_sql("qdense", "qplain", "query_id")
    + ", "
    + _dense_sql("cdense", "postings", "chunk_id")
    + """, dense AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
    SELECT query_id, chunk_id, round(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]), 9) AS score FROM qdense q, cdense c))
  WHERE rank <= 20)"""
)

HYBRID_SQL = """parts AS (
  SELECT query_id, chunk_id, 0.6::DOUBLE * (0.5 + atan(score) / pi()) AS part FROM dense
  UNION ALL SELECT query_id, chunk_id, 0.4::DOUBLE * (0.5 + atan(score) / pi()) FROM sparse),
hybrid AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
    SELECT query_id, chunk_id, round(sum(part), 9) AS score FROM parts GROUP BY ALL)) WHERE rank <= 10)"""

RRF_SQL = """lists AS (
  SELECT split_part(query_id, '#', 1) AS query_id, split_part(query_id, '#', 2) AS source,
         CASE WHEN query_id LIKE '%#embedding' THEN 0 ELSE 1 END AS list_no, rank, chunk_id,
         CASE WHEN query_id LIKE '%#embedding' THEN 1.0 ELSE 0.8 END::DOUBLE AS weight FROM hybrid),
fused AS (
  SELECT query_id, chunk_id, round(sum(weight / (60 + rank)), 12) AS score, min(list_no * 1000 + rank) AS seen,
         string_agg(source, '+' ORDER BY list_no) AS sources FROM lists GROUP BY ALL),
rrf AS (
  SELECT * FROM (SELECT query_id, chunk_id, score, sources,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank FROM fused) WHERE rank <= 12)"""

FULL_SQL = "WITH " + ", ".join(
    [V.CHUNKS_SQL, POSTINGS_SQL, FORMS_SQL, QTOKS_SQL, SLOTS_SQL, DENSE_SQL, HYBRID_SQL, RRF_SQL]
)


def benchmark_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


@query("hybrid_retrieval", "V5,V6,V7,V8,F1", FULL_SQL + " SELECT query_id, chunk_id, rank, score, sources FROM rrf")
def hybrid_retrieval(spark, sf):
    fused = hybrid.hybrid_retrieval(benchmark_queries(spark, sf), V.document_chunks(spark, sf).repartition("chunk_id"))
    return fused.select("query_id", "chunk_id", "rank", "score", F.array_join("sources", "+").alias("sources"))


# By item number: no filter, a document type, regions with the nationwide one added, both without it.
_ITEM = "split_part(query_id, '#', 1)::INT % 4"
_FILTER_SQL = f"""({_ITEM} <> 1 OR document_type = '政策') AND ({_ITEM} <> 2 OR region IN ('src3', 'src4', '全国'))
  AND ({_ITEM} <> 3 OR (document_type IN ('标准', '规划') AND region IN ('src5', 'src6', 'src7', 'src8')))"""
FILTERED_SQL = FULL_SQL.replace("FROM qdense q, cdense c", f"FROM qdense q, cdense c JOIN chunks USING (chunk_id) WHERE {_FILTER_SQL}").replace(
    "FROM qslots q JOIN cslots c USING (slot)", f"FROM qslots q JOIN cslots c USING (slot) JOIN chunks USING (chunk_id) WHERE {_FILTER_SQL}"
)


@query("filtered_hybrid_retrieval", "P10,J10,V5,V6,V7,V8", FILTERED_SQL + " SELECT query_id, chunk_id, rank, score, sources FROM rrf")
def filtered_hybrid_retrieval(spark, sf):
    """Hard filters of each query restrict both arms before their cut."""
    texts = lambda *values: F.array(*(F.lit(v) for v in values))
    turn = F.col("query_id").cast("int") % 4
    none = F.array().cast("array<string>")
    filters = F.struct(
        F.when(turn == 1, texts("document_types")).when(turn == 2, texts("region_names"))
        .when(turn == 3, texts("document_types", "region_names")).otherwise(none).alias("hard_fields"),
        F.when(turn == 1, texts("政策")).otherwise(texts("标准", "规划")).alias("document_types"),
        F.when(turn == 2, texts("src3", "src4")).otherwise(texts("src5", "src6", "src7", "src8")).alias("region_names"),
        (turn == 3).alias("strict"),
    )
    types, regions = R.hard_filters(filters)
    asked = benchmark_queries(spark, sf).withColumns({"document_types": types, "regions": regions})
    chunks = V.document_chunks(spark, sf).withColumn("region_names", F.array("region")).repartition("chunk_id")
    fused = hybrid.hybrid_retrieval(asked, chunks)
    return fused.select("query_id", "chunk_id", "rank", "score", F.array_join("sources", "+").alias("sources"))


# Settings by item number: the three presets, and options that differ from item to item.
SETTINGS_SQL = """settings AS (
  SELECT item_id::VARCHAR AS item, CASE WHEN m = 3 THEN least(greatest(2 * c, 10), 50) ELSE [20, 12, 40][m + 1] END AS ann_limit,
    CASE WHEN m = 3 THEN c ELSE [10, 6, 20][m + 1] END AS search_top_k,
    CASE WHEN m = 3 THEN [0.35, 0.6, 0.8][item_id % 3 + 1] ELSE 0.6 END::DOUBLE AS wd, CASE WHEN m = 3 THEN [0.65, 0.4, 0.2][item_id % 3 + 1] ELSE 0.4 END::DOUBLE AS ws,
    m <> 3 OR item_id % 8 = 3 AS hyde, CASE WHEN m = 1 THEN 40 ELSE 60 END AS rrf_k,
    CASE WHEN m = 3 THEN [0.4, 0.8, 1.0][item_id // 4 % 3 + 1] ELSE [0.8, 0.4, 1.0][m + 1] END::DOUBLE AS wh,
    CASE WHEN m = 3 THEN least(greatest(r, ceil(c * 6 / 5.0), 5), 30) ELSE [12, 8, 24][m + 1] END AS rrf_top_k
  FROM (SELECT item_id, item_id % 4 AS m, 5 + item_id % 21 AS c, 1 + item_id % 12 AS r FROM benchmark))"""
BY_MODE_SQL = "WITH " + ", ".join(
    [
        V.CHUNKS_SQL, POSTINGS_SQL, SETTINGS_SQL,
        FORMS_SQL.replace("WHERE passage <> ''", "JOIN settings ON item = item_id::VARCHAR WHERE passage <> '' AND hyde"),
        QTOKS_SQL, SLOTS_SQL.replace("rank <= 20", "rank <= 50"), DENSE_SQL.replace("rank <= 20", "rank <= 50"),
        """parts AS (
  SELECT query_id, chunk_id, wd * (0.5 + atan(score) / pi()) AS part FROM dense JOIN settings ON item = split_part(query_id, '#', 1) WHERE rank <= ann_limit
  UNION ALL SELECT query_id, chunk_id, ws * (0.5 + atan(score) / pi()) FROM sparse JOIN settings ON item = split_part(query_id, '#', 1) WHERE rank <= ann_limit),
hybrid AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
    SELECT query_id, chunk_id, round(sum(part), 9) AS score FROM parts GROUP BY ALL)) JOIN settings ON item = split_part(query_id, '#', 1)
  WHERE rank <= search_top_k)""",
        RRF_SQL.replace("ELSE 0.8 END::DOUBLE", "ELSE wh END::DOUBLE").replace("AS weight FROM hybrid", "AS weight, rrf_k, rrf_top_k FROM hybrid")
        .replace("(60 + rank)", "(rrf_k + rank)").replace("min(list_no * 1000 + rank) AS seen,", "min(list_no * 1000 + rank) AS seen, any_value(rrf_top_k) AS top,")
        .replace("SELECT query_id, chunk_id, score, sources,", "SELECT query_id, chunk_id, score, sources, top,").replace("rank <= 12", "rank <= top")
        .replace("FROM lists GROUP BY ALL", "FROM lists GROUP BY query_id, chunk_id"),
    ]
)


def queries_of_every_mode(spark, sf):
    item = F.col("query_id").cast("int")
    of = lambda values, at: F.get(F.array(*(F.lit(v) for v in values)), at)
    options = F.struct(
        (5 + item % 21).alias("candidate_top_k"), (1 + item % 12).alias("max_reference_count"),
        of(("keyword", "balanced", "semantic"), item % 3).alias("matching_preference"), (item % 8 == 3).alias("hyde_enabled"),
        of(("low", "medium", "high"), F.floor(item / 4).cast("int") % 3).alias("hyde_influence"), F.lit(True).alias("web_enabled"),
    )
    mode = of(("balanced", "precision", "recall", "custom"), item % 4)
    return benchmark_queries(spark, sf).withColumn("settings", S.resolve(mode, options))


@query("hybrid_retrieval_by_mode", "P16,V5,V6,V7,V8,F1", BY_MODE_SQL + " SELECT query_id, chunk_id, rank, score, sources FROM rrf")
def hybrid_retrieval_by_mode(spark, sf):
    """Balanced, precision, recall and custom queries in one batch; some custom ones without the second form."""
    fused = hybrid.hybrid_retrieval(queries_of_every_mode(spark, sf), V.document_chunks(spark, sf).repartition("chunk_id"))
    return fused.select("query_id", "chunk_id", "rank", "score", F.array_join("sources", "+").alias("sources"))


_TOKENS = rf"[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+|[^{SPACE}]"
ANSWERS_SQL = BY_MODE_SQL + rf""", chosen AS (
  SELECT item_id::VARCHAR AS query_id, text AS question, [2, 1, 6, least(2, r)][m + 1] AS min_k, [6, 3, 12, r][m + 1] AS max_k, [0.2, 0.1, 0.35, 0.2][m + 1]::DOUBLE AS gap,
    CASE WHEN m = 2 THEN 3 ELSE 2 END AS per_doc, [20000, 12000, 30000, least(greatest(r * 2500, 5000), 30000)][m + 1] AS budget, m <> 1 AS web_on, [5, 3, 8, 5][m + 1] AS web_k
  FROM (SELECT item_id, text, item_id % 4 AS m, 1 + item_id % 12 AS r FROM benchmark)),
hits AS (
  SELECT query_id, 0 AS side, rank, chunk_id AS candidate_id, document_id, 'milvus' AS source, file_title, lang AS section_title, file_title || ' / ' || lang AS display_title,
    {strip("content")} AS content, document_type, region, '' AS url FROM rrf JOIN chunks USING (chunk_id)
  UNION ALL
  SELECT query_id, 1, rank, 'web:' || sha256(url), NULL, 'web', NULL, NULL, url, left(html, 300), NULL, NULL, url
  FROM (SELECT (page_id % 40)::VARCHAR AS query_id, url, html, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id)::INT AS rank FROM pages) JOIN chosen USING (query_id)
  WHERE web_on AND rank <= web_k),
firsts AS (SELECT * FROM hits WHERE source = 'web' OR content <> '' QUALIFY row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY side, rank) = 1),
ups AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY side, rank) AS up FROM firsts),
raw AS (SELECT *, concat_ws(E'\n', nullif({strip("display_title")}, ''), nullif({strip("content")}, '')) AS t FROM ups JOIN chosen USING (query_id)),
fit AS (SELECT *, regexp_extract_all(t, '{_TOKENS}') AS tk, greatest(1, 512 - len(regexp_extract_all(question, '{_TOKENS}')) - 4) AS room FROM raw),
wrd AS (
  SELECT *, list_distinct(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+')) AS a,
    list_distinct(regexp_extract_all(lower(CASE WHEN len(tk) <= room THEN t ELSE array_to_string(tk[1:room], ' ') END), '[\p{{L}}\p{{N}}]+')) AS b FROM fit),
rated AS (SELECT *, CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)), 9) END AS sc FROM wrd),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, up) AS pos FROM rated),
gaps AS (SELECT *, sc - lead(sc) OVER (PARTITION BY query_id ORDER BY pos) AS d, least(max_k, count(*) OVER (PARTITION BY query_id)) AS longest FROM placed),
cuts AS (
  SELECT *, coalesce(min(CASE WHEN pos >= min_k AND pos <= longest - 1 AND (d >= gap OR (sc > 0 AND d / sc >= gap)) THEN pos END) OVER (PARTITION BY query_id), longest) AS top_k FROM gaps),
spread AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(nullif(document_id, ''), candidate_id) ORDER BY pos) <= per_doc),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS final_rank FROM spread) WHERE final_rank <= top_k),
sections AS (
  SELECT *, {strip("""('来源标识：' || label || E'\n标题：' || display_title || E'\n来源：' || CASE WHEN source = 'web' THEN '网络搜索' ELSE '本地知识库' END || E'\n'
    || CASE WHEN source = 'web' THEN 'URL：' || url ELSE '文档类型：' || document_type || '；地域：' || region || '；内容类型：text' END || E'\n内容：' || content)""")} AS section
  FROM (SELECT *, CASE WHEN source = 'web' THEN '[网络搜索/' || url || ']' ELSE '[本地知识库/' || file_title || '/' || section_title || ']' END AS label FROM final)),
used AS (SELECT *, sum(len(section)) OVER (PARTITION BY query_id ORDER BY final_rank) AS u FROM sections),
told AS (
  SELECT query_id, string_agg(CASE WHEN u > budget THEN left(section, budget) ELSE section END, E'\n\n' ORDER BY final_rank) AS context, count(*)::INT AS n_sections,
    string_agg(label, '' ORDER BY final_rank) AS labels, string_agg(candidate_id, '+' ORDER BY final_rank) AS candidate_ids
  FROM used WHERE u <= budget OR final_rank = 1 GROUP BY query_id)
SELECT query_id, coalesce(context, '') AS context, coalesce(n_sections, 0) AS n_sections, coalesce(labels, '') AS labels, coalesce(candidate_ids, '') AS candidate_ids
FROM chosen LEFT JOIN told USING (query_id)"""


@query("answer_contexts", "P16,V5,V6,V7,V8,F1,F2,F3,F4,F5,F6,F8,F9", ANSWERS_SQL)
def answer_contexts(spark, sf):
    """The whole chain for queries of every mode, with pages as web hits."""
    chunks = V.document_chunks(spark, sf).repartition("chunk_id").select(
        "chunk_id", "document_id", "chunk_index", "file_title", F.col("lang").alias("section_title"), "content", F.lit("text").alias("context_type"),
        F.array("region").alias("region_names"), "document_type", F.array("source").alias("topics"), F.array("lang").alias("keywords"), F.lit(0).alias("token_count"),
    )
    pages = table(spark, sf, "pages").select((F.col("page_id") % 40).cast("string").alias("query_id"), "page_id", "url", F.left("html", F.lit(300)).alias("content"))
    web = ranked(pages, ["query_id"], [F.asc("page_id")]).withColumn("display_title", F.col("url"))
    queries = queries_of_every_mode(spark, sf)
    told = answering.answer_contexts(queries, answering.answer_evidence(queries, chunks, web))
    return told.withColumns({"labels": F.array_join("labels", ""), "candidate_ids": F.array_join("candidate_ids", "+")})


@query(
    "sparse_retrieval",
    "V6,J10",
    "WITH "
    + ", ".join([V.CHUNKS_SQL, POSTINGS_SQL, FORMS_SQL, QUERY_WEIGHTS_SQL, SPARSE_SQL])
    + " SELECT query_id, chunk_id, rank, score FROM sparse",
)
def sparse_retrieval(spark, sf):
    """Two narrow passes over the chunks: one counts the terms of the queries, one searches."""
    chunks = V.document_chunks(spark, sf)
    forms = hybrid.query_forms(benchmark_queries(spark, sf))
    vectors = E.term_vectors(chunks.select("chunk_id", "content").repartition("chunk_id"), "chunk_id", "content")
    n_chunks = chunks.select(F.count("*").alias("n")).scalar()
    # Outer, as the inner form adds a size test that would weigh every text twice.
    terms = vectors.select(F.explode_outer("terms").alias("term"))
    weights = E.query_postings(forms, "query_id", "text", terms, n_chunks)
    return R.search(R.gathered(weights, "query_id"), vectors, 20, ("sparse",)).drop("arm")


CENTRES_SQL = """centres AS (
  SELECT label::VARCHAR AS query_id, list(m::FLOAT ORDER BY i) AS v FROM (
    SELECT label, i, round(avg(x::DOUBLE), 6) AS m FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i)
  GROUP BY label)"""


def label_centres(spark, sf):
    """One query per label: the mean vector of its members."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).cast("float").alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells")).select(
        F.col("label").cast("string").alias("query_id"), F.transform("cells", lambda c: c["m"]).alias("vector"), "label"
    )


@query(
    "dense_retrieval",
    "V5,J10",
    f"""WITH {CENTRES_SQL} SELECT * FROM (
      SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank
      FROM (SELECT query_id, vec_id::VARCHAR AS chunk_id, round(list_dot_product(v::DOUBLE[], embedding::DOUBLE[]), 9) AS score
            FROM centres, embeddings)) WHERE rank <= 20""",
)
def dense_retrieval(spark, sf):
    chunks = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector")
    )
    return R.dense_top_k(label_centres(spark, sf).drop("label"), chunks, 20)


@query(
    "filtered_dense_retrieval",
    "P10,V5,J10",
    f"""WITH {CENTRES_SQL} SELECT * FROM (
      SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank
      FROM (SELECT query_id, vec_id::VARCHAR AS chunk_id, round(list_dot_product(v::DOUBLE[], embedding::DOUBLE[]), 9) AS score
            FROM centres JOIN embeddings ON query_id::INT % 2 = 1 OR label IN (query_id::INT, query_id::INT + 1))) WHERE rank <= 12""",
)
def filtered_dense_retrieval(spark, sf):
    label = F.col("label")
    only = F.when(label % 2 == 0, F.array(label.cast("string"), (label + 1).cast("string")))
    centres = label_centres(spark, sf).withColumn("only", only).drop("label")
    chunks = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), label.alias("group")
    )
    return R.dense_top_k(centres, chunks, 12)


@query(
    "hashed_embedding",
    "V1,U1",
    "WITH "
    + V.DOC_META_SQL.replace("doc_meta AS", "doc_meta AS", 1)
    + r""", toks AS (SELECT doc_id::VARCHAR AS chunk_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL),
      postings AS (SELECT chunk_id, term, 1 + ln(tf) AS w FROM toks), """
    + _dense_sql("cdense", "postings", "chunk_id")
    + """ SELECT chunk_id AS doc_id, i::INT AS i, round(x::DOUBLE, 6) AS x FROM (
            SELECT chunk_id, unnest(v) AS x, unnest(range(64)) AS i FROM cdense)""",
)
def hashed_embedding(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    dense = E.hashed_dense(E.sparse_postings(docs, "doc_id", "text"), "doc_id")
    return dense.select("doc_id", F.posexplode("vector").alias("i", "x")).select(
        "doc_id", "i", F.round(F.col("x").cast("double"), 6).alias("x")
    )


@query(
    "sparse_vector_normalisation",
    "V4,V3",
    """WITH e AS (SELECT vec_id, i, x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)
                  WHERE x > 0.1)
       SELECT vec_id, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 9) AS w FROM e""",
)
def sparse_vector_normalisation(spark, sf):
    """A compressed row (indices, data, bounds) per vector, read back as a map of unit length."""
    v = F.col("embedding")
    cells = F.filter(
        F.transform(v, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda c: c["x"] > 0.1
    )
    csr = table(spark, sf, "embeddings").select(
        "vec_id",
        F.concat(F.array(F.lit(-1)), F.transform(cells, lambda c: c["i"])).alias("indices"),
        F.concat(F.array(F.lit(0.0)), F.transform(cells, lambda c: c["x"])).alias("data"),
    )
    row = E.csr_row(F.col("indices"), F.col("data"), F.lit(1), F.size("indices"))
    return csr.select("vec_id", F.explode(E.normalise_sparse_map(row)).alias("i", "w")).select(
        "vec_id", "i", F.round("w", 9).alias("w")
    )


@query(
    "weighted_hybrid_fusion",
    "V7",
    f"""WITH {V.LISTS_SQL}, arms AS (
         SELECT query_id, chunk_id, list_no, max(score) AS score FROM arm_lists GROUP BY ALL),
       fused AS (SELECT query_id, chunk_id, round(sum(CASE WHEN list_no = 0 THEN 0.6 ELSE 0.4 END::DOUBLE * (0.5 + atan(score) / pi())), 9) AS score
                 FROM arms GROUP BY ALL)
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM fused) WHERE rank <= 10""",
)
def weighted_hybrid_fusion(spark, sf):
    arms = V.arm_lists(spark, sf).groupBy("query_id", "chunk_id", "list_no").agg(F.max("score").alias("score"))
    arm = F.when(F.col("list_no") == 0, F.lit("dense")).otherwise(F.lit("sparse"))
    return R.weighted_hybrid(arms.withColumn("arm", arm), 0.6, 0.4, 10)


RRF_LISTS_SQL = (
    V.LISTS_SQL
    + """, fused AS (
  SELECT query_id, chunk_id, round(sum(CASE WHEN list_no = 0 THEN 1.0 ELSE 0.8 END::DOUBLE / (60 + rank)), 12) AS score,
         min(list_no * 1000 + rank) AS seen, min_by(document_id, list_no * 1000 + rank) AS document_id,
         CASE WHEN count(DISTINCT list_no) = 2 THEN 'embedding+hyde' ELSE min(layer) END AS sources,
         coalesce(min_by(score, -rank) FILTER (WHERE list_no = 0), 0) AS embedding_score,
         coalesce(min_by(score, -rank) FILTER (WHERE list_no = 1), 0) AS hyde_score
  FROM arm_lists WHERE chunk_id <> 'p13' GROUP BY query_id, chunk_id),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank FROM fused) WHERE rank <= 12)"""
)


def rrf_of_lists(spark, sf):
    lists = V.arm_lists(spark, sf).select(
        "query_id",
        "list_no",
        "rank",
        # A blank id keeps its rank but scores nothing.
        F.when(F.col("chunk_id") == "p13", F.lit(" ")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.col("layer").alias("source"),
        "score",
        F.when(F.col("list_no") == 0, 1.0).otherwise(0.8).alias("weight"),
        "document_id",
    )
    return fusion.reciprocal_rank_fusion(lists, F.lit(60), F.lit(12), payload=["document_id"])


@query(
    "rank_fusion",
    "F1",
    f"WITH {RRF_LISTS_SQL} SELECT query_id, chunk_id, document_id, rank, score, sources, embedding_score, hyde_score FROM rrf",
)
def rank_fusion(spark, sf):
    score_of = lambda s: F.coalesce(F.element_at("retrieval_scores", F.lit(s)), F.lit(0.0))
    return rrf_of_lists(spark, sf).select(
        "query_id",
        "chunk_id",
        "document_id",
        "rank",
        "score",
        F.array_join("sources", "+").alias("sources"),
        score_of("embedding").alias("embedding_score"),
        score_of("hyde").alias("hyde_score"),
    )


MERGE_SQL = (
    V.LISTS_SQL
    + """, web AS (
  SELECT query_id, rank, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'https://e.org/' || (l_partkey % 5) END AS url,
         'title ' || l_returnflag AS display_title, 'body ' || (l_linenumber % 3) AS content
  FROM arm_lists WHERE list_no = 1),
both_sides AS (
  SELECT query_id, 0 AS side, rank, chunk_id AS candidate_id, '' AS url FROM arm_lists WHERE list_no = 0
  UNION ALL
  SELECT query_id, 1, rank, 'web:' || sha256(CASE WHEN url <> '' THEN url ELSE display_title || E'\n' || content END), url FROM web),
firsts AS (SELECT * FROM both_sides QUALIFY row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY side, rank) = 1)"""
)


def merged_candidates(spark, sf):
    lists = V.arm_lists(spark, sf)
    local = lists.where("list_no = 0").select(
        "query_id",
        "rank",
        "chunk_id",
        "document_id",
        F.lit("").alias("url"),
        F.lit("milvus").alias("source"),
        F.lit("t").alias("display_title"),
        F.lit("c").alias("content"),
    )
    web = lists.where("list_no = 1").select(
        "query_id",
        "rank",
        F.when(F.col("l_returnflag") == "R", F.lit(""))
        .otherwise(F.concat(F.lit("https://e.org/"), F.col("l_partkey") % 5))
        .alias("url"),
        F.lit("web").alias("source"),
        F.concat(F.lit("title "), "l_returnflag").alias("display_title"),
        F.concat(F.lit("body "), F.col("l_linenumber") % 3).alias("content"),
    )
    return fusion.merge_candidates(local, web)


@query(
    "candidate_merge",
    "F2",
    f"""WITH {MERGE_SQL} SELECT query_id, candidate_id, url,
        row_number() OVER (PARTITION BY query_id ORDER BY side, rank)::INT AS upstream_rank FROM firsts""",
)
def candidate_merge(spark, sf):
    return merged_candidates(spark, sf).select("query_id", "candidate_id", "url", "upstream_rank")


@query(
    "retrieval_query_text",
    "V9",
    r"""WITH q AS (SELECT conv_id, turn, text, [regexp_extract(lower(text), '([a-z]+)[^a-z]*\z', 1) || 'q', 'zz' || (turn % 3), regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*\z', 1)] AS topics,
                         ['文件' || (conv_id % 4)] AS files FROM conversations WHERE role = 'user'),
       s AS (SELECT conv_id, turn, text, list_filter(topics, lambda x: NOT contains(text, x)) AS t, files FROM q),
       b AS (SELECT conv_id, turn, text, concat_ws(E'\n', text, '文件：' || array_to_string(files, '、'),
                    CASE WHEN len(t) > 0 THEN '主题：' || array_to_string(t, '、') END) AS built, files, t FROM s)
       SELECT conv_id, turn, CASE WHEN len(built) > 500 THEN left(b.text, 500) ELSE built END AS retrieval_text,
              left(b.text || ' ' || b.files[1], 500) AS web_text,
              '文件：' || b.files[1] || '；主题：' || array_to_string(q.topics, '、') AS scope_text
       FROM b JOIN q USING (conv_id, turn)""",
)
def retrieval_query_text(spark, sf):
    from evispark.operators.queries import retrieval_text, scope_text, web_search_text

    text = F.col("text")
    filters = F.struct(
        F.array(F.concat(F.lit("文件"), (F.col("conv_id") % 4).cast("string"))).alias("file_titles"),
        F.array().cast("array<string>").alias("region_names"),
        F.array().cast("array<string>").alias("document_types"),
        F.array(
            F.concat(F.regexp_extract(F.lower(text), r"([a-z]+)[^a-z]*\z", 1), F.lit("q")),
            F.concat(F.lit("zz"), (F.col("turn") % 3).cast("string")),
            F.regexp_extract(text, r"([A-Za-z]+)[^A-Za-z]*\z", 1),
        ).alias("topics"),
        F.array().cast("array<string>").alias("keywords"),
    )
    rows = table(spark, sf, "conversations").where("role = 'user'").withColumn("filters", filters)
    return rows.select(
        "conv_id",
        "turn",
        retrieval_text(text, F.col("filters")).alias("retrieval_text"),
        web_search_text(text, F.col("filters")).alias("web_text"),
        scope_text(F.col("filters")).alias("scope_text"),
    )


