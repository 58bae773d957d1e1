"""Rerank, selection, evidence context and history over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evispark.catalog import views as V
from evispark.catalog.registry import query
from evispark.catalog.retrieval import MERGE_SQL, merged_candidates
from evispark.catalog.sqltext import SPACE, strip
from evispark.functions import text as T
from evispark.operators import config as C
from evispark.operators import context as X
from evispark.operators import rules
from evispark.operators import selection as S
from evispark.operators.ranking import ranked, top_k
from evispark.session import table

TOKENS = rf"[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+|[^{SPACE}]"
WORDS = r"[\p{L}\p{N}]+"

# Question and candidate: every assistant message with the last user message before it.
PAIRS_SQL = """pairs AS (
  SELECT * FROM (SELECT conv_id, turn, role, text,
    last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS question
    FROM conversations) WHERE role = 'assistant' AND question IS NOT NULL)"""


def question_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return (
        table(spark, sf, "conversations")
        .withColumn("question", said)
        .where("role = 'assistant' AND question IS NOT NULL")
    )


@query(
    "rerank_text_budget",
    "F3",
    f"""WITH {PAIRS_SQL}, t AS (SELECT conv_id, turn, question, 'conv ' || conv_id || E'\\n' || {strip('text')} AS t FROM pairs),
        k AS (SELECT conv_id, turn, t, regexp_extract_all(t, '{TOKENS}') AS toks,
                     greatest(1, 512 - len(regexp_extract_all(question, '{TOKENS}')) - 4) AS room FROM t)
        SELECT conv_id, turn, CASE WHEN len(toks) <= room THEN t ELSE array_to_string(toks[1:room], ' ') END AS rerank_text FROM k""",
)
def rerank_text_budget(spark, sf):
    title = F.concat(F.lit("conv "), F.col("conv_id").cast("string"))
    text = S.rerank_text(title, F.col("text"))
    return question_pairs(spark, sf).select(
        "conv_id", "turn", S.fitted_rerank_text(F.col("question"), text).alias("rerank_text")
    )


@query(
    "pair_scoring",
    "F4,U2",
    f"""WITH {PAIRS_SQL}, w AS (
          SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(question), '{WORDS}')) AS a,
                 list_distinct(regexp_extract_all(lower(text), '{WORDS}')) AS b FROM pairs),
        s AS (SELECT conv_id, turn, CASE WHEN len(list_distinct(a || b)) = 0 THEN 0
                 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)), 9) END AS score FROM w)
        SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn)::INT AS rank FROM s""",
)
def pair_scoring(spark, sf):
    pairs = question_pairs(spark, sf).withColumn("upstream_rank", F.col("turn"))
    ranked = S.score_ranked(pairs, S.lexical_score(F.col("question"), F.col("text")), "conv_id")
    return ranked.select("conv_id", "turn", "score", "rank")


SCORES_SQL = """scored AS (
  SELECT *, CASE query_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 6 END AS min_k, CASE query_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 12 END AS max_k,
    CASE query_id % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.1 ELSE 0.35 END::DOUBLE AS gap, CASE query_id % 3 WHEN 2 THEN 3 ELSE 2 END AS per_doc
  FROM (SELECT user_id AS query_id, event_id::VARCHAR AS candidate_id, event_type AS document_id, round(value / 100, 4) AS score,
          row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rank FROM events))"""

SELECT_SQL = (
    SCORES_SQL
    + """, gaps AS (
  SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS d, least(max_k, count(*) OVER (PARTITION BY query_id)) AS m FROM scored),
cuts AS (SELECT *, coalesce(min(CASE WHEN rank >= min_k AND rank <= m - 1 AND (d >= gap OR (score > 0 AND d / score >= gap)) THEN rank END)
    OVER (PARTITION BY query_id), m)::INT AS top_k FROM gaps),
spread AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS within FROM cuts) WHERE within <= per_doc)"""
)


def scored_candidates(spark, sf):
    mode = F.when(F.col("query_id") % 3 == 0, F.lit("balanced")).when(
        F.col("query_id") % 3 == 1, F.lit("precision")
    ).otherwise(F.lit("recall"))
    hits = table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"),
        F.col("event_id").cast("string").alias("candidate_id"),
        F.col("event_type").alias("document_id"),
        F.round(F.col("value") / 100, 4).alias("score"),
        "value",
        "event_id",
    )
    best = ranked(hits, ["query_id"], [F.desc("value"), F.asc("event_id")])
    return best.withColumn("mode", mode).withColumn("s", C.resolve(F.col("mode"))).select("*", "s.*").drop("s")


@query(
    "dynamic_top_k",
    "F5,F6",
    f"""WITH {SELECT_SQL} SELECT * FROM (SELECT query_id, candidate_id, document_id, score, rank, top_k,
          row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS final_rank FROM spread) WHERE final_rank <= top_k""",
)
def dynamic_top_k(spark, sf):
    return S.dynamic_top_k(scored_candidates(spark, sf)).select(
        "query_id", "candidate_id", "document_id", "score", "rank", "top_k", "final_rank"
    )


@query(
    "score_cliff_cut",
    "F5",
    f"WITH {SELECT_SQL} SELECT query_id, candidate_id, rank, top_k FROM cuts WHERE rank <= top_k",
)
def score_cliff_cut(spark, sf):
    return S.dynamic_top_k(scored_candidates(spark, sf), strict_single_file=True).select(
        "query_id", "candidate_id", "rank", "top_k"
    )


@query(
    "rerank_with_fallback",
    "F7",
    f"""WITH {SELECT_SQL}, ok AS (SELECT query_id, candidate_id, top_k, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS final_rank
          FROM spread WHERE query_id % 7 <> 0)
        SELECT query_id, candidate_id, final_rank, 'success' AS reranker_status FROM ok WHERE final_rank <= top_k
        UNION ALL SELECT query_id, candidate_id, rank, 'failed' FROM scored WHERE query_id % 7 = 0 AND rank <= max_k""",
)
def rerank_with_fallback(spark, sf):
    rows = scored_candidates(spark, sf).withColumn("upstream_rank", F.col("rank"))
    return S.rerank(rows, F.col("query_id") % 7 == 0).select(
        "query_id", "candidate_id", "final_rank", "reranker_status"
    )


# Ranked evidence: the chunks of a source are the evidence of one query.
EVIDENCE_SQL = (
    V.CHUNKS_SQL
    + """, evidence AS (SELECT * FROM (
  SELECT source AS query_id, chunk_id, document_id, file_title, content, document_type, region, lang, doc_id, chunk_index,
    CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN file_title ELSE lang || '-' || chunk_index END AS section_title,
    CASE WHEN doc_id % 5 = 0 THEN 'web' ELSE 'milvus' END AS kind, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'https://e.org/' || doc_id END AS url,
    row_number() OVER (PARTITION BY source ORDER BY chunk_index DESC, doc_id)::INT AS rank FROM chunks)),
labelled AS (SELECT *, CASE WHEN kind = 'web' THEN '[网络搜索/' || CASE WHEN url = '' THEN '未提供URL' ELSE url END || ']'
    ELSE '[本地知识库/' || file_title || '/' || CASE WHEN section_title = '' THEN file_title ELSE section_title END || ']' END AS label FROM evidence)"""
)


def evidence_rows(spark, sf):
    doc = F.col("doc_id")
    rows = ranked(
        V.document_chunks(spark, sf).withColumn("query_id", F.col("source")).drop("source"),
        ["query_id"],
        [F.desc("chunk_index"), F.asc("doc_id")],
    )
    section = (
        F.when(doc % 4 == 0, F.lit(""))
        .when(doc % 4 == 1, F.col("file_title"))
        .otherwise(F.concat_ws("-", "lang", F.col("chunk_index").cast("string")))
    )
    return (
        rows.withColumn("section_title", section)
        .withColumn("source", F.when(doc % 5 == 0, F.lit("web")).otherwise(F.lit("milvus")))
        .withColumn("url", F.when(doc % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("https://e.org/"), doc.cast("string"))))
        .withColumn("display_title", T.display_title(F.col("file_title"), F.col("section_title")))
        .withColumn("region_names", F.array("region"))
        .withColumn("context_type", F.lit("text"))
    )


@query("source_labels", "F9", f"WITH {EVIDENCE_SQL} SELECT query_id, rank, label FROM labelled")
def source_labels(spark, sf):
    label = X.source_label(F.col("source"), F.col("file_title"), F.col("section_title"), F.col("url"))
    return evidence_rows(spark, sf).select("query_id", "rank", label.alias("label"))


@query(
    "evidence_context",
    "F8",
    f"""WITH {EVIDENCE_SQL}, sections AS (
          SELECT query_id, rank, {strip('''('来源标识：' || label || E'\\n标题：' || CASE WHEN section_title <> '' AND section_title <> file_title THEN file_title || ' / ' || section_title ELSE file_title END
            || E'\\n来源：' || CASE WHEN kind = 'web' THEN '网络搜索' ELSE '本地知识库' END || E'\\n'
            || CASE WHEN kind = 'web' THEN CASE WHEN url <> '' THEN 'URL：' || url ELSE '' END
                    ELSE '文档类型：' || document_type || '；地域：' || region || '；内容类型：text' END
            || E'\\n内容：' || content)''')} AS section,
            CASE WHEN query_id = 'src3' THEN 300 WHEN query_id = 'src4' THEN 2000 ELSE 5000 END AS budget FROM labelled),
        used AS (SELECT *, sum(len(section)) OVER (PARTITION BY query_id ORDER BY rank) AS u FROM sections)
        SELECT query_id, string_agg(CASE WHEN u > budget THEN left(section, budget) ELSE section END, E'\\n\\n' ORDER BY rank) AS context,
               count(*)::INT AS n_sections FROM used WHERE u <= budget OR rank = 1 GROUP BY query_id""",
)
def evidence_context(spark, sf):
    rows = evidence_rows(spark, sf).withColumn("section", X.evidence_section(F.col))
    budget = F.when(F.col("query_id") == "src3", 300).when(F.col("query_id") == "src4", 2000).otherwise(5000)
    return X.evidence_context(rows, budget)


@query(
    "legacy_citation_rewrite",
    "F10",
    f"""WITH {EVIDENCE_SQL}, per AS (SELECT query_id, list(label ORDER BY rank) AS labels FROM labelled GROUP BY query_id)
        SELECT query_id, 'A' || labels[1] || labels[3] || ' mid ' || coalesce(labels[40], '[来源40]') || labels[1] || '[来源0]end' AS answer FROM per""",
)
def legacy_citation_rewrite(spark, sf):
    label = X.source_label(F.col("source"), F.col("file_title"), F.col("section_title"), F.col("url"))
    per = (
        evidence_rows(spark, sf)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))).alias("r"))
    )
    labels = F.transform("r", lambda x: x["label"])
    answer = X.replace_legacy_labels(F.lit("A[来源1][来源3] mid [来源40][来源1][来源0]end"), labels)
    return per.select("query_id", answer.alias("answer"))


@query(
    "image_url_extraction",
    "F11",
    """WITH d AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS query_id, page_id AS rank,
              'x ![a](http://i.org/' || (page_id % 3) || '.png) y ![b]( local/' || (page_id % 2) || '.jpg )' AS content,
              CASE WHEN page_id % 2 = 0 THEN 'https://i.org/p' || (page_id % 4) || '.GIF?x=1' ELSE url END AS url FROM pages),
       f AS (SELECT query_id, rank, 0 AS pos, trim('http://i.org/' || (rank % 3) || '.png') AS u FROM d
             UNION ALL SELECT query_id, rank, 1, 'local/' || (rank % 2) || '.jpg' FROM d
             UNION ALL SELECT query_id, rank, 2, url FROM d WHERE regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(jpg|jpeg|png|gif|bmp|webp)$')),
       o AS (SELECT query_id, u AS image_url, min(rank * 10 + pos) AS first FROM f GROUP BY ALL)
       SELECT query_id, image_url, row_number() OVER (PARTITION BY query_id ORDER BY first)::INT AS image_no FROM o""",
)
def image_url_extraction(spark, sf):
    pid = F.col("page_id")
    docs = table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("query_id"),
        pid.alias("rank"),
        F.concat(
            F.lit("x ![a](http://i.org/"), pid % 3, F.lit(".png) y ![b]( local/"), pid % 2, F.lit(".jpg )")
        ).alias("content"),
        F.when(pid % 2 == 0, F.concat(F.lit("https://i.org/p"), pid % 4, F.lit(".GIF?x=1"))).otherwise(F.col("url")).alias("url"),
    )
    return X.image_urls(docs)


@query(
    "history_context",
    "F12",
    f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6),
        l AS (SELECT conv_id, rn, CASE WHEN role = 'user' THEN '用户：' || {strip('text')} ELSE '助手：' || {strip('left(text, 300)')} END AS line,
                     CASE WHEN role = 'user' THEN '用户：' ELSE '助手：' END || left(text, 300) AS short_line FROM r),
        u AS (SELECT *, sum(len(line)) OVER (PARTITION BY conv_id ORDER BY rn) AS used FROM l)
        SELECT conv_id, coalesce(string_agg(line, E'\\n' ORDER BY rn DESC) FILTER (WHERE used <= 4000), '无历史对话') AS understanding,
               right(string_agg(short_line, E'\\n' ORDER BY rn DESC), 4000) AS answering FROM u GROUP BY conv_id""",
)
def history_context(spark, sf):
    messages = table(spark, sf, "conversations").withColumn("rewritten_query", F.lit(""))
    return X.history_context(messages, "conv_id", "turn")


@query(
    "retrieval_summary",
    "F13",
    f"""WITH {V.LISTS_SQL}, c AS (SELECT query_id, count(*) FILTER (WHERE list_no = 0)::INT AS n_embedding,
           count(*) FILTER (WHERE list_no = 1)::INT AS n_hyde, count(DISTINCT chunk_id)::INT AS n_fused FROM arm_lists GROUP BY query_id),
        m AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'precision' ELSE 'recall' END AS mode FROM c)
        SELECT query_id, n_embedding, n_hyde, n_fused, CASE mode WHEN 'balanced' THEN '均衡' WHEN 'precision' THEN '精确回答' ELSE '全面检索' END AS mode_label,
          CASE mode WHEN 'balanced' THEN '适中' WHEN 'precision' THEN '较窄' ELSE '较广' END AS search_breadth,
          CASE mode WHEN 'balanced' THEN '2～6' WHEN 'precision' THEN '1～3' ELSE '6～12' END AS reference_range, '均衡' AS matching_preference,
          concat_ws(',', CASE WHEN query_id % 5 = 0 THEN 'hyde_failed' END, CASE WHEN query_id % 4 = 0 THEN 'reranker_failed' END) AS degradations FROM m""",
)
def retrieval_summary(spark, sf):
    counts = (
        V.arm_lists(spark, sf)
        .groupBy("query_id")
        .agg(
            F.count_if(F.col("list_no") == 0).cast("int").alias("n_embedding"),
            F.count_if(F.col("list_no") == 1).cast("int").alias("n_hyde"),
            F.count_distinct("chunk_id").cast("int").alias("n_fused"),
        )
    )
    q = F.col("query_id")
    mode = F.when(q % 3 == 0, F.lit("balanced")).when(q % 3 == 1, F.lit("precision")).otherwise(F.lit("recall"))
    statuses = {
        "embedding": F.lit("success"),
        "hyde": F.when(q % 5 == 0, F.lit("failed")).otherwise(F.lit("success")),
        "web": F.lit("disabled"),
        "reranker": F.when(q % 4 == 0, F.lit("failed")).otherwise(F.lit("success")),
    }
    out = X.retrieval_summary(counts.withColumn("s", C.resolve(mode)), F.col("s"), mode, statuses)
    return out.drop("s").withColumn("degradations", F.array_join("degradations", ","))


OPTIONS_SQL = """opts AS (
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'balanced' WHEN 1 THEN 'precision' WHEN 2 THEN 'recall' WHEN 3 THEN 'other' ELSE 'custom' END AS mode,
         3 + p_size % 26 AS k, p_size % 14 AS m, CASE p_type WHEN 'ECONOMY' THEN 'keyword' WHEN 'SMALL' THEN 'semantic' WHEN 'STANDARD' THEN 'other' ELSE 'balanced' END AS pref,
         CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS hyde FROM part)"""


def config_requests(spark, sf):
    p = F.col("p_partkey")
    mode = (
        F.when(p % 6 == 0, F.lit("balanced"))
        .when(p % 6 == 1, F.lit("precision"))
        .when(p % 6 == 2, F.lit("recall"))
        .when(p % 6 == 3, F.lit("other"))
        .otherwise(F.lit("custom"))
    )
    options = F.struct(
        (3 + F.col("p_size") % 26).alias("candidate_top_k"),
        (F.col("p_size") % 14).alias("max_reference_count"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("keyword"))
        .when(F.col("p_type") == "SMALL", F.lit("semantic"))
        .when(F.col("p_type") == "STANDARD", F.lit("other"))
        .otherwise(F.lit("balanced"))
        .alias("matching_preference"),
        F.lit(True).alias("hyde_enabled"),
        F.when(p % 4 == 0, F.lit("low")).when(p % 4 == 1, F.lit("medium")).otherwise(F.lit("high")).alias("hyde_influence"),
        F.lit(None).cast("boolean").alias("web_enabled"),
    )
    return (
        table(spark, sf, "part")
        .withColumn("mode", mode)
        .withColumn("options", F.when(F.col("mode").isin("custom", "other"), options))
    )


@query(
    "retrieval_settings",
    "P16",
    f"""WITH {OPTIONS_SQL}
        SELECT p_partkey, mode, 20 AS ann_limit, 10 AS search_top_k, 0.6::DOUBLE AS dense_weight, 0.8::DOUBLE AS rrf_hyde_weight, 12 AS rrf_top_k, 2 AS rerank_min_topk, 6 AS rerank_max_topk, 20000 AS answer_max_context_chars FROM opts WHERE mode = 'balanced'
        UNION ALL SELECT p_partkey, mode, 12, 6, 0.6, 0.4, 8, 1, 3, 12000 FROM opts WHERE mode = 'precision'
        UNION ALL SELECT p_partkey, mode, 40, 20, 0.6, 1.0, 24, 6, 12, 30000 FROM opts WHERE mode = 'recall'
        UNION ALL SELECT p_partkey, mode, greatest(10, least(50, 2 * k)), k, CASE pref WHEN 'keyword' THEN 0.35 WHEN 'semantic' THEN 0.8 ELSE 0.6 END,
          CASE hyde WHEN 'low' THEN 0.4 WHEN 'medium' THEN 0.8 ELSE 1.0 END, greatest(5, least(30, greatest(m, ceil(1.2 * k)::INT))), least(2, m), m,
          greatest(5000, least(30000, m * 2500)) FROM opts WHERE mode = 'custom' AND k BETWEEN 5 AND 25 AND m BETWEEN 1 AND 12 AND pref <> 'other'""",
)
def retrieval_settings(spark, sf):
    mode, options = F.col("mode"), F.col("options")
    good = rules.valid(config_requests(spark, sf), C.option_problems(mode, options))
    resolved = good.withColumn("s", C.resolve(mode, options))
    kept = rules.valid(resolved, C.invariant_problems(F.col("s")))
    return kept.select(
        "p_partkey",
        "mode",
        *[
            f"s.{f}"
            for f in (
                "ann_limit search_top_k dense_weight rrf_hyde_weight rrf_top_k rerank_min_topk "
                "rerank_max_topk answer_max_context_chars"
            ).split()
        ],
    )


@query(
    "retrieval_settings_rejects",
    "P16,P23",
    f"""WITH {OPTIONS_SQL} SELECT p_partkey, reason FROM (
          SELECT p_partkey, 'unknown_mode' AS reason FROM opts WHERE mode = 'other'
          UNION ALL SELECT p_partkey, 'options_only_for_custom' FROM opts WHERE mode = 'other'
          UNION ALL SELECT p_partkey, 'candidate_top_k_range' FROM opts WHERE mode = 'custom' AND NOT k BETWEEN 5 AND 25
          UNION ALL SELECT p_partkey, 'max_reference_count_range' FROM opts WHERE mode = 'custom' AND NOT m BETWEEN 1 AND 12
          UNION ALL SELECT p_partkey, 'matching_preference_value' FROM opts WHERE mode = 'custom' AND pref = 'other')""",
)
def retrieval_settings_rejects(spark, sf):
    return rules.rejects(
        config_requests(spark, sf), ["p_partkey"], C.option_problems(F.col("mode"), F.col("options"))
    )


@query(
    "local_candidate_projection",
    "P11",
    f"""WITH {EVIDENCE_SQL} SELECT query_id, rank, chunk_id, CASE WHEN section_title <> '' AND section_title <> file_title
             THEN file_title || ' / ' || section_title ELSE file_title END AS display_title,
             CASE WHEN doc_id % 3 = 0 THEN '其他' ELSE document_type END AS document_type, CASE WHEN doc_id % 6 = 0 THEN 'text' ELSE 'table' END AS context_type,
             0 AS token_count, round(1.0::DOUBLE / rank, 6) AS score, {strip('content')} AS content
        FROM evidence WHERE doc_id % 8 <> 3 AND {strip('content')} <> ''""",
)
def local_candidate_projection(spark, sf):
    doc = F.col("doc_id")
    hits = (
        evidence_rows(spark, sf)
        .withColumn("file_title", F.when(doc % 8 == 3, F.lit("  ")).otherwise(F.col("file_title")))
        .withColumn("document_type", F.when(doc % 3 == 0, F.lit(None)).otherwise(F.col("document_type")))
        .withColumn("context_type", F.when(doc % 6 == 0, F.lit("")).otherwise(F.lit("table")))
        .withColumn("topics", F.lit(None).cast("array<string>"))
        .withColumn("keywords", F.lit(None).cast("array<string>"))
        .withColumn("token_count", F.lit(None).cast("int"))
        .withColumn("score", F.round(F.lit(1.0) / F.col("rank"), 6))
    )
    return S.local_candidates(hits, "embedding").select(
        "query_id", "rank", "chunk_id", "display_title", "document_type", "context_type", "token_count", "score", "content"
    )


@query(
    "public_evidence",
    "P15",
    f"""WITH {EVIDENCE_SQL}, ok AS (SELECT query_id, rank AS r, chunk_id, file_title AS document_name, section_title,
             CASE WHEN doc_id % 3 = 0 THEN round(1.0::DOUBLE / rank, 6) ELSE 0.5 END AS score
             FROM evidence WHERE {strip('content')} <> '' AND doc_id % 7 <> 2)
        SELECT * FROM (SELECT query_id, chunk_id, document_name, section_title, score,
             row_number() OVER (PARTITION BY query_id ORDER BY r)::INT AS rank FROM ok) WHERE rank <= 6""",
)
def public_evidence(spark, sf):
    doc = F.col("doc_id")
    rows = (
        evidence_rows(spark, sf)
        .withColumn(
            "rerank_score",
            F.when(doc % 7 == 2, F.lit(float("nan"))).when(doc % 3 == 0, F.lit(None).cast("double")).otherwise(F.lit(0.5)),
        )
        .withColumn("score", F.round(F.lit(1.0) / F.col("rank"), 6))
    )
    return S.public_evidence(rows, 6).select(
        "query_id", "chunk_id", "document_name", "section_title", "score", "rank"
    )


@query(
    "answer_composition",
    "U6",
    f"""WITH {MERGE_SQL}, n AS (SELECT query_id, count(*) AS n, list(candidate_id ORDER BY side, rank) AS ids FROM firsts GROUP BY query_id)
        SELECT query_id, CASE WHEN query_id % 5 = 0 THEN '请补充' WHEN query_id % 5 = 1 THEN '未检索到足以回答该问题的参考内容。'
               ELSE 'see ' || ids[2] || ' and [来源9999]' END AS answer FROM n""",
)
def answer_composition(spark, sf):
    q = F.col("query_id")
    per = (
        merged_candidates(spark, sf)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("upstream_rank", "candidate_id"))).alias("r"))
    )
    asked = F.when(q % 5 == 0, F.lit(" 请补充 ")).otherwise(F.lit(""))
    n = F.when(q % 5 == 1, F.lit(0)).otherwise(F.size("r"))
    labels = F.transform("r", lambda x: x["candidate_id"])
    answer = X.answer_text(asked, n, F.lit(" see [来源2] and [来源9999] "), labels)
    return per.select("query_id", answer.alias("answer"))
