"""Search responses, pages, images, gold rows, requests and history over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark import schemas
from evispark.catalog.ingest import _unique_cte
from evispark.catalog.registry import query
from evispark.catalog.sqltext import SPACE, collapse, strip
from evispark.functions import arrays as A
from evispark.functions import text as T
from evispark.operators import queries as Q
from evispark.operators import requests as P
from evispark.operators import rules
from evispark.operators import stores as S
from evispark.operators.context import recent_messages
from evispark.session import table
from evispark.sources import gold as G
from evispark.sources import html_pages, images
from evispark.sources import search_results as W
from evispark.sources.documents import route_by_suffix

TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


@query(
    "web_search_candidates",
    "S11,X4",
    f"""WITH p AS (SELECT page_id, url, {strip(TITLE)} AS title FROM pages),
        e AS (SELECT page_id, 0 AS pos, title, 'snip' AS content, regexp_replace(url, '#.*$', '') AS url FROM p
          UNION ALL SELECT page_id, 1, 'dup', 'body', regexp_replace(url, '#.*$', '') FROM p UNION ALL SELECT page_id, 2, '', '', 'http://x/' FROM p
          UNION ALL SELECT page_id, 3, '', 'only text ' || page_id, '' FROM p UNION ALL SELECT page_id, 4, 'T' || (page_id % 3), '', 'http://e.org/' || page_id FROM p
          UNION ALL SELECT page_id, 5, 'late', 'x', 'http://late/' FROM p),
        k AS (SELECT *, CASE WHEN url <> '' THEN url ELSE title || E'\\n' || content END AS key FROM e WHERE title <> '' OR content <> ''),
        d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY pos) = 1)
        SELECT page_id AS query_id, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS rank, CASE WHEN title = '' THEN '网络搜索结果' ELSE title END AS display_title, content, url
        FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3""",
)
def web_search_candidates(spark, sf):
    pid = F.col("page_id").cast("string")
    page = lambda title, url, snippet, content: F.struct(
        title.alias("title"), url.alias("url"), snippet.alias("snippet"), content.alias("content")
    )
    t = F.lit
    pages = F.array(
        page(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.concat(t(" "), "url"), t("snip"), t("body")),
        page(t("dup"), F.col("url"), t(""), t("body")),
        page(t(" "), t("http://x/#y"), t(""), t("  ")),
        page(t(""), t(""), t(""), F.concat(t("only text "), pid)),
        page(F.concat(t("T"), (F.col("page_id") % 3).cast("string")), F.concat(t("http://e.org/"), pid, t("#a")), t(""), t("")),
        page(t("late"), t("http://late/"), t("x"), t("")),
    )
    responses = table(spark, sf, "pages").select(
        F.col("page_id").alias("query_id"), F.to_json(F.struct(pages.alias("pages"))).alias("response")
    )
    return W.web_candidates(responses, 3).select("query_id", "rank", "display_title", "content", "url")


RESPONSES_SQL = """r AS (SELECT p_partkey AS request_no, p_name, p_retailprice, CASE p_partkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'needs_clarification' WHEN 2 THEN 'strange' ELSE 'ok' END AS status,
   p_partkey % 7 = 3 AS no_id, p_partkey % 3 = 0 AS text_score, p_partkey % 11 = 4 AS bool_score FROM part)"""


def tool_responses(spark, sf):
    p = F.col("p_partkey")
    status = F.when(p % 5 == 0, F.lit("empty")).when(p % 5 == 1, F.lit("needs_clarification")).when(
        p % 5 == 2, F.lit("strange")
    ).otherwise(F.lit("ok"))
    number = F.col("p_retailprice").cast("string")
    score2 = F.when(p % 11 == 4, F.lit("true")).otherwise(number)
    text = F.concat(
        F.lit('{"status":"'),
        status,
        F.lit('","request_id":"q","clarification_question":" which? ","chunks":[{"chunk_id":"'),
        F.when(p % 7 == 3, F.lit(" ")).otherwise(F.lit(" c1 ")),
        F.lit('","document_id":"d","document_name":"'),
        "p_name",
        F.lit('","section_title":"","content":"x","score":'),
        F.when(p % 3 == 0, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number),
        F.lit('},{"chunk_id":"c2","document_id":"d","document_name":"n","content":"y","score":'),
        score2,
        F.lit("}]}"),
    )
    return table(spark, sf, "part").select(p.alias("request_no"), text.alias("response"))


@query(
    "knowledge_chunks",
    "S12",
    f"""WITH {RESPONSES_SQL} SELECT request_no, 'c1' AS chunk_id, p_name AS document_name, round(p_retailprice, 4) AS score FROM r WHERE status = 'ok' AND NOT no_id AND NOT text_score
        UNION ALL SELECT request_no, 'c2', 'n', round(p_retailprice, 4) FROM r WHERE status = 'ok' AND NOT bool_score""",
)
def knowledge_chunks(spark, sf):
    return W.knowledge_chunks(tool_responses(spark, sf)).select(
        "request_no", "chunk_id", "document_name", F.round("score", 4).alias("score")
    )


@query(
    "tool_response_status",
    "S12",
    f"""WITH {RESPONSES_SQL}, n AS (SELECT *, CASE WHEN status <> 'ok' THEN 0 ELSE (CASE WHEN no_id OR text_score THEN 0 ELSE 1 END) + (CASE WHEN bool_score THEN 0 ELSE 1 END) END AS n FROM r)
        SELECT request_no, CASE WHEN status = 'strange' THEN 'error' WHEN status = 'ok' AND n = 0 THEN 'empty' ELSE status END AS status, n::BIGINT AS n_chunks,
               CASE WHEN status = 'needs_clarification' THEN 'which?' ELSE '' END AS question FROM n""",
)
def tool_response_status(spark, sf):
    return W.response_status(tool_responses(spark, sf)).select(
        "request_no", "status", "n_chunks", F.coalesce("clarification_question", F.lit("")).alias("question")
    )


@query(
    "external_evidence",
    "S12",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'alt' END AS document_name, 'c' || page_id AS chunk_id, CASE WHEN page_id % 3 = 0 THEN '0.5' ELSE '0.25' END AS score FROM pages""",
)
def external_evidence(spark, sf):
    pid = F.col("page_id")
    rows = table(spark, sf, "pages").select(
        pid,
        F.when(pid % 2 == 0, F.col("url")).otherwise(F.lit("")).alias("document_name"),
        F.lit("alt").alias("document_keyword"),
        F.concat(F.lit("c"), pid.cast("string")).alias("id"),
        F.when(pid % 3 == 0, F.lit("0.5")).alias("similarity"),
        F.lit("0.25").alias("score"),
    )
    aliases = {
        "document_name": ["document_name", "document_keyword", "docnm_kwd"],
        "chunk_id": ["id", "chunk_id"],
        "score": ["similarity", "score"],
    }
    return W.normalised_evidence(rows, aliases, ["page_id"])


_BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def _sql_said(expression):
    for entity, character in _NAMED:
        expression = f"replace({expression}, '{entity}', '{character}')"
    return f"trim(regexp_replace({expression}, '{_BLANKS}', ' ', 'g'))"


_SQL_LOUD = "h"
for _tag in html_pages.SILENT:
    _SQL_LOUD = rf"regexp_replace({_SQL_LOUD}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', ' ', 'g')"


@query(
    "page_text",
    "S13",
    rf"""WITH p AS (SELECT page_id, url, html, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
t AS (SELECT *, {_sql_said(rf"regexp_replace(regexp_replace({_SQL_LOUD}, '(?is)<title\b[^>]*>.*?</title\s*>', ' ', 'g'), '<[A-Za-z/!?][^>]*>', ' ', 'g')")} AS said,
  list_filter(list_transform(regexp_extract_all(h, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), lambda x: {_sql_said("x")}), lambda x: x <> '') AS titles FROM p)
SELECT page_id, url, titles[-1] AS title,
  coalesce(nullif(regexp_extract(html, '(?i)"datePublished"\s*:\s*"([^"]+)"', 1), ''), nullif(regexp_extract(html, '(?i)"dateModified"\s*:\s*"([^"]+)"', 1), ''),
    nullif(regexp_extract(html, '(\d{{4}}-\d{{2}}-\d{{2}}(?:[T ][0-9:]+(?:Z|[+-]\d{{2}}:?\d{{2}})?)?)', 1), '')) AS published_at,
  left(said, 12000) AS content, len(said) > 12000 AS truncated FROM t""",
)
def page_text(spark, sf):
    return html_pages.read_pages(table(spark, sf, "pages"))


MD_IMAGES_SQL = r"""docs AS (SELECT doc_id, text, source, lang, replace(text, E'\n', E'\n![x](img/' || source || E'.png)\n![y](img/none-' || lang || E'.gif "t")\n') AS md FROM documents)"""


def image_documents(spark, sf):
    marks = F.concat(
        F.lit("\n![x](img/"), "source", F.lit('.png)\n![y](img/none-'), "lang", F.lit('.gif "t")\n')
    )
    return table(spark, sf, "documents").select(
        "doc_id", "source", "lang", F.replace("text", F.lit("\n"), marks).alias("md_content")
    )


def image_files(spark, sf):
    docs = table(spark, sf, "documents")
    names = F.array(F.concat("source", F.lit(".png")), F.concat("source", F.lit(".txt")), F.lit("unused.jpg"))
    return docs.select("doc_id", F.explode(names).alias("image_name"))


@query(
    "image_references",
    "S14",
    rf"""WITH {MD_IMAGES_SQL}, r AS (SELECT *, strpos(md, '![x](img/' || source || '.png)') AS p, len('![x](img/' || source || '.png)') AS n FROM docs WHERE contains(text, E'\n'))
        SELECT doc_id, source || '.png' AS image_name, substring(md, greatest(p - 100, 1)::BIGINT, least(p - 1, 100)::BIGINT) AS before, substring(md, (p + n)::BIGINT, 100) AS after FROM r""",
)
def image_references(spark, sf):
    return images.referenced_images(image_documents(spark, sf), image_files(spark, sf), key="doc_id")


@query(
    "image_rewrite",
    "S15",
    rf"""WITH {MD_IMAGES_SQL} SELECT doc_id, CASE WHEN lang = 'en' THEN md ELSE replace(md, '![x](img/' || source || '.png)', '![a $1 of ' || source || '](http://s/' || doc_id || ')') END AS md_content FROM docs""",
)
def image_rewrite(spark, sf):
    docs = image_documents(spark, sf)
    uploads = docs.where("lang <> 'en'").select(
        "doc_id",
        F.concat("source", F.lit(".png")).alias("image_name"),
        F.concat(F.lit("http://s/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("a $1 of "), "source").alias("summary"),
    )
    return images.rewrite_references(docs, uploads, key="doc_id").select("doc_id", "md_content")


@query(
    "document_routing",
    "S1",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'markdown' WHEN 'fr' THEN 'parse' ELSE 'unsupported' END AS route, source || '.v-' || doc_id AS file_title FROM documents""",
)
def document_routing(spark, sf):
    lang = F.col("lang")
    suffix = F.when(lang == "en", F.lit(".MD")).when(lang == "fr", F.lit(".pdf")).otherwise(F.lit(".docx"))
    path = F.concat(F.lit("/in/2024.01/"), "source", F.lit(".v-"), F.col("doc_id").cast("string"), suffix)
    routed = route_by_suffix(table(spark, sf, "documents").select("doc_id", path.alias("path")))
    return routed.select("doc_id", F.coalesce("route", F.lit("unsupported")).alias("route"), "file_title")


def gold_rows(spark, sf):
    """Gold rows as a CSV reader would give them, one per order, with flaws by position."""
    o = F.col("o_orderkey")
    flaw = lambda n: o % 40 == n
    context = lambda i: F.concat(F.lit('{"chunk_id":"'), i, F.lit('","file_title":"f","section_title":"s","content":"c"}'))
    answerable = F.col("o_orderstatus") != "P"
    contexts = (
        F.when(flaw(3), F.lit("[{broken"))
        .when(flaw(4), F.lit('[{"chunk_id":"a","file_title":"f","section_title":"s","content":"c","more":"x"}]'))
        .when(flaw(5), F.lit('[{"chunk_id":"g1","file_title":" ","section_title":"s","content":"c"}]'))
        .when(flaw(6), F.lit("[]"))
        .otherwise(F.concat(F.lit("["), context(F.lit("g1")), F.lit(","), context(F.lit("g2")), F.lit("]")))
    )
    must = F.when(flaw(7), F.lit('["g1","other"]')).when(flaw(8), F.lit('{"a":1}')).otherwise(F.lit('["g1"]'))
    return table(spark, sf, "orders").select(
        F.when(flaw(1), F.lit("same")).when(flaw(2), F.lit(" ")).otherwise(F.concat(F.lit("case-"), o.cast("string"))).alias("case_id"),
        F.when(flaw(9), F.lit("")).otherwise(F.lit("question")).alias("user_input"),
        F.when(flaw(10), F.lit(" ")).otherwise(F.lit("answer")).alias("reference"),
        F.when(answerable, contexts).otherwise(F.lit("[]")).alias("gold_contexts_json"),
        F.when(answerable & ~flaw(6), must).otherwise(F.lit("[]")).alias("must_hit_chunk_ids_json"),
        F.when(flaw(11), F.lit("yes")).when(answerable, F.lit("true")).otherwise(F.lit("FALSE")).alias("answerable"),
        F.when(flaw(12), F.lit("train")).otherwise(F.lit("dev")).alias("split"),
        F.when(flaw(13), F.lit("open")).otherwise(F.lit("draft")).alias("review_status"),
        F.lit("").alias("notes"),
        F.lit(None).cast("string").alias("malformed"),
        o.alias("row_number"),
    )


@query(
    "gold_case_rejects",
    "S3,P20",
    """WITH o AS (SELECT o_orderkey AS row_number, o_orderkey % 40 AS f, o_orderstatus <> 'P' AS a FROM orders)
       SELECT row_number, 'case_id_repeated' AS reason FROM o WHERE f IN (1, 2) AND (SELECT count(*) FROM o) > 80
       UNION ALL SELECT row_number, 'case_id_empty' FROM o WHERE f = 2
       UNION ALL SELECT row_number, 'gold_contexts_json' FROM o WHERE f = 3 AND a
       UNION ALL SELECT row_number, 'must_hit_not_gold' FROM o WHERE f IN (4) AND a
       UNION ALL SELECT row_number, 'gold_context_fields' FROM o WHERE f = 4 AND a
       UNION ALL SELECT row_number, 'gold_context_blank' FROM o WHERE f = 5 AND a
       UNION ALL SELECT row_number, 'answerable_without_evidence' FROM o WHERE f IN (3, 6, 10) AND a
       UNION ALL SELECT row_number, 'must_hit_not_gold' FROM o WHERE f = 7 AND a
       UNION ALL SELECT row_number, 'must_hit_json' FROM o WHERE f = 8 AND a
       UNION ALL SELECT row_number, 'user_input_empty' FROM o WHERE f = 9
       UNION ALL SELECT row_number, 'unanswerable_without_reference' FROM o WHERE f = 10 AND NOT a
       UNION ALL SELECT row_number, 'answerable_value' FROM o WHERE f = 11
       UNION ALL SELECT row_number, 'unanswerable_with_evidence' FROM o WHERE f = 11 AND a
       UNION ALL SELECT row_number, 'split_value' FROM o WHERE f = 12
       UNION ALL SELECT row_number, 'review_status_value' FROM o WHERE f = 13""",
)
def gold_case_rejects(spark, sf):
    rows = G.checked(gold_rows(spark, sf))
    return rows.select("row_number", F.explode_outer("problems").alias("reason")).where("reason IS NOT NULL")


FILTERS_SQL = (
    "raw AS (SELECT doc_id, source, lang, split(text, ' ') AS w, doc_id % 3 = 0 AS strict FROM documents), "
    + _unique_cte("u", "raw", "w", 10)
    + ", k AS (SELECT raw.*, coalesce(u.v, []) AS topics FROM raw LEFT JOIN u USING (doc_id))"
)


def raw_filters(spark, sf):
    source = F.col("source")
    w = F.split("text", " ")
    return table(spark, sf, "documents").select(
        "doc_id",
        "text",
        F.struct(
            F.lit(None).cast("array<string>").alias("file_titles"),
            F.when(source == "src1", F.array().cast("array<string>")).otherwise(F.array(source, source)).alias("region_names"),
            F.array(F.lit(" 政策 "), F.lit("小说")).alias("document_types"),
            w.alias("topics"),
            F.array().cast("array<string>").alias("keywords"),
            F.array(F.lit("region_names"), F.lit("file_titles"), F.lit("document_types")).alias("hard_fields"),
            F.when(F.col("doc_id") % 3 == 0, F.lit(True)).alias("strict"),
        ).alias("raw"),
    )


@query(
    "query_filter_normalisation",
    "P8,P2",
    f"""WITH {FILTERS_SQL} SELECT doc_id, '' AS file_titles, CASE WHEN source = 'src1' THEN '' ELSE source END AS region_names, '政策' AS document_types, array_to_string(topics, '|') AS topics,
          CASE WHEN source = 'src1' THEN 'document_types' ELSE 'region_names|document_types' END AS hard_fields, strict FROM k""",
)
def query_filter_normalisation(spark, sf):
    rows = raw_filters(spark, sf).select("doc_id", Q.normalise_filters(F.col("raw")).alias("f"))
    return rows.select(
        "doc_id",
        *[A.join(F.col(f"f.{x}")).alias(x) for x in ("file_titles", "region_names", "document_types", "topics", "hard_fields")],
        "f.strict",
    )


@query(
    "query_understanding",
    "P9,U4,X15",
    f"""WITH q AS (SELECT conv_id, turn, text AS original, {collapse("CASE WHEN turn % 3 = 0 THEN text || ' ' || text || ' ' || text ELSE '' END")} AS rw, {collapse('text')} AS plain FROM conversations WHERE role = 'user'),
        r AS (SELECT *, CASE WHEN rw <> '' THEN rw ELSE plain END AS rewritten FROM q)
        SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN left(original, 200) WHEN len(rewritten) > 200 THEN regexp_replace(left(original, 200), '[{SPACE}]+$', '') ELSE rewritten END AS rewritten_query,
          CASE WHEN turn % 5 <> 4 AND turn % 2 = 0 THEN 'region_names|document_types' ELSE '' END AS hard_fields, turn % 5 <> 4 AND turn % 4 = 2 AS needs_clarification,
          CASE WHEN turn % 5 <> 4 AND turn % 4 = 2 THEN '当前问题中的指代或限定范围不明确，请补充具体问题。' ELSE '' END AS clarification_question FROM r""",
)
def query_understanding(spark, sf):
    """The model's answer is given as text around a JSON object; an unreadable answer falls back to the query."""
    turn, text = F.col("turn"), F.col("text")
    said = F.to_json(
        F.struct(
            F.when(turn % 3 == 0, F.concat(text, F.lit(" "), text, F.lit(" "), text)).otherwise(F.lit("")).alias("rewritten_query"),
            F.array(F.lit("北京")).alias("region_names"),
            F.array(F.lit("标准")).alias("document_types"),
            F.array(F.lit("file_titles")).alias("hard_fields"),
            (turn % 2 == 0).alias("strict"),
            (turn % 4 == 2).alias("needs_clarification"),
        )
    )
    answer = F.when(turn % 5 == 4, F.lit("sorry")).otherwise(F.concat(F.lit("```json\n"), said, F.lit("\n```")))
    rows = table(spark, sf, "conversations").where("role = 'user'").withColumn("answer", answer)
    raw = F.from_json(F.nullif(T.json_object_text(F.col("answer")), F.lit("")), schemas.UNDERSTANDING)
    out = rows.withColumn("raw", raw).withColumn("u", Q.normalise_understanding(F.col("raw"), text))
    ok = F.col("raw").isNotNull()
    return out.select(
        "conv_id",
        "turn",
        F.when(ok, F.col("u.rewritten_query")).otherwise(F.left(text, F.lit(Q.REWRITTEN_MAX_CHARS))).alias("rewritten_query"),
        F.when(ok, A.join(F.col("u.query_filters.hard_fields"))).otherwise(F.lit("")).alias("hard_fields"),
        F.when(ok, F.col("u.needs_clarification")).otherwise(F.lit(False)).alias("needs_clarification"),
        F.when(ok, F.col("u.clarification_question")).otherwise(F.lit("")).alias("clarification_question"),
    )


@query(
    "hard_metadata_filter",
    "P10,J10",
    """SELECT s_suppkey AS query_id, c_mktsegment AS document_type, n FROM supplier JOIN (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) c
       ON (s_suppkey % 3 = 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY')) AND (c_nationkey = s_nationkey OR (s_suppkey % 2 = 0 AND c_nationkey = 0))""",
)
def hard_metadata_filter(spark, sf):
    """Chunks stand for customers: a query's allowed regions turn the predicate into an equi-join."""
    from evispark.operators.retrieval import NATIONWIDE, allowed

    s = F.col("s_suppkey")
    region = F.when(F.col("c_nationkey") == 0, F.lit(NATIONWIDE)).otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    filters = F.struct(
        F.array(F.when(F.col("s_nationkey") == 0, F.lit(NATIONWIDE)).otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))).alias("region_names"),
        F.array(F.lit("BUILDING"), F.lit("MACHINERY")).alias("document_types"),
        F.when(s % 3 == 0, F.array(F.lit("region_names"))).otherwise(F.array(F.lit("region_names"), F.lit("document_types"))).alias("hard_fields"),
        (s % 2 == 1).alias("strict"),
    )
    queries = table(spark, sf, "supplier").select(s.alias("query_id"), filters.alias("filters"))
    chunks = table(spark, sf, "customer").groupBy(region.alias("region"), "c_mktsegment").agg(F.count("*").alias("n"))
    f = F.col("filters")
    wide = F.when(f["strict"], f["region_names"]).otherwise(F.array_union(f["region_names"], F.array(F.lit(NATIONWIDE))))
    met = queries.withColumn("region", F.explode(wide)).join(chunks, "region")
    return met.where(allowed(f, F.col("c_mktsegment"), F.array("region"))).select(
        "query_id", F.col("c_mktsegment").alias("document_type"), "n"
    )


@query(
    "query_input_rejects",
    "P21,P27",
    f"""WITH q AS (SELECT conv_id, turn, {collapse("repeat(CASE WHEN turn = 3 THEN '  ' ELSE text || ' ' END, CASE WHEN role = 'user' THEN 6 ELSE 1 END)")} AS q, conv_id % 9 = 0 AS no_session FROM conversations)
        SELECT conv_id, turn, 'session_id_empty' AS reason FROM q WHERE no_session UNION ALL SELECT conv_id, turn, 'query_empty' FROM q WHERE q = ''
        UNION ALL SELECT conv_id, turn, 'query_too_long' FROM q WHERE len(q) > 2000""",
)
def query_input_rejects(spark, sf):
    text = F.repeat(
        F.when(F.col("turn") == 3, F.lit("  ")).otherwise(F.concat("text", F.lit(" "))),
        F.when(F.col("role") == "user", 6).otherwise(1),
    )
    session = F.when(F.col("conv_id") % 9 == 0, F.lit("  ")).otherwise(F.col("conv_id").cast("string"))
    return rules.rejects(table(spark, sf, "conversations"), ["conv_id", "turn"], P.query_input_rules(session, text))


@query(
    "stage_input_rejects",
    "P27",
    f"""SELECT doc_id, 'no_text_to_embed' AS reason FROM documents WHERE source = 'src6' OR {strip('text')} = ''""",
)
def stage_input_rejects(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.lit(" ").alias("embedding_text"),
        F.when(F.col("source") == "src6", F.lit(None)).otherwise(F.col("text")).alias("content"),
    )
    return rules.rejects(rows, ["doc_id"], P.embeddable_rules())


@query(
    "project_request_rejects",
    "P23",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN 'x' ELSE p_name END AS topic, p_size % 7 AS z, p_size - 25 AS years FROM part)
       SELECT p_partkey, 'topic_length' AS reason FROM r WHERE len(topic) < 2 OR len(topic) > 200
       UNION ALL SELECT p_partkey, 'region_scope_unknown' FROM r WHERE z = 2 UNION ALL SELECT p_partkey, 'years_missing' FROM r WHERE z = 3
       UNION ALL SELECT p_partkey, 'years_range' FROM r WHERE z NOT IN (3) AND NOT years BETWEEN 1 AND 20
       UNION ALL SELECT p_partkey, 'time_scope_unknown' FROM r WHERE z = 4 UNION ALL SELECT p_partkey, 'target_audience_length' FROM r WHERE z = 5""",
)
def project_request_rejects(spark, sf):
    z = F.col("p_size") % 7
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") == 1, F.lit("x")).otherwise(F.col("p_name")).alias("topic"),
        F.lit("a goal").alias("research_goal"),
        F.when(z == 5, F.repeat(F.lit("a"), F.lit(101))).otherwise(F.lit("public")).alias("target_audience"),
        F.when(z == 2, F.lit("mars")).otherwise(F.lit("global")).alias("region_scope"),
        F.when(z == 4, F.lit("always")).otherwise(F.lit("recent_years")).alias("time_scope"),
        F.when(z != 3, F.col("p_size") - 25).alias("years"),
    )
    return rules.rejects(rows, ["p_partkey"], P.project_rules(F.col))


@query(
    "outline_request_rejects",
    "P23",
    """WITH r AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'revise' WHEN 'assistant' THEN 'confirm' ELSE 'drop' END AS action, CASE WHEN turn % 4 = 1 THEN '' WHEN turn % 4 = 2 THEN 'x' ELSE text END AS ins FROM conversations)
       SELECT conv_id, turn, 'action_unknown' AS reason FROM r WHERE action = 'drop' UNION ALL SELECT conv_id, turn, 'instruction_missing' FROM r WHERE action = 'revise' AND ins = ''
       UNION ALL SELECT conv_id, turn, 'instruction_length' FROM r WHERE ins <> '' AND NOT len(ins) BETWEEN 2 AND 1000""",
)
def outline_request_rejects(spark, sf):
    role, t4 = F.col("role"), F.col("turn") % 4
    action = F.when(role == "user", F.lit("revise")).when(role == "assistant", F.lit("confirm")).otherwise(F.lit("drop"))
    instruction = F.when(t4 == 1, F.lit("")).when(t4 == 2, F.lit("x")).otherwise(F.col("text"))
    return rules.rejects(
        table(spark, sf, "conversations"), ["conv_id", "turn"], P.outline_update_rules(action, instruction)
    )


@query(
    "recent_messages",
    "S7",
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS recency FROM conversations
       QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""",
)
def recent_messages_query(spark, sf):
    return recent_messages(table(spark, sf, "conversations"), 4, "conv_id", "turn").select("conv_id", "turn", "role", "recency")


@query(
    "history_upsert_and_clear",
    "S7",
    """SELECT conv_id AS session_id, conv_id || '-' || turn AS message_id, CASE WHEN role = 'assistant' THEN 'edited' ELSE text END AS text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE len(text) > 1500)
       UNION ALL SELECT conv_id, conv_id || '-n' || turn, 'new' FROM conversations WHERE role = 'system' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE len(text) > 1500)""",
)
def history_upsert_and_clear(spark, sf):
    rows = table(spark, sf, "conversations")
    ident = lambda mark: F.concat(F.col("conv_id").cast("string"), F.lit(mark), F.col("turn").cast("string"))
    shape = lambda df, mark, text: df.select(F.col("conv_id").alias("session_id"), ident(mark).alias("message_id"), text.alias("text"))
    history = shape(rows, "-", F.col("text"))
    edited = shape(rows.where("role = 'assistant'"), "-", F.lit("edited"))
    new = shape(rows.where("role = 'system'"), "-n", F.lit("new"))
    gone = rows.where(F.length("text") > 1500).select(F.col("conv_id").alias("session_id"))
    return S.clear_sessions(S.save_messages(S.save_messages(history, edited), new), gone)


@query(
    "public_history",
    "P26",
    """SELECT conv_id || '-' || turn AS message_id, CASE WHEN role = 'system' THEN '' ELSE role END AS role, text, '' AS rewritten_query, 0 AS n_images,
         CASE WHEN turn % 3 = 0 THEN 'recall' ELSE '' END AS mode FROM conversations""",
)
def public_history(spark, sf):
    t3 = F.col("turn") % 3
    rows = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.when(F.col("role") != "system", F.col("role")).alias("role"),
        "text",
        F.lit(None).cast("string").alias("rewritten_query"),
        F.lit(None).cast("array<string>").alias("item_names"),
        F.lit(None).cast("array<string>").alias("image_urls"),
        F.when(t3 == 0, F.lit('{"mode":"recall"}')).when(t3 == 1, F.lit('{"mode":"old"}')).otherwise(F.lit("{x")).alias("retrieval_metadata"),
        F.col("turn").alias("ts"),
    )
    out = S.public_history(rows, "struct<mode:string,mode_label:string>")
    return out.select(
        "message_id",
        "role",
        "text",
        "rewritten_query",
        F.size("image_urls").alias("n_images"),
        F.coalesce("retrieval_metadata.mode", F.lit("")).alias("mode"),
    )
