"""Scalar text functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.catalog.registry import query
from evispark.catalog.sqltext import SPACE, collapse, strip
from evispark.functions import arrays as A
from evispark.functions import text as T
from evispark.session import table


@query(
    "token_estimate",
    "X1",
    rf"""SELECT doc_id, len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+|[^{SPACE}]'))::INT AS token_count
         FROM documents""",
)
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("token_count"))


@query("whitespace_collapse", "X2", f"SELECT doc_id, {collapse('text')} AS clean_text FROM documents")
def whitespace_collapse(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.collapse(F.col("text")).alias("clean_text"))


@query(
    "heading_cleaner",
    "X3",
    f"""WITH h AS (SELECT p_partkey, CASE WHEN p_size < 4 THEN '<br/>  ##'
                  ELSE '  <i>' || p_brand || '</i>  ' || p_name || '   ### ' END AS raw FROM part),
        c AS (SELECT p_partkey, {strip(f"regexp_replace(raw, '[{SPACE}]+#+[{SPACE}]*$', '')")} AS t FROM h),
        d AS (SELECT p_partkey, {collapse("regexp_replace(t, '<[^>]+>', '', 'g')")} AS t FROM c)
        SELECT p_partkey, CASE WHEN t = '' THEN '未命名章节' ELSE t END AS heading FROM d""",
)
def heading_cleaner(spark, sf):
    raw = F.when(F.col("p_size") < 4, F.lit("<br/>  ##")).otherwise(
        F.concat(F.lit("  <i>"), "p_brand", F.lit("</i>  "), "p_name", F.lit("   ### "))
    )
    return table(spark, sf, "part").select("p_partkey", T.clean_heading(raw).alias("heading"))


@query(
    "url_fragment_removal",
    "X4",
    "SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS url FROM pages",
)
def url_fragment_removal(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.without_fragment(F.col("url")).alias("url"))


@query(
    "image_url_test",
    "X5",
    """WITH u AS (SELECT page_id, CASE WHEN url LIKE '%#top' THEN replace(url, '#top', '/Cover.PNG?w=1#top')
                   WHEN url LIKE '%.html' THEN replace(url, '.html', '.webp') ELSE url || '&f=x.jpg' END AS url FROM pages)
       SELECT page_id, regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(jpg|jpeg|png|gif|bmp|webp)$') AS is_image
       FROM u""",
)
def image_url_test(spark, sf):
    url = F.col("url")
    shaped = (
        F.when(url.endswith("#top"), F.replace(url, F.lit("#top"), F.lit("/Cover.PNG?w=1#top")))
        .when(url.endswith(".html"), F.replace(url, F.lit(".html"), F.lit(".webp")))
        .otherwise(F.concat(url, F.lit("&f=x.jpg")))
    )
    return table(spark, sf, "pages").select("page_id", T.is_image_url(shaped).alias("is_image"))


@query(
    "http_url_test",
    "X6",
    """SELECT page_id, starts_with(u, 'http://') OR starts_with(u, 'https://') AS is_http
       FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, 'http', 'ftp') ELSE '  ' || url END AS raw,
                    trim(raw) AS u FROM pages)""",
)
def http_url_test(spark, sf):
    url = F.when(F.col("page_id") % 5 == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(
        F.concat(F.lit("  "), "url")
    )
    return table(spark, sf, "pages").select("page_id", T.is_http_url(url).alias("is_http"))


@query(
    "placeholder_test",
    "X7",
    """SELECT doc_id, regexp_matches(t, '占位|待生成|稍后补充|待补充|TODO|真实内容将在|尚未接入真实') AS has_placeholder
       FROM (SELECT doc_id, CASE source WHEN 'src3' THEN text || ' TODO' WHEN 'src5' THEN '待补充' || text
                    WHEN 'src7' THEN text || ' todo' ELSE text END AS t FROM documents)""",
)
def placeholder_test(spark, sf):
    shaped = (
        F.when(F.col("source") == "src3", F.concat("text", F.lit(" TODO")))
        .when(F.col("source") == "src5", F.concat(F.lit("待补充"), "text"))
        .when(F.col("source") == "src7", F.concat("text", F.lit(" todo")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select(
        "doc_id", T.contains_any(shaped, T.SECTION_PLACEHOLDERS).alias("has_placeholder")
    )


@query(
    "enum_with_fallback",
    "X8,X22",
    """WITH v AS (SELECT o_orderkey, CASE WHEN lower(trim(substr(o_orderpriority, 3))) IN ('high', 'medium', 'low')
                    THEN lower(trim(substr(o_orderpriority, 3))) ELSE 'medium' END AS severity FROM orders)
       SELECT o_orderkey, severity, CASE severity WHEN 'high' THEN '高置信度' WHEN 'low' THEN '低置信度'
              ELSE '中置信度' END AS label FROM v""",
)
def enum_with_fallback(spark, sf):
    severity = T.choice(F.substring("o_orderpriority", 3, 100), ("high", "medium", "low"), "medium")
    return (
        table(spark, sf, "orders")
        .select("o_orderkey", severity.alias("severity"))
        .withColumn("label", T.confidence_label(F.col("severity")))
    )


@query(
    "ellipsized_text",
    "X9",
    """SELECT doc_id, CASE WHEN len(text) > 500 THEN left(text, 497) || '...' ELSE text END AS short_text FROM documents""",
)
def ellipsized_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ellipsize(F.col("text"), 500).alias("short_text"))


@query(
    "task_error_summary",
    "X10",
    f"""SELECT doc_id, CASE WHEN d = '' THEN '报告任务失败: ' || lang || 'Error'
              ELSE '报告任务失败: ' || lang || 'Error: ' || left(d, 500) END AS message
        FROM (SELECT doc_id, lang, {strip("CASE WHEN source = 'src1' THEN '   ' ELSE text END")} AS d FROM documents)""",
)
def task_error_summary(spark, sf):
    detail = F.when(F.col("source") == "src1", F.lit("   ")).otherwise(F.col("text"))
    summary = T.error_summary(F.lit("报告任务失败"), F.concat("lang", F.lit("Error")), detail)
    return table(spark, sf, "documents").select("doc_id", summary.alias("message"))


@query(
    "page_title_and_date",
    "X11,S13",
    f"""WITH p AS (SELECT page_id, CASE WHEN url LIKE '%#top' THEN html || '<script>{{"datePublished" : "2024-03-05T10:00:00Z"}}</script>'
                   WHEN url LIKE '%.html' THEN html || '<p>2023-11-30 12:00+08:00</p>' ELSE html END AS html FROM pages)
        SELECT page_id, {collapse("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')")} AS title,
          coalesce(nullif(regexp_extract(html, '(?i)"datePublished"\\s*:\\s*"([^"]+)"', 1), ''),
                   nullif(regexp_extract(html, '(?i)"dateModified"\\s*:\\s*"([^"]+)"', 1), ''),
                   nullif(regexp_extract(html, '(\\d{{4}}-\\d{{2}}-\\d{{2}}(?:[T ][0-9:]+(?:Z|[+-]\\d{{2}}:?\\d{{2}})?)?)', 1), ''), '') AS published_at
        FROM p""",
)
def page_title_and_date(spark, sf):
    url, html = F.col("url"), F.col("html")
    dated = (
        F.when(
            url.endswith("#top"), F.concat(html, F.lit('<script>{"datePublished" : "2024-03-05T10:00:00Z"}</script>'))
        )
        .when(url.endswith(".html"), F.concat(html, F.lit("<p>2023-11-30 12:00+08:00</p>")))
        .otherwise(html)
    )
    return (
        table(spark, sf, "pages")
        .select("page_id", dated.alias("html"))
        .select("page_id", T.page_title(F.col("html")).alias("title"), T.page_date(F.col("html")).alias("published_at"))
    )


@query(
    "section_anchor",
    "X12",
    f"""SELECT page_id, 'section-' || regexp_replace({collapse('url')}, '[^\\p{{L}}\\p{{N}}_-]', '-', 'g') AS anchor FROM pages""",
)
def section_anchor(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.section_anchor(F.col("url"), F.lit("")).alias("anchor"))


HEADED = r"""SELECT doc_id, E'\n\n## ' || source || E' ##\n\n' || replace(text, E'\n', E'\n\n### ' || lang || E'\n') AS body
             FROM documents"""


def headed_bodies(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("\n\n## "),
            "source",
            F.lit(" ##\n\n"),
            F.replace("text", F.lit("\n"), F.concat(F.lit("\n\n### "), "lang", F.lit("\n"))),
        ).alias("body"),
    )


@query(
    "section_body_trim",
    "X13",
    rf"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(body, '^\n+', ''),
                    '^#{{1,6}}\s+[^\n]+?(?:\s+#{{1,6}})?\s*\n', ''), '^\n+', '') AS b FROM ({HEADED})),
         t AS (SELECT doc_id, b, len(regexp_extract(b, '(?s)^(.*?)\n#{{2,6}}\s+', 1)) AS spot,
                      regexp_matches(b, '\n#{{2,6}}\s+') AS cut FROM s)
         SELECT doc_id, b AS body, CASE WHEN cut THEN {strip("left(b, spot)")} ELSE b END AS overview FROM t""",
)
def section_body_trim(spark, sf):
    body = T.strip_leading_heading(F.col("body"))
    return (
        headed_bodies(spark, sf)
        .select("doc_id", body.alias("body"))
        .withColumn("overview", T.before_first_subheading(F.col("body")))
    )


@query(
    "citation_labels",
    "X14",
    """SELECT o_orderkey, '[' || o_custkey || '][' || o_orderpriority || ']' || CASE WHEN o_orderstatus = 'O' THEN '' ELSE '[O-1]' END
              AS citations FROM orders""",
)
def citation_labels(spark, sf):
    ids = F.array(
        F.concat(F.lit(" source-"), F.col("o_custkey").cast("string")),
        F.lit("  "),
        F.col("o_orderpriority"),
        F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.lit("source-O-1")),
    )
    return table(spark, sf, "orders").select("o_orderkey", T.citation_labels(ids).alias("citations"))


@query(
    "json_object_in_text",
    "X15",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE props END AS object_text,
              CASE WHEN event_type = 'view' THEN -1 ELSE json_extract_string(props, '$.k')::INT END AS k FROM events""",
)
def json_object_in_text(spark, sf):
    kind = F.col("event_type")
    said = (
        F.when(kind == "click", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(kind == "error", F.concat(F.lit("Here it is: "), "props", F.lit(" done")))
        .when(kind == "view", F.lit("no object } here {"))
        .otherwise(F.col("props"))
    )
    return (
        table(spark, sf, "events")
        .select("event_id", T.json_object_text(said).alias("object_text"))
        .withColumn("k", F.coalesce(F.get_json_object("object_text", "$.k").cast("int"), F.lit(-1)))
    )


@query(
    "bounded_integers",
    "X16",
    """SELECT p_partkey, greatest(10, least(50, 2 * p_size)) AS ann_limit,
              greatest(1, least(6, p_size % 9)) AS top_k FROM part""",
)
def bounded_integers(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        T.clamp(2 * F.col("p_size"), 10, 50).alias("ann_limit"),
        T.clamp(F.col("p_size") % 9, 1, 6).alias("top_k"),
    )


@query(
    "source_dedup_key",
    "X17",
    """WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE url END AS url,
                 CASE WHEN page_id % 6 = 0 THEN '' ELSE trim(regexp_extract(html, '<title>(.*?)</title>', 1)) END AS title FROM pages)
       SELECT page_id, coalesce(nullif(trim(url), ''), CASE WHEN title <> '' THEN 'public_web:' || title END, '-') AS source_key
       FROM s""",
)
def source_dedup_key(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.lit(" ")).otherwise(F.col("url"))
    title = F.when(F.col("page_id") % 6 == 0, F.lit("")).otherwise(
        F.regexp_extract("html", "<title>(.*?)</title>", 1)
    )
    key = F.coalesce(T.source_key(url, F.lit("public_web"), title), F.lit("-"))
    return table(spark, sf, "pages").select("page_id", key.alias("source_key"))


@query(
    "prompt_rendering",
    "X18",
    """SELECT conv_id, turn, '角色 ' || role || E'\n内容 {text}: ' || text || E'\n轮次 ' || turn || '/' || turn AS prompt
       FROM conversations""",
)
def prompt_rendering(spark, sf):
    template = "角色 {role}\n内容 {text}: {body}\n轮次 {turn}/{turn}"
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        T.render(template, role=F.col("role"), body=F.col("text"), turn=F.col("turn")).alias("prompt"),
    )


@query(
    "compact_json_text",
    "X19",
    """SELECT doc_id, to_json({'id': doc_id, 'lang': lang, 'source': source, 'text': text}) AS json_text FROM documents""",
)
def compact_json_text(spark, sf):
    packed = F.struct(F.col("doc_id").alias("id"), "lang", "source", "text")
    return table(spark, sf, "documents").select("doc_id", F.to_json(packed).alias("json_text"))


@query(
    "sha256_identifier",
    "X20",
    "SELECT doc_id, sha256(source || '|' || doc_id) AS row_key, sha256(text) AS text_key FROM documents",
)
def sha256_identifier(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        T.sha256_hex(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("row_key"),
        T.sha256_hex(F.col("text")).alias("text_key"),
    )


@query(
    "vector_math",
    "X21,V2",
    """SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm,
              len(embedding)::INT AS dim, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite FROM embeddings""",
)
def vector_math(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(A.norm(v), 9).alias("norm"), F.size(v).alias("dim"), A.all_finite(v).alias("finite")
    )
