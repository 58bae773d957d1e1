"""Ways of cutting and joining blocks over the given tables; the checking SQL walks unit numbers by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.catalog import ingest as I
from evispark.catalog import retrieval as Q
from evispark.catalog import views as V
from evispark.catalog.registry import query
from evispark.catalog.sqltext import SPACE, strip
from evispark.functions import arrays as A
from evispark.operators import chunking as K
from evispark.operators import chunks as C
from evispark.session import table

SIZES = (C.CHUNK_MAX_SIZE, C.CHUNK_SIZE, C.CHUNK_OVERLAP)


def sql_text(value: str) -> str:
    return "E'" + value.replace("\n", "\\n") + "'"


def units_sql(text: str, size: str) -> str:
    """A list: a short text whole, a long one by sentences, and long sentences by characters."""
    marked = f"regexp_replace(regexp_replace({text}, '([。！？；.!?;])[{SPACE}]*', '\\1\x01', 'g'), '\\n+', '\x01', 'g')"
    sentences = f"list_filter(list_transform(split({marked}, '\x01'), lambda s: {strip('s')}), lambda s: s <> '')"
    sliced = f"flatten(list_transform({sentences}, lambda s: list_transform(range(0, len(s), {size}), lambda p: substring(s, (p + 1)::BIGINT, {size}))))"
    return f"CASE WHEN len({text}) <= {size} THEN [{text}] ELSE {sliced} END"


def text_cut_sql(name: str, source: str) -> str:
    """``source``: k, b, c and head, the heading line or ''. Gives ``name``: k, b, piece, c."""
    most, target, overlap = SIZES
    paragraphs = f"list_filter(list_transform(regexp_split_to_array(c, '\\n[{SPACE}]*\\n'), lambda p: {strip('p')}), lambda p: p <> '')"
    room = f"CASE WHEN piece > 0 AND head <> '' AND NOT starts_with(cur, head) AND {most - 1} - len(head) > 0 THEN {most - 1} - len(head) ELSE {most} END::BIGINT"
    return f"""{name}_units AS (
  SELECT k, b, unnest(u) AS u, unnest(range(len(u))) AS i
  FROM (SELECT k, b, flatten(list_transform(p, lambda x: {units_sql("x", str(target))})) AS u FROM (SELECT k, b, {paragraphs} AS p FROM {source} WHERE len(c) > {most}))),
{name}_walk AS (
  SELECT k, b, i, 0 AS piece, u AS cur FROM {name}_units WHERE i = 0
  UNION ALL
  SELECT k, b, i, CASE WHEN spills THEN piece + 1 ELSE piece END,
    CASE WHEN spills THEN {strip(f"right(cur, {overlap}) || E'\\n' || u")} ELSE cur || E'\\n\\n' || u END
  FROM (SELECT w.k, w.b, n.i, n.u, w.piece, w.cur, len(w.cur) + 2 + len(n.u) > {target} AS spills
        FROM {name}_walk w JOIN {name}_units n ON n.k = w.k AND n.b = w.b AND n.i = w.i + 1)),
{name}_pieces AS (SELECT k, b, piece, arg_max(cur, i) AS cur FROM {name}_walk GROUP BY k, b, piece),
{name}_room AS (SELECT p.*, head, {room} AS room FROM {name}_pieces p JOIN {source} USING (k, b)),
{name}_small AS (
  SELECT k, b, piece, unnest(s) AS s, unnest(range(len(s))) AS j, CASE WHEN room < {most} THEN head || E'\\n' ELSE '' END AS again
  FROM (SELECT *, {units_sql("cur", "room")} AS s FROM {name}_room)),
{name} AS (
  SELECT k, b, 0::BIGINT AS piece, c FROM {source} WHERE len(c) <= {most}
  UNION ALL
  SELECT k, b, row_number() OVER (PARTITION BY k, b ORDER BY piece, j) - 1, again || s FROM {name}_small)"""


def row_cut_sql(name: str, source: str, sep: str) -> str:
    """``source``: k, c, rows, pre and suf. Gives ``name``: k, piece, c."""
    most = SIZES[0]
    return f"""{name}_rows AS (SELECT k, pre, suf, unnest(rows) AS r, unnest(range(len(rows))) AS i FROM {source} WHERE len(c) > {most}),
{name}_walk AS (
  SELECT k, i, 0 AS piece, len(pre) + len(suf) + len(r) AS size FROM {name}_rows WHERE i = 0
  UNION ALL
  SELECT n.k, n.i, CASE WHEN w.size + {len(sep)} + len(n.r) > {most} THEN w.piece + 1 ELSE w.piece END,
    CASE WHEN w.size + {len(sep)} + len(n.r) > {most} THEN len(pre) + len(suf) + len(n.r) ELSE w.size + {len(sep)} + len(n.r) END
  FROM {name}_walk w JOIN {name}_rows n ON n.k = w.k AND n.i = w.i + 1),
{name} AS (
  SELECT k, 0::BIGINT AS piece, c FROM {source} WHERE len(c) <= {most}
  UNION ALL
  SELECT k, piece::BIGINT, any_value(pre) || string_agg(r, {sql_text(sep)} ORDER BY i) || any_value(suf) FROM {name}_walk JOIN {name}_rows USING (k, i) GROUP BY k, piece)"""


def merge_sql(name: str, source: str) -> str:
    """``source``: k, i (from 0, no gaps), c, kind, path (a list), title. Gives ``name``: k, block, c, kind, path, title."""
    both = strip("w.c || E'\\n\\n' || n.c")
    return f"""{name}_walk AS (
  SELECT k, i, 0 AS block, c, kind, path, title FROM {source} WHERE i = 0
  UNION ALL
  SELECT k, i, CASE WHEN joins THEN block ELSE block + 1 END, CASE WHEN joins THEN together ELSE c END, kind,
    CASE WHEN NOT joins THEN path WHEN last_title <> title THEN last_path[1:len(last_path) - 1] ELSE last_path END,
    CASE WHEN joins AND last_title <> title THEN concat_ws('；', nullif(last_title, ''), nullif(title, '')) ELSE title END
  FROM (
    SELECT n.k, n.i, w.block, n.c, n.kind, n.path, n.title, w.path AS last_path, w.title AS last_title, {both} AS together,
      w.kind = 'text' AND n.kind = 'text' AND len({both}) <= {SIZES[0]}
        AND (w.path = n.path OR (len(w.c) < {C.CHUNK_MIN} AND len(n.c) < {C.CHUNK_MIN} AND w.path[1] IS NOT DISTINCT FROM n.path[1])) AS joins
    FROM {name}_walk w JOIN {source} n ON n.k = w.k AND n.i = w.i + 1)),
{name} AS (
  SELECT k, block, arg_max(c, i) AS c, arg_max(kind, i) AS kind, arg_max(path, i) AS path, arg_max(title, i) AS title FROM {name}_walk GROUP BY k, block)"""


@query(
    "oversize_unit_split",
    "C4",
    f"SELECT doc_id, unnest(u) AS unit, unnest(range(len(u)))::INT AS place FROM (SELECT doc_id, {units_sql('text', '40')} AS u FROM documents)",
)
def oversize_unit_split(spark, sf):
    """Units of at most 40 characters, so that many sentences are cut."""
    units = table(spark, sf, "documents").select("doc_id", F.posexplode(K.small_units(F.col("text"), F.lit(40))).alias("place", "unit"))
    return units.select("doc_id", "unit", "place")


def cut_blocks(docs, kind: str):
    """Pieces of one block per document: doc_id, content."""
    block = F.struct(F.col("content"), F.lit(kind).alias("context_type"), F.array(F.lit("p")).alias("path"), F.lit("t").alias("title"))
    pieces = docs.select("doc_id", F.posexplode_outer(K.refined(F.array(block), *SIZES)).alias("piece", "b"))
    return pieces.select("doc_id", F.col("piece").cast("long").alias("piece"), F.col("b.content").alias("content"))


@query(
    "text_packing",
    "C5",
    f"""WITH RECURSIVE src AS (SELECT doc_id AS k, 0 AS b, {strip("'# ' || source || E'\\n\\n' || text")} AS c, '# ' || source AS head FROM documents),
    {text_cut_sql("cut", "src")}
    SELECT k AS doc_id, piece, c AS content FROM cut""",
)
def text_packing(spark, sf):
    from evispark.functions import text as T

    content = T.strip(F.concat(F.lit("# "), "source", F.lit("\n\n"), "text"))
    return cut_blocks(table(spark, sf, "documents").select("doc_id", content.alias("content")), "text")


PIPE_HEAD = "Table 1 lines\n| line | n |\n|---|---|\n"
HTML_HEAD = "<table><tr><th>line</th></tr>"


def pipe_rows_sql(text: str) -> str:
    return f"list_transform(split({text}, E'\\n'), lambda x: '| ' || replace(x, '|', '/') || ' | 1 |')"


def html_rows_sql(text: str) -> str:
    return f"list_transform(split({text}, E'\\n'), lambda x: '<tr><td>' || x || '</td></tr>')"


def pipe_rows(text):
    row = F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("| "), F.replace(x, F.lit("|"), F.lit("/")), F.lit(" | 1 |")))
    return F.array_join(row, "\n")


def html_rows(text):
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<tr><td>"), x, F.lit("</td></tr>"))), "")


def sources_sql(md: str) -> dict[str, str]:
    """Tables, HTML tables and code made of the lines of ``md`` (k, t), ready to be cut."""
    return {
        "pipe": f"SELECT k, {sql_text(PIPE_HEAD)} || array_to_string(rows, E'\\n') AS c, rows, {sql_text(PIPE_HEAD)} AS pre, '' AS suf FROM (SELECT k, {pipe_rows_sql('t')} AS rows FROM {md})",
        "html": f"SELECT k, '{HTML_HEAD}' || array_to_string(rows, '') || '</table>' AS c, rows, '{HTML_HEAD}' AS pre, '</table>' AS suf FROM (SELECT k, {html_rows_sql('t')} AS rows FROM {md})",
        "code": f"SELECT k, E'```text\\n' || t || E'\\n```' AS c, split(t, E'\\n') AS rows, E'```text\\n' AS pre, E'\\n```' AS suf FROM {md}",
    }


LINES_SQL = "lines AS (SELECT doc_id AS k, text AS t FROM documents)"


def rows_oracle(kind: str, sep: str) -> str:
    return f"WITH RECURSIVE {LINES_SQL}, src AS ({sources_sql('lines')[kind]}), {row_cut_sql('cut', 'src', sep)} SELECT k AS doc_id, piece, c AS content FROM cut"


@query("pipe_table_split", "C6", rows_oracle("pipe", "\n"))
def pipe_table_split(spark, sf):
    """A row for each line of a document; the caption and the header come again in every piece."""
    content = F.concat(F.lit(PIPE_HEAD), pipe_rows(F.col("text")))
    return cut_blocks(table(spark, sf, "documents").select("doc_id", content.alias("content")), "table")


@query("html_table_split", "C7", rows_oracle("html", ""))
def html_table_split(spark, sf):
    content = F.concat(F.lit(HTML_HEAD), html_rows(F.col("text")), F.lit("</table>"))
    return cut_blocks(table(spark, sf, "documents").select("doc_id", content.alias("content")), "table")


@query("code_split", "C8", rows_oracle("code", "\n"))
def code_split(spark, sf):
    content = F.concat(F.lit("```text\n"), "text", F.lit("\n```"))
    return cut_blocks(table(spark, sf, "documents").select("doc_id", content.alias("content")), "code")


# The text sections of the Markdown view: k, sec (from 1), c, head, path, title.
SECTIONS_SQL = rf"""{I.MARKDOWN_SQL},
md_line AS (SELECT doc_id, source, lang, unnest(split(md, E'\n')) AS line, unnest(range(len(split(md, E'\n')))) AS n FROM md),
md_sec AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*#{{1,6}}\s+.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM md_line),
sec AS (
  SELECT doc_id AS k, sec::INT AS b, {strip("string_agg(line, E'\\n' ORDER BY n)")} AS c, CASE WHEN sec = 1 THEN '# ' || any_value(source) ELSE '## ' || any_value(lang) || ' ##' END AS head,
    CASE WHEN sec = 1 THEN [any_value(source)] ELSE [any_value(source), any_value(lang)] END AS path, CASE WHEN sec = 1 THEN any_value(source) ELSE any_value(lang) END AS title
  FROM md_sec GROUP BY doc_id, sec)"""


@query(
    "short_block_merge",
    "C9",
    f"""WITH RECURSIVE {SECTIONS_SQL},
    src AS (SELECT k, b - 1 AS i, c, CASE WHEN b % 5 = 4 THEN 'code' ELSE 'text' END AS kind, path, title FROM sec),
    {merge_sql("joined", "src")}
    SELECT k AS doc_id, block AS block_index, c AS content, kind AS context_type, array_to_string(path, '/') AS section_path, title AS section_title FROM joined""",
)
def short_block_merge(spark, sf):
    """Sections before any cut, every fifth of them code, which nothing joins."""
    docs = I.markdown_documents(spark, sf)
    blocks = K.with_paths(K.with_captions(K.segments(F.col("md_content"))), F.col("file_title"))
    typed = F.transform("blocks", lambda b, i: b.withField("context_type", F.when(i % 5 == 3, F.lit("code")).otherwise(b["context_type"])))
    rows = docs.select("doc_id", blocks.alias("blocks")).select("doc_id", K.merged_short(typed, C.CHUNK_MIN, C.CHUNK_MAX_SIZE).alias("blocks"))
    return rows.select("doc_id", F.posexplode_outer("blocks").alias("block_index", "b")).select(
        "doc_id", "block_index", F.col("b.content").alias("content"), F.col("b.context_type").alias("context_type"),
        A.join(F.col("b.path"), "/").alias("section_path"), F.col("b.title").alias("section_title"),
    )


_MADE = sources_sql("md_text")
MARKDOWN_CHUNKS_SQL = rf"""WITH RECURSIVE {SECTIONS_SQL}, {V.DOC_META_SQL},
{text_cut_sql("text_cut", "sec")},
md_text AS (SELECT doc_id AS k, md AS t FROM md),
pipe_src AS ({_MADE["pipe"]}), {row_cut_sql("pipe_cut", "pipe_src", chr(10))},
html_src AS ({_MADE["html"]}), {row_cut_sql("html_cut", "html_src", "")},
code_src AS ({_MADE["code"]}), {row_cut_sql("code_cut", "code_src", chr(10))},
last_sec AS (SELECT k, arg_max(path, b) AS path, arg_max(title, b) AS title FROM sec GROUP BY k),
block AS (
  SELECT k, 0 AS part, b, piece, t.c, 'text' AS kind, path, title FROM text_cut t JOIN sec USING (k, b)
  UNION ALL SELECT k, 1, 0, piece, c, 'table', path, 'Table 1 lines' FROM pipe_cut JOIN last_sec USING (k)
  UNION ALL SELECT k, 2, 0, piece, c, 'table', path, title FROM html_cut JOIN last_sec USING (k)
  UNION ALL SELECT k, 3, 0, piece, c, 'code', path, title FROM code_cut JOIN last_sec USING (k)),
src AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, b, piece) - 1 AS i FROM block),
{merge_sql("joined", "src")},
kept AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY block) - 1 AS n, {strip("c")} AS c, kind, title FROM joined WHERE {strip("c")} <> '')
SELECT k AS doc_id, sha256(document_id || '|' || n) AS chunk_id, n::INT AS chunk_index, kind AS context_type, title AS section_title, c AS content,
  len(regexp_extract_all(c, '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+|[^{SPACE}]'))::INT AS token_count
FROM kept JOIN doc_meta ON doc_id = k"""


@query("markdown_chunks", "C2,C3,C4,C5,C6,C7,C8,C9,C10,C11,U8", MARKDOWN_CHUNKS_SQL)
def markdown_chunks(spark, sf):
    """Documents with headings, a pipe table, an HTML table and a code fence, chunked in full."""
    text = F.col("md_content")
    mixed = F.concat(
        text, F.lit("\n\nTable 1 lines\n\n| line | n |\n|---|---|\n"), pipe_rows(text), F.lit("\n\n" + HTML_HEAD), html_rows(text),
        F.lit("</table>\n\n```text\n"), text, F.lit("\n```\n"),
    )
    docs = I.markdown_documents(spark, sf).withColumn("md_content", mixed)
    return K.chunk_documents(docs).select(
        "doc_id", "chunk_id", "chunk_index", "context_type", "section_title", "content", "token_count"
    )


IMPORT_RECORDS_SQL = rf"""WITH RECURSIVE {SECTIONS_SQL}, {V.DOC_META_SQL},
{text_cut_sql("text_cut", "sec")},
src AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY b, piece) - 1 AS i, t.c, 'text' AS kind, path, title FROM text_cut t JOIN sec USING (k, b)),
{merge_sql("joined", "src")},
kept AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY block) - 1 AS n, {strip("c")} AS c, kind, title FROM joined WHERE {strip("c")} <> ''),
word AS (
  SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY min(i)) AS r
  FROM (SELECT k, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT doc_id AS k, regexp_extract_all(lower(left(md, 10000)), '[\p{{L}}\p{{N}}]+') AS t FROM md))
  WHERE len(w) >= 5 GROUP BY k, w),
topic AS (
  SELECT k, string_agg(w, '、' ORDER BY r) FILTER (WHERE r <= 5) AS topics, string_agg(w, '、' ORDER BY r) FILTER (WHERE r BETWEEN 6 AND 15) AS keywords
  FROM word WHERE r <= 15 AND len(w) <= 128 GROUP BY k),
full_text AS (
  SELECT k, n, c, kind, document_id, concat_ws(E'\n', file_title, nullif(title, file_title), '其他', '不限', topics, keywords, c) AS e
  FROM kept JOIN doc_meta ON doc_id = k LEFT JOIN topic USING (k)),
slots AS (SELECT k, n, count(DISTINCT substr(sha256(t), 1, 7)) AS slots FROM (SELECT k, n, unnest(regexp_extract_all(lower(e), '[\p{{L}}\p{{N}}]+')) AS t FROM full_text) GROUP BY k, n)
SELECT sha256(document_id || '|' || n) AS chunk_id, document_id, n::INT AS chunk_index, kind AS context_type,
  len(regexp_extract_all(c, '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+|[^{SPACE}]'))::INT AS token_count, slots::INT AS n_sparse
FROM full_text JOIN slots USING (k, n)"""


@query("import_records", "C11,V1,U3,P12,P13", IMPORT_RECORDS_SQL)
def import_records(spark, sf):
    """The whole import: described, chunked, embedded and validated documents."""
    from evispark.plans.ingest import chunk_records

    docs = I.markdown_documents(spark, sf).select(
        F.concat(F.lit("/in/"), "file_title", F.lit(".md")).alias("path"), "file_title", "md_content"
    )
    records, _ = chunk_records(docs)
    return records.select("chunk_id", "document_id", "chunk_index", "context_type", "token_count", F.size("sparse_vector").alias("n_sparse"))


STORED_SQL = ", ".join(
    [
        IMPORT_RECORDS_SQL.split(",\nslots AS")[0] + ",\nchunks AS (SELECT sha256(document_id || '|' || n) AS chunk_id, e AS content FROM full_text)",
        Q.POSTINGS_SQL, Q.FORMS_SQL, Q.QTOKS_SQL, Q.SLOTS_SQL, Q.DENSE_SQL, Q.HYBRID_SQL, Q.RRF_SQL,
    ]
)


@query("stored_table_retrieval", "V5,V6,V7,V8,F1,S4", STORED_SQL + " SELECT query_id, chunk_id, rank, score, sources FROM rrf")
def stored_table_retrieval(spark, sf):
    """Search over imported records: their stored vectors, made from title, section, metadata and content, not from content alone."""
    from evispark.plans.hybrid import hybrid_retrieval, stored_chunks
    from evispark.plans.ingest import chunk_records

    docs = I.markdown_documents(spark, sf).select(F.concat(F.lit("/in/"), "file_title", F.lit(".md")).alias("path"), "file_title", "md_content")
    records, _ = chunk_records(docs)
    chunks = stored_chunks(records).drop("document_type", "region_names")
    fused = hybrid_retrieval(Q.benchmark_queries(spark, sf), chunks)
    return fused.select("query_id", "chunk_id", "rank", "score", F.array_join("sources", "+").alias("sources"))
