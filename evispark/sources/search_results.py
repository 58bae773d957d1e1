"""Search and tool responses, given as JSON text, to evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators.ranking import first_per_key, ranked

# Fixed values.
UNTITLED_RESULT = "网络搜索结果"
STATUSES = ("ok", "empty", "needs_clarification")
PAGES = "struct<pages:array<struct<title:string,url:string,snippet:string,content:string>>>"
CHUNK = "struct<chunk_id:string,document_id:string,document_name:string,section_title:string,content:string,score:string>"
RESPONSE = f"struct<status:string,request_id:string,clarification_question:string,chunks:array<{CHUNK}>>"
NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def web_candidates(responses: DataFrame, limit: int, response: str = "response", key: str = "query_id") -> DataFrame:
    """Pages of each response in order: titled or with text, first per address, ``limit`` per query."""
    pages = F.from_json(response, PAGES)["pages"]
    rows = (
        responses.select(key, F.posexplode_outer(pages).alias("pos", "p"))
        .where("p IS NOT NULL")
        .select(
            key,
            "pos",
            T.first_text(F.col("p.title")).alias("title"),
            T.strip(F.coalesce(F.nullif("p.snippet", F.lit("")), F.col("p.content"), F.lit(""))).alias("content"),
            T.without_fragment(F.col("p.url")).alias("url"),
        )
        .where("title <> '' OR content <> ''")
        .withColumn("_key", F.coalesce(F.nullif("url", F.lit("")), F.concat_ws("\n", "title", "content")))
    )
    first = first_per_key(rows, [key, "_key"], [F.asc("pos")])
    return (
        ranked(first, [key], [F.asc("pos")])
        .where(F.col("rank") <= limit)
        .select(
            key,
            "rank",
            F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED_RESULT)).alias("display_title"),
            "content",
            "url",
            F.lit("web").alias("source"),
            F.lit(0.0).alias("score"),
        )
    )


def _number(raw: Column) -> Column:
    """A JSON number; texts, booleans and non-finite values give null."""
    return F.when(F.rlike(F.trim(raw), F.lit(NUMBER)), F.trim(raw).try_cast("double"))


def knowledge_chunks(responses: DataFrame, response: str = "response", key: str = "request_no") -> DataFrame:
    """Valid chunks of ``ok`` responses. Scores must be JSON numbers, so quoted ones are told apart first."""
    quoted = F.regexp_replace(F.col(response), r'("score"\s*:\s*)"([^"]*)"', '$1"text:$2"')
    rows = responses.select(key, F.from_json(quoted, RESPONSE).alias("r")).where("r.status = 'ok'")
    items = rows.select(key, F.posexplode("r.chunks").alias("pos", "c"))
    fields = {f: T.first_text(F.col(f"c.{f}")) for f in ("chunk_id", "document_id", "document_name", "content")}
    shaped = items.select(
        key,
        "pos",
        *[c.alias(f) for f, c in fields.items()],
        T.blank_to_null(F.col("c.section_title")).alias("section_title"),
        _number(F.col("c.score")).alias("score"),
    )
    present = F.lit(True)
    for f in fields:
        present = present & (F.col(f) != "")
    return shaped.where(present & F.col("score").isNotNull() & (F.abs("score") < float("inf")))


def response_status(responses: DataFrame, response: str = "response", key: str = "request_no") -> DataFrame:
    """Final status per response: ``ok`` without a valid chunk is ``empty``; an unknown status is an error."""
    parsed = responses.select(key, F.from_json(response, RESPONSE).alias("r"))
    n = knowledge_chunks(responses, response, key).groupBy(key).agg(F.count("*").alias("n_chunks"))
    status = F.col("r.status")
    final = (
        F.when(F.coalesce(~status.isin(*STATUSES), F.lit(True)), F.lit("error"))
        .when((status == "ok") & (F.col("n_chunks") == 0), F.lit("empty"))
        .otherwise(status)
    )
    return (
        parsed.join(n, key, "left")
        .withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
        .select(
            key,
            final.alias("status"),
            "n_chunks",
            F.when(final == "needs_clarification", T.blank_to_null(F.col("r.clarification_question"))).alias(
                "clarification_question"
            ),
        )
    )


def normalised_evidence(rows: DataFrame, aliases: dict[str, list[str]], key: list[str]) -> DataFrame:
    """Other result shapes to the same columns: the first filled alias of each field counts."""
    present = set(rows.columns)
    out = []
    for field, names in aliases.items():
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in present]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(field))
    return rows.select(*key, *out)
