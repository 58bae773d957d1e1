"""Evidence context, labels, history context and the summary of a retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import config as C
from evispark.operators.ranking import first_per_key, ranked, top_k

# Display texts and limits.
NO_URL = "未提供URL"
UNNAMED_FILE = "未命名文件"
UNNAMED_SOURCE = "未命名来源"
NO_HISTORY = "无历史对话"
NO_EVIDENCE_ANSWER = "未检索到足以回答该问题的参考内容。"
WEB_SOURCE, LOCAL_SOURCE = "网络搜索", "本地知识库"
URL_PART, TYPE_PART, REGION_PART, KIND_PART = "URL：", "文档类型：", "地域：", "内容类型："
LABEL_LINE, TITLE_LINE, SOURCE_LINE, CONTENT_LINE = "来源标识：", "\n标题：", "\n来源：", "\n内容："
HISTORY_MESSAGES = 6
HISTORY_MAX_CHARS = 4000
HISTORY_TEXT_CHARS = 300
LEGACY_LABEL = r"\[来源(\d+)\]"
MARKDOWN_IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"


def source_label(source: Column, file_title: Column, section_title: Column, url: Column) -> Column:
    address = T.strip(F.coalesce(F.nullif(url, F.lit("")), F.lit(NO_URL)))
    file_part = T.strip(F.coalesce(F.nullif(file_title, F.lit("")), F.lit(UNNAMED_FILE)))
    section_part = T.strip(F.coalesce(F.nullif(section_title, F.lit("")), file_part))
    return F.when(source == "web", F.concat(F.lit(f"[{WEB_SOURCE}/"), address, F.lit("]"))).otherwise(
        F.concat(F.lit(f"[{LOCAL_SOURCE}/"), file_part, F.lit("/"), section_part, F.lit("]"))
    )


def evidence_section(d) -> Column:
    """Text of one piece of evidence; ``d`` maps field names to columns."""
    web = d("source") == "web"
    meta = F.when(
        web, F.coalesce(F.concat(F.lit(URL_PART), F.nullif(d("url"), F.lit(""))), F.lit(""))
    ).otherwise(
        F.concat_ws(
            "；",
            F.concat(F.lit(TYPE_PART), F.nullif(d("document_type"), F.lit(""))),
            F.concat(F.lit(REGION_PART), F.nullif(F.array_join(d("region_names"), "、"), F.lit(""))),
            F.concat(F.lit(KIND_PART), F.nullif(d("context_type"), F.lit(""))),
        )
    )
    label = source_label(d("source"), d("file_title"), d("section_title"), d("url"))
    return T.strip(
        F.concat(
            F.lit(LABEL_LINE),
            label,
            F.lit(TITLE_LINE),
            F.coalesce(F.nullif(d("display_title"), F.lit("")), F.lit(UNNAMED_SOURCE)),
            F.lit(SOURCE_LINE),
            F.when(web, F.lit(WEB_SOURCE)).otherwise(F.lit(LOCAL_SOURCE)),
            F.lit("\n"),
            meta,
            F.lit(CONTENT_LINE),
            F.coalesce(d("content"), F.lit("")),
        )
    )


def within_budget(df: DataFrame, budget: Column, group: str = "query_id", text: str = "section") -> DataFrame:
    """Rows in rank order until one would overflow; only an overflowing first row is kept, cut to size."""
    running = F.sum(F.length(text)).over(
        Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    first = F.row_number().over(Window.partitionBy(group).orderBy("rank")) == 1
    marked = df.withColumn("_used", running).withColumn("_first", first).withColumn("_budget", budget)
    return (
        marked.where((F.col("_used") <= F.col("_budget")) | F.col("_first"))
        .withColumn(text, F.when(F.col("_used") > F.col("_budget"), F.left(F.col(text), F.col("_budget"))).otherwise(F.col(text)))
        .drop("_used", "_first", "_budget")
    )


def evidence_context(df: DataFrame, budget: Column, group: str = "query_id") -> DataFrame:
    """One context text per query from its ranked sections."""
    kept = within_budget(df, budget, group)
    return kept.groupBy(group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]), "\n\n"
        ).alias("context"),
        F.count("*").cast("int").alias("n_sections"),
    )


def replace_legacy_labels(answer: Column, labels: Column) -> Column:
    """``[来源N]`` becomes the N-th label; numbers without a label stay as written."""
    pieces = F.split(answer, LEGACY_LABEL, -1)
    marks = F.regexp_extract_all(answer, F.lit(LEGACY_LABEL), F.lit(0))
    numbers = F.transform(marks, lambda m: F.regexp_extract(m, LEGACY_LABEL, 1).try_cast("int"))
    shown = F.transform(
        F.arrays_zip(marks.alias("m"), numbers.alias("n")),
        lambda x: F.when(x["n"].between(1, F.size(labels)), F.try_element_at(labels, x["n"])).otherwise(x["m"]),
    )
    return F.array_join(
        F.transform(
            F.arrays_zip(pieces.alias("p"), shown.alias("s")),
            lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.coalesce(x["s"], F.lit(""))),
        ),
        "",
    )


def image_urls(df: DataFrame, group: str = "query_id") -> DataFrame:
    """Image targets in the content and image page addresses: first occurrence per query, in order."""
    address = T.strip(F.coalesce("url", F.lit("")))
    own = F.when((address != "") & T.is_image_url(address), F.array(address)).otherwise(
        F.array().cast("array<string>")
    )
    found = F.concat(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(MARKDOWN_IMAGE), F.lit(1)), own)
    spots = df.select(group, "rank", F.posexplode_outer(F.transform(found, T.strip)).alias("pos", "image_url"))
    firsts = first_per_key(spots.where("image_url <> ''"), [group, "image_url"], [F.asc("rank"), F.asc("pos")])
    return ranked(firsts, [group], [F.asc("rank"), F.asc("pos")], "image_no").select(group, "image_no", "image_url")


def recent_messages(messages: DataFrame, n: int, session: str = "session_id", order: str = "ts") -> DataFrame:
    """The last ``n`` messages of every session, numbered newest first."""
    return top_k(messages, [session], [F.desc(order)], n, "recency")


def history_context(messages: DataFrame, session: str = "session_id", order: str = "ts") -> DataFrame:
    """Role-prefixed lines of the recent messages that fit the budget, newest first, shown oldest first.

    ``understanding`` breaks at the budget; ``answering`` keeps the last characters of all lines.
    """
    recent = recent_messages(messages, HISTORY_MESSAGES, session, order)
    is_user = F.col("role") == "user"
    role = F.when(is_user, F.lit("用户")).otherwise(F.lit("助手"))
    rewritten = F.coalesce(F.nullif("rewritten_query", F.lit("")), F.col("text"), F.lit(""))
    said = F.coalesce("text", F.lit(""))
    rows = recent.withColumn(
        "line",
        F.concat(role, F.lit("："), T.strip(F.when(is_user, rewritten).otherwise(F.left(said, F.lit(HISTORY_TEXT_CHARS))))),
    ).withColumn(
        "short_line",
        F.concat(role, F.lit("："), F.left(F.when(is_user, rewritten).otherwise(said), F.lit(HISTORY_TEXT_CHARS))),
    )
    used = F.sum(F.length("line")).over(
        Window.partitionBy(session).orderBy("recency").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    packed = rows.withColumn("_used", used).groupBy(session).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("recency"),
                    F.when(F.col("_used") <= HISTORY_MAX_CHARS, F.col("line")).alias("line"),
                    F.col("short_line"),
                )
            ),
            asc=False,
        ).alias("rows")
    )
    shown = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return packed.select(
        session,
        F.coalesce(F.nullif(shown, F.lit("")), F.lit(NO_HISTORY)).alias("understanding"),
        F.right(F.array_join(F.transform("rows", lambda r: r["short_line"]), "\n"), F.lit(HISTORY_MAX_CHARS)).alias(
            "answering"
        ),
    )


def retrieval_summary(counts: DataFrame, settings: Column, mode: Column, statuses: dict[str, Column]) -> DataFrame:
    """Public summary per query from layer counts, settings and the status of each arm."""
    failed = F.array_compact(
        F.array(*[F.when(status == "failed", F.lit(f"{name}_failed")) for name, status in statuses.items()])
    )
    return (
        counts.withColumn("mode_label", C.mode_label(mode))
        .withColumn("search_breadth", C.search_breadth(settings))
        .withColumn(
            "reference_range",
            F.concat(settings["rerank_min_topk"].cast("string"), F.lit("～"), settings["rerank_max_topk"].cast("string")),
        )
        .withColumn("matching_preference", C.matching_label(settings))
        .withColumn("degradations", failed)
    )


def answer_text(clarification: Column, n_documents: Column, generated: Column, labels: Column) -> Column:
    """A prepared clarification wins, no evidence gives the fixed text, else the generated text with its labels."""
    return (
        F.when(T.first_text(clarification) != "", T.first_text(clarification))
        .when(n_documents == 0, F.lit(NO_EVIDENCE_ANSWER))
        .otherwise(replace_legacy_labels(T.strip(generated), labels))
    )
