"""Keyed stores: messages, report versions, sections and sources, projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators.ranking import first_per_key


def save_messages(history: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert new messages, overwrite those whose id exists."""
    return history.join(changes.select("message_id"), "message_id", "left_anti").unionByName(changes)


def clear_sessions(history: DataFrame, sessions: DataFrame) -> DataFrame:
    return history.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def with_versions(reports: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """Number new reports on top of the highest stored version of their project."""
    highest = existing.groupBy("project_id").agg(F.max("version").alias("_top"))
    step = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    return reports.join(highest, "project_id", "left").withColumn(
        "version", (F.coalesce("_top", F.lit(0)) + step).cast("int")
    ).drop("_top")


def latest_versions(reports: DataFrame) -> DataFrame:
    return reports.groupBy("project_id").agg(
        F.max_by(F.struct(*[c for c in reports.columns if c != "project_id"]), "version").alias("r")
    ).select("project_id", "r.*")


def most_recent(reports: DataFrame, *ties: Column) -> DataFrame:
    return reports.orderBy(F.desc("created_at"), *ties).limit(1)


def last_write_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    return first_per_key(rows, key, [F.desc(seq)])


def upsert_sections(writes: DataFrame) -> DataFrame:
    """Last write per project and section."""
    return last_write_wins(writes, ["project_id", "section_id"], "seq")


def upsert_sources(writes: DataFrame) -> DataFrame:
    """Last write per project and source identity; sources without identity go."""
    keyed = writes.withColumn("source_key", T.source_key(F.col("url"), F.col("source_type"), F.col("title")))
    return last_write_wins(keyed.where(F.col("source_key").isNotNull()), ["project_id", "source_key"], "seq")


def confirmed_outline(confirmed: Column, outline: Column) -> Column:
    """The confirmed outline, else the draft, else an empty one."""
    return F.coalesce(F.when(F.size(confirmed) > 0, confirmed), F.when(F.size(outline) > 0, outline), F.slice(outline, 1, 0))


def keyed_read(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the asked keys; a missing key gives a row with ``found`` false."""
    return keys.join(table.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def gate(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests that may not run and why.

    ``requests``: request_id, project_id, action. ``projects``: project_id, status, has_outline, has_sections.
    """
    joined = requests.join(projects, "project_id", "left")
    reason = (
        F.when(F.col("status").isNull(), F.lit("unknown_project"))
        .when((F.col("action") == "confirm") & ~F.col("has_outline"), F.lit("no_outline"))
        .when((F.col("action") == "report") & (F.col("status") != "outline_confirmed"), F.lit("outline_not_confirmed"))
        .when((F.col("action") == "render") & ~F.col("has_sections"), F.lit("no_sections"))
    )
    return joined.select("request_id", "project_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def public_history(messages: DataFrame, metadata_schema: str) -> DataFrame:
    """Messages with defaults for missing fields; unreadable summaries become null."""
    summary = F.from_json("retrieval_metadata", metadata_schema)
    usable = F.when(summary["mode"].isin("balanced", "precision", "recall", "custom"), summary)
    text = lambda c: F.coalesce(c, F.lit(""))
    empty = F.array().cast("array<string>")
    return messages.select(
        text("message_id").alias("message_id"),
        text("session_id").alias("session_id"),
        text("role").alias("role"),
        text("text").alias("text"),
        text("rewritten_query").alias("rewritten_query"),
        F.coalesce("item_names", empty).alias("item_names"),
        F.coalesce("image_urls", empty).alias("image_urls"),
        usable.alias("retrieval_metadata"),
        "ts",
    )
