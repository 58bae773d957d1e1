"""Rules on incoming requests and stage inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators.queries import ORIGINAL_MAX_CHARS

# Fixed values.
REGION_SCOPES = ("china", "overseas", "global")
TIME_SCOPES = ("recent_years", "unlimited")
OUTLINE_ACTIONS = ("confirm", "revise")


def query_input_rules(session_id: Column, query: Column) -> list[tuple[str, Column]]:
    text = T.collapse(F.coalesce(query, F.lit("")))
    return [
        ("session_id_empty", T.first_text(session_id) == ""),
        ("query_empty", text == ""),
        ("query_too_long", F.length(text) > ORIGINAL_MAX_CHARS),
    ]


def _length_rule(name: str, c: Column, low: int, high: int) -> tuple[str, Column]:
    return (f"{name}_length", ~F.coalesce(F.length(c).between(low, high), F.lit(False)))


def project_rules(r) -> list[tuple[str, Column]]:
    """``r`` maps field names to columns."""
    years_bad = (r("time_scope") == "recent_years") & r("years").isNull()
    return [
        _length_rule("topic", r("topic"), 2, 200),
        _length_rule("research_goal", r("research_goal"), 2, 500),
        _length_rule("target_audience", r("target_audience"), 2, 100),
        ("region_scope_unknown", ~F.coalesce(r("region_scope").isin(*REGION_SCOPES), F.lit(False))),
        ("time_scope_unknown", ~F.coalesce(r("time_scope").isin(*TIME_SCOPES), F.lit(False))),
        ("years_missing", F.coalesce(years_bad, F.lit(False))),
        ("years_range", F.coalesce(~r("years").between(1, 20), F.lit(False))),
    ]


def outline_update_rules(action: Column, instruction: Column) -> list[tuple[str, Column]]:
    given = F.coalesce(F.length(instruction), F.lit(0)) > 0
    return [
        ("action_unknown", ~F.coalesce(action.isin(*OUTLINE_ACTIONS), F.lit(False))),
        ("instruction_missing", (action == "revise") & ~given),
        ("instruction_length", given & ~F.length(instruction).between(2, 1000)),
    ]


def embeddable_rules() -> list[tuple[str, Column]]:
    """Input of the embedding stage."""
    text = T.first_text(F.col("embedding_text"), F.col("content"))
    return [("no_text_to_embed", text == "")]


def answerable_rules() -> list[tuple[str, Column]]:
    """Input of rerank and answer stages."""
    return [
        ("question_empty", T.first_text(F.col("rewritten_query"), F.col("original_query")) == ""),
        ("candidates_missing", F.col("candidates").isNull()),
    ]


def filled_description(description: Column, question: Column, title: Column) -> Column:
    """The node's description, else its question, else its title."""
    kept = F.when(T.first_text(description) != "", description)
    return F.coalesce(kept, T.blank_to_null(F.coalesce(F.nullif(question, F.lit("")), title)))
