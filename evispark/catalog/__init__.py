"""All registered queries."""

from evispark.catalog import answering, chunking, evaluation, events, ingest, research, retrieval, sources, text_functions  # noqa: F401
from evispark.catalog.registry import ORACLES, QUERIES, SURVEY_IDS

__all__ = ["ORACLES", "QUERIES", "SURVEY_IDS"]
