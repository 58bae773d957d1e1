"""Headline queries, timed once each; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from evispark.session import build_session

# One of each kind: search, evaluation, chunking, import, fusion, selection, rollups.
HEADLINE = (
    "hybrid_retrieval",
    "sparse_retrieval",
    "dense_retrieval",
    "retrieval_evaluation",
    "evaluation_summary",
    "markdown_chunks",
    "heading_sections",
    "import_records",
    "fixed_window_chunks",
    "chunk_table_replacement",
    "rank_fusion",
    "candidate_merge",
    "dynamic_top_k",
    "evidence_context",
    "history_context",
    "metadata_normalisation",
    "section_rejects",
    "section_synthesis",
    "outline_flatten",
    "source_store",
    "page_text",
    "image_rewrite",
    "task_progress",
    "step_durations",
    "sliding_request_count",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    from evispark.catalog import QUERIES

    seconds: dict[str, float] = {}
    QUERIES["token_estimate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
