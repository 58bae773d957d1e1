"""Places where a model plugs in, each with a deterministic stand-in that needs none.

A plug-in is a function of columns. ``text_model`` turns a batch function into one; the batch function
is built once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions import text as T

JUDGE_SCHEMA = (
    "faithfulness double, answer_relevancy double, context_precision double, context_recall double, "
    "answer_correctness double, errors array<string>"
)


def text_model(load: Callable[[], Callable[[list[str]], list[str]]], attempts: int = 1):
    """A text-to-text model as a column function; a batch that keeps failing gives nulls, not a dead job."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            result: list[str | None] = [None] * len(prompts)
            for _ in range(attempts):
                try:
                    result = list(model(prompts.tolist()))
                    break
                except Exception:  # the caller sees a null and may fall back
                    continue
            if len(result) != len(prompts):
                raise ValueError("model returned another number of texts than prompts")
            yield pd.Series(result, dtype="object")

    # Marked so that no filter above it is pushed down with a second run of the model.
    return run.asNondeterministic()


def retried(answer: Column, is_good: Callable[[Column], Column], again: Column) -> Column:
    """The answer, or a second one where the first does not pass."""
    return F.when(is_good(answer), answer).otherwise(again)


def default_metadata(file_title: Column, context: Column) -> Column:
    """Metadata as a model would give it: most frequent long words, no region, type from the title."""
    words = F.array_distinct(F.filter(T.words(context), lambda w: F.length(w) >= 5))
    kind = F.lit("其他")
    for name in ("政策", "标准", "规划", "技术文件"):
        kind = F.when(F.contains(file_title, F.lit(name)), F.lit(name)).otherwise(kind)
    return F.to_json(
        F.struct(
            kind.alias("document_type"),
            F.array(F.lit("不限")).alias("region_names"),
            F.filter(F.slice(words, 1, 5), lambda w: F.length(w) <= 128).alias("topics"),
            F.filter(F.slice(words, 6, 10), lambda w: F.length(w) <= 128).alias("keywords"),
        )
    )


def judge(load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]):
    """Five scores per answer; ``load`` builds a function of a frame with user_input, response, reference,
    contexts. A metric that fails is null and its message is listed."""

    @F.pandas_udf(JUDGE_SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load()
        for user_input, response, reference, contexts in batches:
            frame = pd.DataFrame(
                {"user_input": user_input, "response": response, "reference": reference, "contexts": contexts}
            )
            yield model(frame)

    return run.asNondeterministic()


def captions(images, load: Callable[[], Callable[[list[bytes], list[str], list[str]], list[str]]]):
    """Captions for image rows (image_name, content, before, after) from a vision model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            said = model(frame["content"].tolist(), frame["before"].tolist(), frame["after"].tolist())
            yield pd.DataFrame({"image_name": frame["image_name"], "summary": said})

    return images.select("image_name", "content", "before", "after").mapInPandas(run, "image_name string, summary string")
