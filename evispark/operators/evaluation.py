"""Retrieval quality against gold data, per layer and summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.session import cut_lineage

# Fixed values.
LAYERS = ("embedding", "hyde", "rrf", "rerank")
ID_METRICS = ("id_precision", "id_recall", "must_hit_rate")
JUDGE_SCORES = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")
MULTI_DOCUMENT_NOTE = "多文档题"
RESULT_COLUMNS = (
    "run_id",
    "case_id",
    "response",
    "retrieved_contexts_json",
    "layer_results_json",
    "faithfulness",
    "answer_relevancy",
    "context_precision",
    "context_recall",
    "answer_correctness",
    "id_metrics_json",
    "final_context_count",
    "latency_ms",
    "error_message",
    "config_snapshot_json",
)


def ordered_ids(candidates: DataFrame) -> DataFrame:
    """Distinct non-blank ids per case and layer with the rank of their first appearance."""
    return (
        candidates.withColumn("chunk_id", T.first_text(F.col("chunk_id")))
        .where("chunk_id <> ''")
        .groupBy("case_id", "layer", "chunk_id")
        .agg(F.min("rank").alias("rank"))
    )


def missing_ids(candidates: DataFrame) -> DataFrame:
    """Rows that must carry a chunk id but do not; web rows may go without."""
    blank = T.first_text(F.col("chunk_id")) == ""
    return candidates.where(blank & (F.coalesce("source", F.lit("")) != "web")).select("case_id", "layer", "rank")


def layer_metrics(
    cases: DataFrame, gold: DataFrame, must: DataFrame, candidates: DataFrame, layers: tuple[str, ...] = LAYERS
) -> DataFrame:
    """Precision, recall and must-hit rate per case and layer.

    ``cases``: case_id, answerable. ``gold`` and ``must``: case_id, chunk_id. ``candidates``: case_id,
    layer, rank, chunk_id. Without gold, or for an unanswerable case, all three are null; with nothing
    retrieved precision is null and recall 0.
    """
    marks = (
        gold.select("case_id", "chunk_id", F.lit(1).alias("g"), F.lit(0).alias("m"))
        .unionByName(must.select("case_id", "chunk_id", F.lit(0).alias("g"), F.lit(1).alias("m")))
        .groupBy("case_id", "chunk_id")
        .agg(F.max("g").alias("g"), F.max("m").alias("m"))
    )
    sizes = marks.groupBy("case_id").agg(F.sum("g").alias("gold_count"), F.sum("m").alias("must_hit_count"))
    hits = (
        ordered_ids(candidates)
        .join(marks, ["case_id", "chunk_id"], "left")
        .groupBy("case_id", "layer")
        .agg(
            F.count("*").alias("retrieved_count"),
            F.count_if(F.col("g") == 1).alias("hit_count"),
            F.count_if(F.col("m") == 1).alias("must_hits"),
        )
    )
    frame = cases.select(
        "case_id", "answerable", F.explode(F.array(*[F.lit(x) for x in layers])).alias("layer")
    ).join(sizes, "case_id", "left")
    joined = frame.join(hits, ["case_id", "layer"], "left").na.fill(
        0, ["gold_count", "must_hit_count", "retrieved_count", "hit_count", "must_hits"]
    )
    applies = F.col("answerable") & (F.col("gold_count") > 0)
    return joined.select(
        "case_id",
        "layer",
        "retrieved_count",
        "gold_count",
        "must_hit_count",
        "hit_count",
        F.when(applies & (F.col("retrieved_count") > 0), F.col("hit_count") / F.col("retrieved_count")).alias("id_precision"),
        F.when(applies, F.col("hit_count") / F.col("gold_count")).alias("id_recall"),
        F.when(applies & (F.col("must_hit_count") > 0), F.col("must_hits") / F.col("must_hit_count")).alias("must_hit_rate"),
    )


# The order statistics of a summary.
PERCENTILES = {"median": 0.5, "p10": 0.1}


def counted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, _v and _n: the distinct values of each group, null among them, and how often they occur."""
    return df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))


def exact_percentiles(counted: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """keys and a column for each of ``points``, interpolated between the two ranks around it; nulls do not count.

    ``counted`` is what ``counted_values`` gives. Ranges of (keys, value) are numbered apart and then placed by the sums of
    the ranges before them, so no task holds a group.
    """
    known = counted.where("_v IS NOT NULL")
    placed = cut_lineage(
        known.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v").withColumn("_range", F.spark_partition_id())
    )
    sums = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_in"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_range", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"), F.sum("_in").over(group).alias("_all"))
    within = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = placed.withColumn("_upto", F.sum("_n").over(within)).join(starts, [*keys, "_range"])
    last, first = F.col("_before") + F.col("_upto") - 1, F.col("_before") + F.col("_upto") - F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("_v")))

    columns = []
    for name, p in points.items():
        place = (F.col("_all") - 1) * p
        columns += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    found = ranks.groupBy(*keys).agg(*columns)
    mixed = [(F.col(f"_lo_{n}") * (1 - F.col(f"_part_{n}")) + F.col(f"_hi_{n}") * F.col(f"_part_{n}")).alias(n) for n in points]
    return found.select(*keys, *mixed)


def statistics(df: DataFrame, keys: list[str], value: str = "value", digits: int = 9) -> DataFrame:
    """Count, mean, median and interpolated tenth percentile of the non-null values of each group.

    The rows are worked out once and counted by value; everything else follows from the counts.
    """
    counted = cut_lineage(counted_values(df, keys, value))
    valid = F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0))
    mean = F.sum(F.col("_v") * F.col("_n")) / valid
    plain = counted.groupBy(*keys).agg(valid.alias("valid_count"), F.round(F.when(valid > 0, mean), digits).alias("mean"))
    order = exact_percentiles(counted, keys, PERCENTILES)
    return plain.join(order, keys, "left").select(*keys, "valid_count", "mean", *(F.round(n, digits).alias(n) for n in PERCENTILES))


def long_metrics(df: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """One row per metric."""
    return df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def summary_groups(split: Column, answerable: Column, notes: Column) -> Column:
    """Names of all groups a result row counts towards."""
    return F.array_compact(
        F.array(
            F.lit("overall"),
            F.when(split.isin("dev", "test"), F.concat(F.lit("split:"), split)),
            F.concat(F.lit("answerable:"), answerable.cast("string")),
            F.when(notes == MULTI_DOCUMENT_NOTE, F.lit("multi_document")),
        )
    )


def grouped_summary(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """Statistics of every metric per layer for each group that has rows.

    ``metrics``: case_id, layer, metric, value. ``cases``: case_id, split, answerable, notes.
    """
    groups = cases.select(
        "case_id", F.explode(summary_groups(F.col("split"), F.col("answerable"), F.col("notes"))).alias("summary_group")
    )
    return statistics(metrics.join(groups, "case_id"), ["summary_group", "layer", "metric"])


def run_counts(results: DataFrame) -> DataFrame:
    """Rows by error type; an empty message means success, a missing type is ``unknown``."""
    failed = F.coalesce("error_message", F.lit("")) != ""
    kind = F.when(~failed, F.lit("success")).otherwise(F.coalesce(F.nullif("error_type", F.lit("")), F.lit("unknown")))
    return results.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def abstained(response: Column) -> Column:
    text = T.strip(response)
    return (text != "") & T.contains_any(text, T.REFUSAL_SIGNALS)


def abstention_accuracy(results: DataFrame) -> DataFrame:
    """Share of correct refusals over all unanswerable rows; a missing flag counts as wrong."""
    rows = results.where(~F.col("answerable"))
    right = F.coalesce("abstention_correct", F.lit(False)).cast("double")
    return rows.agg(F.count("*").alias("valid_count"), F.round(F.avg(right), 9).alias("value"))


def traces(cases: DataFrame, candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per case: ordered contexts, ordered ids per layer, and what is wrong with it.

    ``cases``: case_id, response. ``contexts``: case_id, rank, content.
    """
    by_layer = (
        ordered_ids(candidates)
        .groupBy("case_id", "layer")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("r"))
        .groupBy("case_id")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("layer", F.transform("r", lambda x: x["chunk_id"]).alias("ids")))
            ).alias("layer_ids")
        )
    )
    texts = contexts.groupBy("case_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", T.first_text(F.col("content")).alias("content")))),
            lambda x: x["content"],
        ).alias("retrieved_contexts"),
        F.count_if(T.first_text(F.col("content")) == "").alias("_blank"),
    )
    flawed = missing_ids(candidates).groupBy("case_id").agg(F.count("*").alias("_no_id"))
    joined = cases.join(by_layer, "case_id", "left").join(texts, "case_id", "left").join(flawed, "case_id", "left")
    error = (
        F.when(T.first_text(F.col("response")) == "", F.lit("missing_answer"))
        .when(F.coalesce("_blank", F.lit(0)) > 0, F.lit("missing_content"))
        .when(F.coalesce("_no_id", F.lit(0)) > 0, F.lit("missing_chunk_id"))
        .otherwise(F.lit(""))
    )
    return joined.withColumn("error_message", error).withColumn(
        "final_context_count", F.coalesce(F.size("retrieved_contexts"), F.lit(0))
    ).drop("_blank", "_no_id")


def select_cases(cases: DataFrame, split: str = "dev", review_statuses: tuple[str, ...] = ("draft", "reviewed"), limit: int | None = None) -> DataFrame:
    """Cases of a split with an accepted review status, in file order; ``limit`` is the user's first-N option."""
    known = ("draft", "reviewed", "rejected")
    if split not in ("dev", "test", "all"):
        raise ValueError("split must be dev, test or all")
    statuses = known if "all" in review_statuses else tuple(review_statuses)
    unknown = set(statuses) - set(known)
    if unknown:
        raise ValueError(f"unknown review status: {sorted(unknown)}")
    rows = cases.where(F.col("review_status").isin(*statuses))
    if split != "all":
        rows = rows.where(F.col("split") == split)
    return rows if limit is None else rows.orderBy("row_number").limit(limit)
