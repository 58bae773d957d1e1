"""Gold questions from CSV, and evaluation results back to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from evispark import schemas
from evispark.functions import text as T
from evispark.operators import rules
from evispark.operators.evaluation import RESULT_COLUMNS, select_cases

# Fixed values.
SPLITS = ("dev", "test")
REVIEW_STATUSES = ("draft", "reviewed", "rejected")
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


class GoldFileError(ValueError):
    """The file breaks the contract."""


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All rows as text; rows with too many or too few values carry their text in ``malformed``."""
    header = spark.read.options(**CSV_OPTIONS).csv(path).columns
    if tuple(header) != schemas.GOLD_COLUMNS:
        raise GoldFileError(f"header must be {schemas.GOLD_COLUMNS}, found {tuple(header)}")
    fields = [t.StructField(c, t.StringType()) for c in (*schemas.GOLD_COLUMNS, "malformed")]
    reader = spark.read.options(**CSV_OPTIONS, columnNameOfCorruptRecord="malformed", enforceSchema="true")
    rows = reader.schema(t.StructType(fields)).csv(path)
    # One multi-line file is one split, so the running id follows the file; the header is row 1.
    return rows.withColumn("row_number", F.monotonically_increasing_id() + 2)


def parsed(rows: DataFrame) -> DataFrame:
    contexts = F.from_json("gold_contexts_json", t.ArrayType(schemas.GOLD_CONTEXT))
    keys = F.from_json("gold_contexts_json", "array<map<string,string>>")
    must = F.from_json("must_hit_chunk_ids_json", schemas.STRINGS)
    return rows.withColumns(
        {
            "contexts": contexts,
            "context_keys": keys,
            "must_ids": F.array_distinct(F.transform(must, lambda x: T.first_text(x))),
            "gold_ids": F.array_distinct(F.transform(contexts, lambda c: T.first_text(c["chunk_id"]))),
            "is_answerable": F.lower(T.first_text(F.col("answerable"))) == "true",
        }
    )


def gold_rules() -> list[tuple[str, Column]]:
    """Rules on parsed rows, each by itself."""
    text = lambda c: T.first_text(F.col(c))
    names = F.array(*[F.lit(f.name) for f in schemas.GOLD_CONTEXT.fields])
    is_list = lambda c: F.coalesce(F.startswith(text(c), F.lit("[")) & F.endswith(text(c), F.lit("]")), F.lit(False))
    contexts, must, gold = F.col("contexts"), F.col("must_ids"), F.col("gold_ids")
    exact = F.forall(
        F.col("context_keys"), lambda m: (F.size(F.array_except(F.map_keys(m), names)) == 0) & (F.size(m) == 4)
    )
    blank = F.exists(
        contexts, lambda c: F.array_contains(F.array(*[T.first_text(c[f.name]) for f in schemas.GOLD_CONTEXT.fields]), "")
    )
    answerable, reference = F.col("is_answerable"), text("reference")
    return [
        ("malformed_row", F.col("malformed").isNotNull()),
        ("case_id_empty", text("case_id") == ""),
        ("user_input_empty", text("user_input") == ""),
        ("answerable_value", ~F.lower(text("answerable")).isin("true", "false")),
        ("split_value", ~text("split").isin(*SPLITS)),
        ("review_status_value", ~text("review_status").isin(*REVIEW_STATUSES)),
        ("gold_contexts_json", contexts.isNull() | ~is_list("gold_contexts_json")),
        ("gold_context_fields", contexts.isNotNull() & F.coalesce(~exact, F.lit(True))),
        ("gold_context_blank", F.coalesce(blank, F.lit(False))),
        ("must_hit_json", must.isNull() | ~is_list("must_hit_chunk_ids_json")),
        ("must_hit_blank", F.coalesce(F.array_contains(must, ""), F.lit(False))),
        ("must_hit_not_gold", F.coalesce(F.size(F.array_except(must, gold)) > 0, F.lit(False))),
        ("answerable_without_evidence", answerable & ((reference == "") | (F.coalesce(F.size(contexts), F.lit(0)) <= 0))),
        (
            "unanswerable_with_evidence",
            ~answerable & ((F.coalesce(F.size(contexts), F.lit(0)) > 0) | (F.coalesce(F.size(must), F.lit(0)) > 0)),
        ),
        ("unanswerable_without_reference", ~answerable & (reference == "")),
    ]


def checked(rows: DataFrame) -> DataFrame:
    """The parsed rows with their problems."""
    # Judged before the join with the repeated ids, so that a reader of the problems alone sorts no texts there.
    judged = rules.check(parsed(rows).withColumn("_key", T.first_text(F.col("case_id"))), gold_rules())
    repeated = judged.groupBy("_key").agg(F.count("*").alias("_times")).where("_times > 1")
    named = judged.join(repeated, "_key", "left").drop("_key")
    again = F.when(F.col("_times").isNull(), F.col("problems")).otherwise(F.array_append("problems", F.lit("case_id_repeated")))
    return named.withColumn("problems", again).withColumn("_times", F.coalesce("_times", F.lit(1)))


def load_gold_cases(
    spark: SparkSession, path: str, split: str = "dev", review_statuses: tuple[str, ...] = ("draft", "reviewed")
) -> DataFrame:
    """Cases of a split. The whole file is checked first; any problem, or an empty choice, is an error."""
    rows = checked(read_raw(spark, path))
    bad = rows.where(F.size("problems") > 0).select("row_number", "case_id", "problems").orderBy("row_number").take(1)
    if bad:
        raise GoldFileError(f"row={bad[0].row_number}, case_id={bad[0].case_id}: {', '.join(bad[0].problems)}")
    cases = rows.select(
        T.first_text(F.col("case_id")).alias("case_id"),
        T.first_text(F.col("user_input")).alias("user_input"),
        T.first_text(F.col("reference")).alias("reference"),
        "contexts",
        "gold_ids",
        "must_ids",
        F.col("is_answerable").alias("answerable"),
        T.first_text(F.col("split")).alias("split"),
        T.first_text(F.col("review_status")).alias("review_status"),
        T.first_text(F.col("notes")).alias("notes"),
        "row_number",
    )
    chosen = select_cases(cases, split, review_statuses)
    if chosen.isEmpty():
        raise GoldFileError(f"no case left for split={split}, review_statuses={sorted(review_statuses)}")
    return chosen


def write_results(results: DataFrame, path: str) -> None:
    """The 15 result columns as CSV; Spark's commit makes the folder appear whole or not at all."""
    missing = [c for c in RESULT_COLUMNS if c not in results.columns]
    rows = results.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else results
    shaped = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RESULT_COLUMNS])
    shaped.write.mode("overwrite").options(header="true", quote='"', escape='"', lineSep="\n").csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
