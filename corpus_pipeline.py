"""The corpus pipeline: toxicity, line dedup, n-gram dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm.decontamination import decontaminate
from evispark.llm.durable import durable, shared_folder
from evispark.llm.line_dedup import dedup_lines
from evispark.llm.ngram_join import ngram_jaccard_join
from evispark.llm.packing import pack_documents
from evispark.llm.toxicity import score_documents, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones among all given, does not call toxic.

    Rows that share an id but not the text are judged one by one.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_clean(docs, model)


def keep_clean(docs: DataFrame, model) -> DataFrame:
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text"))
    return score_documents(whole, model, id_col="_row").filter("predicted = 0").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; those of which no word is left go, n_chars counts anew."""
    kept = dedup_lines(docs)
    changed = F.col("n_removed") > 0
    left = kept.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row, the first by (id, MD5 of the text), null ids last; rows without words stay.

    Rows that share an id but not the text are judged one by one. Rows that repeat id and text are told by a 64-bit hash.
    Extra columns may have any names; an empty table gives an empty one.
    """
    body = F.coalesce("text", F.lit(""))
    named = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", body).alias("name"), "doc_id", F.col("text"))
    found = ngram_jaccard_join(named.select("name", "text"), id_col="name").filter("n_shingles > 0")
    groups = durable(found.groupBy("name").agg(F.min("component_id").alias("group"), F.count("*").alias("many")))
    names = named.select("name", "doc_id", F.md5(F.encode(body, "utf-8")).alias("digest")).join(groups, "name")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "name")
    first = names.groupBy("group").agg(F.min(order)["name"].alias("name")).select("name", F.lit(True).alias("stays"))
    marks = durable(groups.join(first, "name", "left").filter("stays IS NULL OR many > 1").select("name", "stays"))
    left = named.join(marks.select("name"), "name", "left_anti").select("row.*")
    repeated = marks.filter("stays").select("name")
    if repeated.isEmpty():
        return left
    return left.union(named.join(repeated, "name", "left_semi").dropDuplicates(["name"]).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; null and empty texts hold none, repeated rows fare alike.

    Extra columns may have any names; an empty table gives an empty one.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins and texts, as ``pack_documents`` defines them.

    A null or empty text is one piece of no words without a bin; repeated rows are packed one by one; extra columns are
    not looked at; an empty table gives an empty one.
    """
    return pack_documents(docs, texts=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Training and packing are not expressible in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
