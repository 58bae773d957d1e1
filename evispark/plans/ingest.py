"""Documents to the chunk table: metadata, chunks, vectors, validated and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators import chunk_table, ledger, metadata, models, rules
from evispark.operators import chunks as C
from evispark.operators.chunking import chunk_documents
from evispark.operators.embedding import HASH_DIM, with_vectors
from evispark.operators.ledger import if_there, rejects_path  # noqa: F401
from evispark.session import cut_lineage, once
from evispark.sources.documents import load_markdown, route_by_suffix


def described(docs: DataFrame, describe=models.default_metadata) -> DataFrame:
    """Documents with id and metadata. ``docs``: path, file_title, md_content; ``describe`` gives model text."""
    loaded = load_markdown(docs)
    answer = describe(F.col("file_title"), metadata.metadata_context(F.col("md_content")))
    known = once(loaded, "_raw", metadata.parse_model_json(answer))
    return known.withColumn(
        "document_id", C.document_id(F.lit(None).cast("string"), F.col("path"), F.col("file_title"))
    )


def judged_records(docs: DataFrame, describe=models.default_metadata, encode=None, dim: int = HASH_DIM) -> tuple[DataFrame, DataFrame]:
    """(contract rows, outcome) of a batch: a document comes in with all its chunks or not at all.

    outcome: document_id, path, accepted and reasons, one row per document. A document is refused for its metadata, for any
    broken rule of any of its chunks, for repeated chunk ids or ordinals with gaps, for having no text, and where the batch
    holds it twice. Documents and chunks are each worked out once and made durable, so model, chunker and encoder run once.
    """
    named = cut_lineage(rules.check(described(docs, describe), metadata.metadata_rules(F.col("_raw"))))
    twice = named.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id")
    good = named.where(F.size("problems") == 0).join(twice, "document_id", "left_anti")
    good = good.withColumn("_m", metadata.normalise_metadata(F.col("_raw"))).select("document_id", "path", "file_title", "md_content", "_m.*")
    rows = with_vectors(chunk_documents(good), "embedding_text", encode)
    tagged = cut_lineage(rules.check(chunk_table.contract_projection(rows), chunk_table.chunk_rules(dim)))
    batch = chunk_table.batch_problems(tagged)
    reasons = (
        named.select("document_id", F.explode("problems").alias("reason"))
        .unionByName(twice.withColumn("reason", F.lit("document_repeated")))
        .unionByName(tagged.select("document_id", F.explode("problems").alias("reason")))
        .unionByName(batch.where("repeated_ids > 0").select("document_id", F.lit("chunk_id_repeated").alias("reason")))
        .unionByName(batch.where("shared_ids > 0").select(F.col("document_id"), F.lit("chunk_id_shared").alias("reason")))
        .unionByName(batch.where("index_gap").select("document_id", F.lit("chunk_index_gap").alias("reason")))
        .unionByName(good.select("document_id").join(tagged, "document_id", "left_anti").withColumn("reason", F.lit("no_chunks")))
    )
    refused = cut_lineage(reasons.groupBy("document_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons")))
    known = named.groupBy("document_id").agg(F.min("path").alias("path"))
    title = docs.where(T.first_text(F.col("md_content")) == "").select(F.lit(None).cast("string").alias("document_id"), "path")
    blank = title.select("document_id", "path", F.lit(False).alias("accepted"), F.array(F.lit("blank_document")).alias("reasons"))
    outcome = known.join(refused, "document_id", "left").select(
        "document_id", "path", F.col("reasons").isNull().alias("accepted"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons")
    )
    return tagged.join(refused, "document_id", "left_anti").drop("problems"), outcome.unionByName(blank)


def chunk_records(docs: DataFrame, describe=models.default_metadata, encode=None, dim: int = HASH_DIM) -> tuple[DataFrame, DataFrame]:
    """(contract rows of accepted documents, refused documents with their reasons)."""
    records, outcome = judged_records(docs, describe, encode, dim)
    return records, outcome.where("NOT accepted")


def table_for(spark: SparkSession, table_path: str) -> str:
    """The given table, or its next version where the given one does not fit the contract; raises where neither does."""

    def schema_of(path: str):
        found = if_there(lambda: spark.read.parquet(path))
        return None if found is None else found.schema

    return chunk_table.resolve_table(table_path, schema_of)


def batch_digest(docs: DataFrame) -> str:
    """The same for the same documents, in any order."""
    body = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "file_title", "md_content")]
    found = docs.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*body).cast("decimal(38,0)")).alias("h")).first()
    return f"{found.n}-{found.h}"


def import_batch(spark: SparkSession, docs: DataFrame, table_path: str, n_buckets: int = 64) -> DataFrame:
    """Import a batch and return its outcome. Refused documents keep the version that the table holds, and are added with
    their reasons to a table beside it (``rejects_path``).

    The batch is entered in the table's ledger, so that it comes in whole or not at all. The batch imported last, given again
    after a failure or by a stream that repeats it, is only completed: table and rejects then hold it once. A table of
    other columns is left alone and the next version of its name is used; another bucket count stops the import.
    """
    table_path = table_for(spark, table_path)
    chunk_table.check_target(spark, table_path, n_buckets)
    ledger.publish(spark, table_path)
    digest, last = batch_digest(docs), ledger.last_entry(spark, table_path)
    if last and last.batch == digest:
        return cut_lineage(ledger.outcome_of(spark, table_path, last))
    records, outcome = judged_records(docs)
    outcome = cut_lineage(outcome)
    chunk_table.write_replacing(spark, records, table_path, n_buckets, digest, outcome)
    return outcome


def incremental_import(spark: SparkSession, folder: str, table_path: str, checkpoint: str, files_per_batch: int = 10_000) -> None:
    """Import the Markdown files that arrived since the last run, each file once. Files that are refused count as taken;
    the table of rejects names them."""
    from evispark.streaming.jobs import run_available

    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )

    def one(batch: DataFrame, _: int) -> None:
        routed = route_by_suffix(batch).where("route = 'markdown'")
        docs = routed.select("path", "file_title", F.decode("content", "UTF-8").alias("md_content"))
        import_batch(batch.sparkSession, docs, table_path)

    run_available(files, one, checkpoint, mode="append")
