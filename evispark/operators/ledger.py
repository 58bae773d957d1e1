"""A ledger beside a chunk table: a batch comes in whole and once, whatever dies on the way.

A batch is staged first, its buckets and the outcome of its documents together; a single small file of the ledger then commits
it. Only afterwards are the buckets swapped into the table and the refused documents into theirs. Both steps overwrite what
they wrote before, so whoever comes next repeats them. Readers that go through the ledger see the table before a batch or
after it; folders that begin with an underscore are invisible to plain ones.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ENTRY = "entry long, batch string, buckets array<int>"
STATES = ("staged", "published")


def if_there(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def entries(spark: SparkSession, path: str, state: str) -> DataFrame:
    """The ledger's rows of one state; a row whose write broke off is not there."""
    found = if_there(lambda: spark.read.schema(ENTRY).json(f"{path}/_ledger/{state}/*"))
    return spark.createDataFrame([], ENTRY) if found is None else found


def last_entry(spark: SparkSession, path: str) -> Row | None:
    return entries(spark, path, "staged").orderBy(F.desc("entry")).limit(1).first()


def pending(spark: SparkSession, path: str) -> list[Row]:
    """Committed batches that the table does not show yet: one at most, as each import publishes before it commits."""
    done = entries(spark, path, "published").select("entry")
    return entries(spark, path, "staged").join(done, "entry", "left_anti").orderBy("entry").collect()


def _note(spark: SparkSession, path: str, state: str, entry: int, batch: str, buckets: list[int]) -> None:
    row = spark.range(1).select(F.lit(entry).cast("long").alias("entry"), F.lit(batch).alias("batch"), F.lit(buckets).cast("array<int>").alias("buckets"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/_ledger/{state}/{entry}")


def slot(path: str, entry: int) -> str:
    """Where a batch is staged. Two slots take turns, so the batch before stays readable while one is staged."""
    return f"{path}/_staged/{entry % 2}"


def rejects_path(path: str) -> str:
    return f"{path.rstrip('/')}_rejects"


def in_bucket_order(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "document_id", "chunk_index")


def commit(spark: SparkSession, path: str, batch: str, rows: DataFrame, buckets: list[int], outcome: DataFrame) -> None:
    """Stage the new content of ``buckets`` and the outcome of the batch's documents, enter the batch, and publish it."""
    before = last_entry(spark, path)
    entry = before.entry + 1 if before else 0
    in_bucket_order(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{slot(path, entry)}/table")
    outcome.write.mode("overwrite").parquet(f"{slot(path, entry)}/outcome")
    _note(spark, path, "staged", entry, batch, buckets)
    publish(spark, path)


def publish(spark: SparkSession, path: str) -> None:
    """Bring the table and the rejects to what the ledger says. Safe to repeat at any time."""
    for row in pending(spark, path):
        publish_rejects(spark, path, row)
        publish_buckets(spark, path, row)
        _note(spark, path, "published", row.entry, row.batch, row.buckets)


def publish_rejects(spark: SparkSession, path: str, row: Row) -> None:
    refused = spark.read.parquet(f"{slot(path, row.entry)}/outcome").where("NOT accepted")
    named = refused.select("document_id", "path", "reasons", F.current_timestamp().alias("refused_at"))
    named.write.mode("overwrite").parquet(f"{rejects_path(path)}/entry={row.entry}")


def publish_buckets(spark: SparkSession, path: str, row: Row) -> None:
    """Dynamic partition overwrite replaces exactly the buckets that the batch holds. No bucket becomes empty: the documents of
    a batch stay in theirs."""
    if row.buckets:
        staged = in_bucket_order(spark.read.parquet(f"{slot(path, row.entry)}/table"))
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of the last committed batch, also between its commit and its publishing. None if there is none."""
    table = if_there(lambda: spark.read.parquet(path))
    for row in pending(spark, path):
        if row.buckets:
            staged = spark.read.parquet(f"{slot(path, row.entry)}/table")
            table = staged if table is None else table.where(~F.col("bucket").isin(row.buckets)).unionByName(staged)
    return table


def outcome_of(spark: SparkSession, path: str, row: Row) -> DataFrame:
    return spark.read.parquet(f"{slot(path, row.entry)}/outcome")
