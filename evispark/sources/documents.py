"""Document files: scan, routing by type, Markdown loading, diagnostic copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as T
from evispark.operators.metadata import plain_newlines

# Fixed values.
ROUTES = {".md": "markdown", ".pdf": "parse"}
UNTITLED_DOCUMENT = "未命名文档"


def route_by_suffix(paths: DataFrame, path: str = "path") -> DataFrame:
    """Add ``route`` (null when the type is not supported) and the file stem as title."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    route = F.lit(None).cast("string")
    for key, value in ROUTES.items():
        route = F.when(suffix == key, F.lit(value)).otherwise(route)
    return paths.withColumn("route", route).withColumn(
        "file_title", F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    )


def scan_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(supported, rejected) files under a folder; a missing folder is an error of the read itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    routed = route_by_suffix(files)
    rejected = routed.where("route IS NULL").select("path", F.lit("unsupported_type").alias("reason"))
    return routed.where("route IS NOT NULL"), rejected


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files as rows: path, file_title, md_content."""
    supported, _ = scan_files(spark, folder)
    text = supported.where("route = 'markdown'").select("path", "file_title", F.decode("content", "UTF-8").alias("md_content"))
    return load_markdown(text)


def load_markdown(docs: DataFrame) -> DataFrame:
    """Normal line ends, no byte-order mark, blank documents dropped, a title for every document."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"(?<=[^.])\.[^.]+$", "")
    title = T.strip(
        F.coalesce(F.nullif("file_title", F.lit("")), F.nullif(stem, F.lit("")), F.lit(UNTITLED_DOCUMENT))
    )
    return (
        docs.where(T.first_text(F.col("md_content")) != "")
        .withColumn("md_content", plain_newlines(F.col("md_content")))
        .withColumn("file_title", title)
    )


def blank_documents(docs: DataFrame, key: list[str]) -> DataFrame:
    return docs.where(T.first_text(F.col("md_content")) == "").select(*key, F.lit("blank_document").alias("reason"))


def write_chunk_copies(chunks: DataFrame, folder: str) -> None:
    """Chunk list as JSON lines: a side output for diagnosis."""
    chunks.write.mode("overwrite").json(folder)


def write_markdown_copies(docs: DataFrame, folder: str) -> None:
    """Rewritten Markdown under a new name, the original kept: (file_name, md_content) rows."""
    named = docs.select(F.concat("file_title", F.lit("_new.md")).alias("file_name"), "md_content")
    named.write.mode("overwrite").parquet(folder)
