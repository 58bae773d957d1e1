"""Reliable materialisation shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without that setting gets a private one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, *, release: bool = False) -> DataFrame:
    """A reliable checkpoint: worked out once, and it outlives any executor.

    With ``release``, the shuffles that led to it are deleted as soon as it is written, not when the driver collects
    garbage. Nothing reads them again: what follows begins at the checkpoint.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not release:
        return df.checkpoint()
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        return df.select("*").checkpoint()  # a frame keeps the setting it was made under
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Written once to the shared folder, in buckets of ``column``: grouping by it later moves none of these rows."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name, format="parquet")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog only; the files stay
    return found
