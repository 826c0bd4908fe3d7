"""Folders and files that every executor can reach: under spark.checkpoint.dir, through pyarrow's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without one (as in tests) gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """The address of a new folder in the shared one."""
    return f"{shared(spark)}/{what}-{uuid.uuid4().hex}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
SETTINGS = {CLEAN: "true", BATCH: str(4 << 20)}  # long texts come to Python a few at a time


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and any executor can read it again.

    The shuffle files of the write go when it is done; nothing reads them any more. Batches for Python are bounded by bytes.
    """
    spark = df.sparkSession
    at, before = fresh(spark, what), {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).parquet(at)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(at)
    out.folder = at
    return out


def aliased(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but `own` under names that meet none of an operator's, and the names to give back at the end."""
    names = {f"_c{i}": c for i, c in enumerate(docs.columns) if c not in own}
    return docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") if c not in own else c for i, c in enumerate(docs.columns))), names


def discard(table: DataFrame) -> None:
    """Deletes the files of a table from written() that nothing will read again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; a bare path is local."""
    return fs.FileSystem.from_uri(address if ":" in address.split("/")[0] else f"file://{address}")
