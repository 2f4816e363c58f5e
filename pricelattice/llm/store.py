"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is written: whole texts stand in it, in the JVM and in Python.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where it is unset and the master is this machine a temporary folder is made and set; on a
    cluster that is an error, since no folder of one machine would be shared."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="pricelattice-shared-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def written(df: DataFrame, name: str, rows: int = ROWS) -> DataFrame:
    """df as a Parquet table in the shared folder, read back. Cuts lineage; survives the loss of executors. The folder is named by
    application and may be removed when that has ended. rows: of an Arrow batch at most."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(min(rows, int(before or rows))))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Freed memory goes back to the system: what training took on the driver is not held while later jobs run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
