"""Intermediate tables in the folder that driver and executors share.

Tables written here cut lineage: a lost executor costs a reread, not a
recomputation of everything before. They live as long as the folder does; the
tables of finished iterations are deleted by ``discard``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder in the warehouse where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold fewer rows, unless the session sets a number of its own: rows here are whole texts, of any length."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of what is run inside as soon as it ends: its result is a written table."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread."""
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame from ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
