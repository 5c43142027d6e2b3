"""Tables that cut lineage, in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; the warehouse is used where no checkpoint folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return root.rstrip("/")


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """``df`` written as Parquet in ``shared_root`` and reread."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt to all cores if its files give fewer tasks than there are cores: a small file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def preceding(df: DataFrame, name: str, weight: str | Column, order: list, within: str | None = None) -> DataFrame:
    """Adds the sum of ``weight`` over all rows before a row in ``order`` (of the same ``within``, a column of few values).

    Rows are dealt to ranges, summed up in each, and the sums of the ranges before are added, so that no task
    sees all rows. The driver gets one row for each range and value of ``within``.
    """
    keys = ["_range", *([within] if within else [])]
    held = staged(df.withColumn("_weight", weight if isinstance(weight, Column) else F.col(weight)).repartitionByRange(*keys[1:], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    total, offsets = {}, []
    for r in sorted(held.groupBy(*keys).agg(F.sum("_weight").alias("s")).collect(), key=lambda r: r["_range"]):
        kind = r[within] if within else None
        offsets.append((r["_range"], *([kind] if within else []), total.get(kind, 0)))
        total[kind] = total.get(kind, 0) + r["s"]
    fields = ", ".join(f"`{k}` {held.schema[k].dataType.simpleString()}" for k in keys)
    earlier = df.sparkSession.createDataFrame(offsets, f"{fields}, _earlier long")
    here = F.sum("_weight").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return held.join(F.broadcast(earlier), keys).withColumn(name, F.coalesce(here, F.lit(0)) + F.col("_earlier")).drop("_range", "_weight", "_earlier")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Adds the number of each row in ``order``, from 1."""
    return preceding(df, name, F.lit(1), list(order)).withColumn(name, F.col(name) + 1)
