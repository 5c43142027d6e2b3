"""The index as versioned Parquet tables: a version is written whole, then a pointer names it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def publish(root: str, tables: dict[str, DataFrame], fingerprint: str = "") -> str:
    """Write all tables of a new version, then append the pointer row that makes it the current one."""
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    row = (version, FORMAT, fingerprint, sorted(tables))
    pointer = spark.createDataFrame([row], "version string, format int, fingerprint string, tables array<string>").withColumn("at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def current(spark: SparkSession, root: str, fingerprint: str = "") -> dict[str, DataFrame] | None:
    """The tables of the current version; None if there is none, or it has another format or fingerprint."""
    try:
        pointers = spark.read.parquet(f"{root}/pointer")
    except Exception as e:  # noqa: BLE001 (the store decides what a missing path raises)
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    last = pointers.orderBy(F.desc("at"), "version").first()
    if last is None or last.format != FORMAT or last.fingerprint != fingerprint:
        return None
    return {t: spark.read.parquet(f"{root}/versions/{last.version}/{t}") for t in last.tables}


def files_hash(spark: SparkSession, paths: list[str]) -> str:
    """One hash over the names, lengths and times of change of all files under ``paths``."""
    import hashlib

    conf, seen = spark._jsc.hadoopConfiguration(), []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(conf).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()


def corpus_hash(manifest: DataFrame) -> str:
    """One hash over the paths and content hashes of a corpus, in path order: hashes of ranges of paths, hashed."""
    marked = manifest.select("path", "content_hash", F.conv(F.substring(F.sha2("path", 256), 1, 2), 16, 10).cast("int").alias("part"))
    line = F.concat("path", F.lit("\x00"), "content_hash", F.lit("\x00"))
    parts = marked.groupBy("part").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.split("path", "/"), line.alias("line")))), lambda x: x["line"]), ""), 256).alias("h"))
    rows = parts.orderBy("part").collect()  # 256 rows at most
    import hashlib

    return hashlib.sha256(json.dumps([(r.part, r.h) for r in rows]).encode()).hexdigest()


def reuse(documents: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows found in the cache, documents to compute): by content hash and configuration fingerprint."""
    return documents.join(cache, key), documents.join(cache.select(*key).distinct(), key, "left_anti")
