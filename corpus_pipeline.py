"""The training-data pipeline: documents in, token ids of a clean, deduplicated, mixed corpus out.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, mixing, ngram_join, quality_lm, quality_rules
from corpusloom.llm.queries import trusted
from corpusloom.llm.store import materialize

#: The last stage encodes in Python and other stages judge with models: SQL cannot express them.
ORACLE_SQL = None

#: Columns whose order is that of the mix.
PLACE = ("part", "piece", "row")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language."""
    return quality_lm.keep_documents(docs, trusted(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows that follow the schedule of their sources."""
    return mixing.mixed_documents(docs, files=int(spark.conf.get("spark.sql.shuffle.partitions")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and its place in the mix: ``(doc_id, ids, part, piece, row)``.

    ``docs`` are read from Parquet files. Spark reads these by size, not by name, so a place is that of the
    row in its file: number of the file's partition, of the file among the partition's, and of the row.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    number = lambda p: F.regexp_extract("_metadata.file_name", p, 1)
    placed = docs.select(
        "doc_id", "text", number(r"^part-(\d+)").try_cast("int").alias("part"), number(r"-c(\d+)\.").try_cast("int").alias("piece"), F.col("_metadata.row_index").alias("row")
    )
    return byte_bpe.encode_documents(placed, path, public_tokenizers.PATTERN, keep=PLACE)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("ngram_join", near_duplicates),
    ("mixing", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's output written and reread. Ordered by ``PLACE`` the rows are the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
