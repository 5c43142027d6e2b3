"""Commit times of files from git."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, seq long, sha string, author string, stamp string"


class _Whole(InputPartition):
    pass


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Whole(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        command = ["git", "-C", self.root, "log", "--relative", "--name-only", "-z", "--format=%x01%H%x02%an%x02%cI", "--", "."]
        run = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        seq, head, held = 0, None, b""
        while block := run.stdout.read(1 << 16):
            *fields, held = (held + block).split(b"\0")
            for f in fields:
                for part in f.split(b"\n"):
                    text = part.decode("utf-8", "replace")
                    if "\x01" in text:
                        head, seq = text.rpartition("\x01")[2].split("\x02"), seq + 1
                    elif text and head:
                        yield text, seq, head[0], head[1], head[2]
        run.wait()


class HistorySource(DataSource):
    """``spark.read.format("git_history").load(dir)``: a row for each (commit, file), newest commit first (``seq`` 1)."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


def read_history(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(HistorySource)
    return spark.read.format("git_history").load(root)


def commit_times(history: DataFrame) -> DataFrame:
    """``(path, stamp, epoch, author, first_stamp, first_author)``: each file's newest and first commit; stamps keep their offset."""
    times = history.groupBy("path").agg(
        F.min_by("stamp", "seq").alias("stamp"), F.min_by("author", "seq").alias("author"),
        F.max_by("stamp", "seq").alias("first_stamp"), F.max_by("author", "seq").alias("first_author"))
    return times.withColumn("epoch", F.unix_timestamp(F.to_timestamp("stamp")))


def with_recency(matches: DataFrame, times: DataFrame) -> DataFrame:
    """Search results with the last commit of their files, joined after ranking."""
    return matches.join(times.select("path", "stamp", "epoch"), "path", "left")
