"""Markdown corpora: a directory scan as a Spark data source, and snapshots of revisions."""

from __future__ import annotations

import os
import subprocess
import tarfile
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, content binary, length long, modified_ns long"


def markdown_files(root: str, recursive: bool = True) -> list[str]:
    """Relative paths of ``*.md`` files (in this case), sorted by components.

    Names that start with a dot are left out at every level; linked files are followed, linked folders are not.
    """
    found: list[tuple[str, ...]] = []
    stack: list[tuple[str, ...]] = [()]
    while stack:
        at = stack.pop()
        for entry in os.scandir(os.path.join(root, *at)):
            if entry.name.startswith("."):
                continue
            if entry.is_dir(follow_symlinks=False):
                if recursive:
                    stack.append((*at, entry.name))
            elif entry.name.endswith(".md") and entry.is_file():
                found.append((*at, entry.name))
    return ["/".join(p) for p in sorted(found)]


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class MarkdownReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.per_task = int(options.get("filesPerTask", "500"))

    def partitions(self) -> list[_Files]:
        paths = markdown_files(self.root, self.recursive)
        return [_Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            full = os.path.join(self.root, *path.split("/"))
            try:
                stat = os.stat(full)
                with open(full, "rb") as f:
                    yield path, f.read((1 << 20) + 1), stat.st_size, stat.st_mtime_ns
            except OSError:
                yield path, None, None, None


class MarkdownSource(DataSource):
    """``spark.read.format("markdown_corpus").load(dir)``; options ``recursive`` and ``filesPerTask``.

    Files are read by the executors, at most one byte beyond the cap of a document; what cannot be read has null content.
    The folder must be one that driver and executors share. For object stores use ``read_store``.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MarkdownReader:
        return MarkdownReader(self.options)


def read_corpus(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    spark.dataSource.register(MarkdownSource)
    return spark.read.format("markdown_corpus").option("recursive", str(recursive)).load(root)


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The same rows from any store that Spark reads. Names that start with an underscore are not seen there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    inside = F.element_at(F.split("path", F.lit(f"{root.rstrip('/').split('/')[-1]}/"), 2), -1)
    kept = files.select(inside.alias("path"), "content", F.col("length"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"))
    return kept.where(~F.col("path").rlike(r"(^|/)\."))


def one_document(spark: SparkSession, content: bytes, path: str = "-") -> DataFrame:
    """A corpus of one document that is given, not read."""
    return spark.createDataFrame([(path, bytearray(content), len(content), 0)], SCHEMA)


def read_revision(spark: SparkSession, repository: str, revision: str, subpath: str = "") -> DataFrame:
    """The corpus as of a git revision; a subpath that it does not have is an empty corpus."""
    with tempfile.TemporaryFile() as archive:
        done = subprocess.run(["git", "-C", repository, "archive", "--format=tar", revision, *([subpath] if subpath else [])], stdout=archive, stderr=subprocess.PIPE)
        rows = []
        if done.returncode == 0:
            archive.seek(0)
            with tarfile.open(fileobj=archive) as tar:
                for member in tar:
                    path = member.name.removeprefix(subpath.rstrip("/") + "/" if subpath else "")
                    if member.isfile() and path.endswith(".md") and not any(p.startswith(".") for p in path.split("/")):
                        rows.append((path, bytearray(tar.extractfile(member).read()), member.size, int(member.mtime) * 10**9))
        elif b"did not match" not in done.stderr:
            raise ValueError(done.stderr.decode(errors="replace").strip())
    return spark.createDataFrame(rows, SCHEMA)
