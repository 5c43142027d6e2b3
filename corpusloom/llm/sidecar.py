"""Facts about the rows of a scan, in files beside it, so that whole texts need not be shuffled to meet them.

A scan of files gives its rows in the same partitions and the same order each time. What a first scan sends out
of partition ``part`` may be counted, joined and answered elsewhere; the answers lie in the folder ``part=<n>`` of a
Parquet table in the shared folder, and partition n of a second scan reads them there. Row ``at`` is the
at-th row of its partition. Readers compare ids or counts and raise where the two scans differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import materialize, new_path, tidy

_SCANS = {"Project", "Filter", "Relation", "SubqueryAlias"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that executors share, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def repeatable(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it is a scan of files, with no more than filters and expressions; else a copy in the shared folder."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.match(r"[\s:+\-!]*([A-Za-z]*)", line)[1] for line in plan.splitlines()}
    return df if nodes - {""} <= _SCANS and " parquet" in plan else materialize(df, name)


PART = "__part"


def scanned(docs: DataFrame, *columns) -> DataFrame:
    """Those columns of ``docs``, after the number of the scan's partition, which a task of a union doesn't have as its own."""
    return docs.select(F.spark_partition_id().alias(PART), *columns)


def partition_of(batches: Iterator[pa.RecordBatch]) -> tuple[int, Iterator[pa.RecordBatch]]:
    """(part, batches) of ``scanned`` rows; part is -1 if there are none."""
    first = next(batches, None)
    return (-1, iter(())) if first is None else (first.column(0)[0].as_py(), chain([first], batches))


def numbered(docs: DataFrame, column: str) -> DataFrame:
    """``(part, at, column)`` of every row."""
    kind = docs.schema[column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(at, at + len(batch))), batch.column(1)], ["part", "at", column])
            at += len(batch)

    return scanned(docs, column).mapInArrow(run, f"part int, at long, `{column}` {kind}")


def keep(facts: DataFrame, *order: str) -> str:
    """Write ``facts(part, ...)`` for the partitions they belong to, each in this order; the table's path."""
    path = new_path(facts.sparkSession, "facts")
    with tidy(facts.sparkSession):
        facts.repartition("part").sortWithinPartitions("part", *order).write.partitionBy("part").parquet(path)
    return path


def facts_of(path: str, part: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The facts of one partition, in order."""
    fs, root = filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    for info in sorted(found, key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=4096, columns=columns)


def marks_of(path: str, part: int, columns: list[str]) -> pa.Table | None:
    """All facts of one partition at once, for those with a small row for a document; None without any."""
    found = list(facts_of(path, part, columns))
    return pa.Table.from_batches(found) if found else None


class Marks:
    """The marked rows of one partition: ``mark`` and ``doc_id`` by ``at``."""

    def __init__(self, path: str | None, part: int):
        table = path and marks_of(path, part, ["at", "doc_id", "mark"])
        self.at = table["at"].to_numpy() if table else np.zeros(0, np.int64)
        self.mark = table["mark"].to_numpy() if table else np.zeros(0, np.int64)
        self.ids = table["doc_id"].combine_chunks() if table else pa.array([], pa.int64())

    def of(self, doc_id: pa.Array, first: int) -> np.ndarray:
        """Marks (0: none) of the rows from ``first`` on, whose ids must be those that were marked."""
        a, b = np.searchsorted(self.at, [first, first + len(doc_id)])
        out = np.zeros(len(doc_id), np.int64)
        where = self.at[a:b] - first
        out[where] = self.mark[a:b]
        here, then = doc_id.take(pa.array(where)).to_pylist(), self.ids[a:b].to_pylist()
        if here != then:
            raise RuntimeError(f"the rows of this partition differ between two scans, from row {first} on: {then[:5]}, now {here[:5]}")
        return out
