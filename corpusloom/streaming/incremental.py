"""Freshness over a corpus that changes: manifests, deltas on an immutable base, compaction, and streams.

A base table never changes; a delta holds upserts and tombstones; what is current is the base without
tombstones and replaced rows, and the upserts. The base is rewritten when the delta has grown to a share of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPACT_ROWS, COMPACT_SHARE = 10_000, 100


def manifest_of(corpus: DataFrame) -> DataFrame:
    """``(path, content_hash, length, modified_ns)`` of ``corpus(path, content, length, modified_ns)``; unreadable files hash to ''."""
    return corpus.select("path", F.coalesce(F.sha2("content", 256), F.lit("")).alias("content_hash"), "length", "modified_ns")


def manifest_diff(previous: DataFrame, now: DataFrame, verify: bool = False) -> DataFrame:
    """``(path, change)``: added, modified, removed. Equal size and time count as unchanged unless ``verify`` compares hashes."""
    a = previous.select("path", *(F.col(c).alias(f"a_{c}") for c in ("content_hash", "length", "modified_ns")))
    same_stat = (F.col("a_length") == F.col("length")) & (F.col("a_modified_ns") == F.col("modified_ns"))
    same = F.col("a_content_hash") == F.col("content_hash")
    same = same if verify else same_stat | same
    change = F.when(F.col("a_length").isNull(), "added").when(F.col("length").isNull(), "removed").when(~same, "modified")
    return a.join(now, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def overlay(base: DataFrame, upserts: DataFrame, tombstones: DataFrame, key: str = "path") -> DataFrame:
    """The current rows."""
    gone = upserts.select(key).unionByName(tombstones.select(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(upserts)


def merge_delta(upserts: DataFrame, tombstones: DataFrame, more: DataFrame, gone: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """A delta after another change: later upserts replace earlier, and lift tombstones."""
    kept = upserts.join(more.select(key).unionByName(gone.select(key)).distinct(), key, "left_anti").unionByName(more)
    dead = tombstones.unionByName(gone).distinct().join(more.select(key), key, "left_anti")
    return kept, dead


def needs_compaction(base_rows: int, delta_rows: int) -> bool:
    return delta_rows >= max(COMPACT_ROWS, base_rows // COMPACT_SHARE)


def compact(root: str, base: DataFrame, upserts: DataFrame, tombstones: DataFrame, fingerprint: str = "") -> str | None:
    """Publish a new base and an empty delta if the delta has grown enough; the new version's name, or None."""
    delta = upserts.count() + tombstones.count()
    if not needs_compaction(base.count(), delta):
        return None
    from corpusloom.sources.index import publish

    return publish(root, {"base": overlay(base, upserts, tombstones), "upserts": upserts.limit(0), "tombstones": tombstones.limit(0)}, fingerprint)


def affected_sources(references: DataFrame, changed_keys: DataFrame) -> DataFrame:
    """``(source_path)`` of documents that mention an alias which changed: only these are resolved again. Both have ``key``."""
    return references.join(changed_keys.select("key").distinct(), "key", "left_semi").select("source_path").distinct()


def refresh_edges(edges: DataFrame, references: DataFrame, aliases: DataFrame, sources: DataFrame, resolve: Callable) -> DataFrame:
    """Edges with those of ``sources`` resolved anew against ``aliases``."""
    kept = edges.join(sources, "source_path", "left_anti")
    return kept.unionByName(resolve(references.join(sources, "source_path", "left_semi"), aliases).select(*edges.columns))


def length_sums(tokens: DataFrame, fields: list[str]) -> DataFrame:
    """``(n, s_<field>)``: what search statistics need; sums of a base and of a delta add up."""
    return tokens.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.size(f)), F.lit(0)).alias(f"s_{f}") for f in fields))


def stream_summary(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Calls by tool and tumbling window of a stream of ``events(ts timestamp, tool, outcome)``, with a watermark."""
    timed = events.withWatermark("ts", late).groupBy(F.window("ts", every), "tool")
    return timed.agg(F.count("*").alias("calls"), F.count_if(F.col("outcome").isin("error", "exception")).alias("errors")).select(
        F.col("window.start").alias("start"), "tool", "calls", "errors")


def follow(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch of changed documents to ``apply(batch, id)``; batches repeat after a failure, so it must be idempotent."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
