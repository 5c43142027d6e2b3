"""Grounding: documents that govern a path, and search results with retired ones replaced by their successors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import casefold, excerpt, glob_regex, strip_marker
from corpusloom.operators.parse import section
from corpusloom.operators.search import search


def scope_kind(entry: Column) -> Column:
    """glob, path or component of a scope entry."""
    return F.when(entry.rlike(r"[*?\[]"), "glob").when(entry.contains("/"), "path").otherwise("component")


def scope_entries(documents: DataFrame) -> DataFrame:
    """``(path, id, title, status, ord, entry)`` of the scopes of live decisions."""
    lines = F.filter(F.transform(F.split(F.coalesce(section("applies to"), F.lit("")), "\n"), strip_marker), lambda x: x != "")
    cleaned = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^(?:\./)+", ""), "/+$", ""))
    return documents.where("live_decision").select("path", F.col("canonical_id").alias("id"), "title", "status", F.posexplode(cleaned).alias("ord", "entry"))


def in_scope(entry: Column, path: str, globs: dict[str, str] | None = None) -> Column:
    """Whether a path equals an entry, lies below it, or fits it as a glob. ``globs`` maps entries to patterns."""
    plain = (F.lit(path) == entry) | F.lit(path).startswith(F.concat(entry, F.lit("/")))
    fits = F.lit(False)
    for glob, pattern in (globs or {}).items():
        fits = fits | ((entry == glob) & F.lit(path).rlike(pattern))
    return F.when(scope_kind(entry) == "glob", fits).otherwise(plain)


def scope_join(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, ..., file, entry)``: for each (document, file) the first entry that covers the file.

    Plain entries are equi-joined with the folders of each file. Globs are joined by their literal first folder, those
    without one with every file; their patterns are few and made on the driver.
    """
    parts = F.split("file", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    plain = entries.where(scope_kind(F.col("entry")) != "glob").join(paths.withColumn("entry", F.explode(folders)), "entry")
    found = plain.select(*entries.columns, "file")
    globs = [r.entry for r in entries.where(scope_kind(F.col("entry")) == "glob").select("entry").distinct().collect()]
    if globs:
        table = entries.sparkSession.createDataFrame([(g, glob_regex(g)) for g in globs], "entry string, pattern string")
        head = F.when(F.get(F.split("entry", "/"), F.lit(0)).rlike(r"[*?\[]"), "").otherwise(F.get(F.split("entry", "/"), F.lit(0)))
        keyed = entries.join(table, "entry").withColumn("head", head)
        files = paths.withColumn("head", F.explode(F.array(F.lit(""), F.get(F.split("file", "/"), F.lit(0)))))
        fits = F.regexp_like(F.col("file"), F.col("pattern"))
        found = found.unionByName(keyed.join(files, "head").where(fits).select(*entries.columns, "file"))
    w = Window.partitionBy("path", "file").orderBy("ord")
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def decisions_for(documents: DataFrame, path: str) -> DataFrame:
    """Live decisions whose scope covers a path, with the first entry that does, by folded id and path."""
    one = documents.sparkSession.createDataFrame([(path,)], "file string")
    found = scope_join(scope_entries(documents), one)
    return found.select("id", "title", "status", "path", "entry").orderBy(casefold(F.col("id")), "path")


def ground(
    documents: DataFrame, entries: DataFrame, successors: DataFrame, task: str, scope: str | None = None, top_k: int = 5,
    budget: int = 8000, live_only: bool = True,
) -> DataFrame:
    """``(position, path, id, title, channels, superseded, excerpt)``: what to read for a task.

    Decisions that govern ``scope`` come first, then keyword matches; with ``live_only`` a retired match gives way to its
    ``successors(old, live)``. A document met twice stands at its first place with all its channels.
    """
    spark = documents.sparkSession
    none = F.lit(None).cast("string")
    stated = spark.createDataFrame([], "path string, channel string, stratum int, score double, via string")
    if scope is not None:
        first = decisions_for(documents, scope)
        stated = first.select("path", F.lit("scope").alias("channel"), F.lit(0).alias("stratum"), F.lit(0.0).alias("score"), none.alias("via"))
    matched = search(entries, task).select("path", F.lit("keyword").alias("channel"), F.lit(1).alias("stratum"), (-F.round("fused", 12)).alias("score"), none.alias("via"))
    if live_only:
        retired = documents.where("retired").select("path")
        gone = matched.join(retired, "path", "left_semi")
        heirs = gone.join(successors, gone.path == successors.old).select(
            F.col("live").alias("path"), F.lit("supersedes").alias("channel"), "stratum", "score", F.col("old").alias("via"))
        matched = matched.join(retired, "path", "left_anti").unionByName(heirs)
    rows = stated.unionByName(matched)
    merged = rows.groupBy("path").agg(
        F.min(F.struct("stratum", "score")).alias("at"), F.sort_array(F.collect_set("channel")).alias("channels"),
        F.sort_array(F.collect_set("via")).alias("superseded"),
    )
    top = merged.orderBy("at", "path").limit(max(top_k, 1)).withColumn("position", F.row_number().over(Window.orderBy("at", "path")))
    text = F.array_join(F.transform("sections", lambda s: F.concat(s["name"], F.lit("\n"), s["body"])), "\n\n").alias("content")
    joined = top.join(documents.select("path", F.col("canonical_id").alias("id"), "title", text), "path")
    return joined.select("position", "path", "id", "title", "channels", "superseded", excerpt(F.col("content"), budget, top_k).alias("excerpt"))


def fit(response: dict, budget: int) -> dict:
    """A response of few rows cut to a budget of characters of its JSON: lists from their tail, then texts, marked where cut."""
    size = lambda r: len(json.dumps(r, ensure_ascii=False))
    if size(response) <= budget:
        return response
    out = dict(response, truncated=True)
    for name in ("matches", "incoming", "items"):
        if not isinstance(out.get(name), list):
            continue
        out[name] = list(out[name])
        while out[name] and size(out) > budget:
            last = out[name][-1]
            over = size(out) - budget
            if name == "items" and isinstance(last, dict) and len(last.get("excerpt", "")) > over:
                out[name][-1] = dict(last, excerpt=last["excerpt"][: len(last["excerpt"]) - over])
            else:
                out[name].pop()
    if size(out) > budget and isinstance(out.get("content"), str):
        low, high = 0, len(out["content"])
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if size(out | {"content": out["content"][:middle]}) <= budget else (low, middle - 1)
        out["content"] = out["content"][:low]
    return out


def call_budget(server: int, asked: int | None) -> int:
    """A call may lower the server's budget, not raise it."""
    return server if asked is None else max(0, min(server, asked))


def contains_filter(rows: DataFrame, needle: str, columns: list[str], type: str | None = None, status: str | None = None) -> DataFrame:
    """Rows whose joined columns hold a text in any case, by type and status where given."""
    hay = F.lower(F.concat_ws(" ", *columns))
    found = rows.where(hay.contains(needle.strip().lower()))
    found = found if type is None else found.where(F.col("type") == type)
    return found if status is None else found.where(F.col("status") == status)
