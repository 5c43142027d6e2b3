"""Exports: documents and graph as JSON lines, viewer and portal pages, a bundle of Markdown, agent rules."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import TOKEN, casefold, script_safe
from corpusloom.operators.parse import to_xhtml

BEGIN, END = "<!-- BEGIN decisions -->", "<!-- END decisions -->"


def body_text():
    return F.array_join(F.transform("search_sections", lambda s: F.concat_ws("\n", s["heading"], F.array_join(s["lines"], "\n"))), "\n\n")


def document_rows(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("canonical_id").alias("id"), "type", F.coalesce("status", F.lit("unknown")).alias("status"), "title", body_text().alias("text"), "aliases", "path", "tags")


def graph_rows(documents: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): resolved edges by source, relationship, target."""
    ids = documents.select("path", F.col("canonical_id").alias("id"))
    good = edges.where("resolved_path is not null and issue is null").select("source_path", "relationship", "resolved_path")
    named = good.join(ids.select(F.col("path").alias("source_path"), F.col("id").alias("source")), "source_path").join(
        ids.select(F.col("path").alias("resolved_path"), F.col("id").alias("target")), "resolved_path")
    return documents.select(F.col("canonical_id").alias("id"), "type", "title", "path"), named.select("source", F.col("relationship").alias("type"), "target").distinct().orderBy("source", "type", "target")


def write_documents(documents: DataFrame, path: str) -> None:
    document_rows(documents).write.json(path)


def write_graph(documents: DataFrame, edges: DataFrame, path: str) -> None:
    nodes, links = graph_rows(documents, edges)
    nodes.write.json(f"{path}/nodes")
    links.write.json(f"{path}/edges")


def viewer_rows(documents: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """A row for each document: its export row, its XHTML body and the ids that it relates to. ``texts(path, text)``."""
    render = F.udf(to_xhtml, "string", useArrow=True)
    _, links = graph_rows(documents, edges)
    related = links.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set("target")).alias("relates_to"))
    rows = document_rows(documents).join(texts.select("path", render("text").alias("body_html")), "path", "left")
    return rows.join(related, "id", "left")


def portal_page(viewer: DataFrame, title: str) -> str:
    """One HTML page with the rows as JSON, safe inside a script; for corpora that fit a page."""
    row = F.to_json(F.struct(*viewer.columns))
    items = [r[0] for r in viewer.orderBy("path").select(script_safe(row)).toLocalIterator()]
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><div id="app"></div><script type="application/json" id="data">[{",".join(items)}]</script></body></html>'


def bundle_rows(documents: DataFrame, edges: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """``(path, text)`` of a bundle: one Markdown file for each document, an index, and a log by commit date."""
    _, links = graph_rows(documents, edges)
    cites = links.groupBy(F.col("source").alias("canonical_id")).agg(F.sort_array(F.collect_list(F.concat_ws(": ", "type", "target"))).alias("cites"))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), "canonical_id"), F.concat(F.lit("type: "), "type"), F.lit("---"), F.concat(F.lit("# "), F.coalesce("title", "canonical_id")))
    text = F.concat_ws("\n\n", head, body_text(), F.array_join(F.coalesce("cites", F.array().cast("array<string>")), "\n"))
    files = documents.join(cites, "canonical_id", "left").select("path", text.alias("text"))
    line = F.concat(F.lit("- "), "canonical_id", F.lit(" "), F.coalesce("title", F.lit("")))
    listing = documents.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("canonical_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    out = files.unionByName(listing.select(F.lit("index.md").alias("path"), "text"))
    if times is not None:
        entry = F.struct(F.col("epoch"), F.concat(F.lit("- "), F.substring("stamp", 1, 10), F.lit(" "), "path").alias("line"))
        log = times.agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry), asc=False), lambda x: x["line"]), "\n").alias("text"))
        out = out.unionByName(log.select(F.lit("log.md").alias("path"), "text"))
    return out


def citations(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(path, at, token, target)`` of the identifiers in ``texts(path, text)`` that name one document of ``aliases(key, path)``."""
    known = aliases.groupBy("key").agg(F.min("path").alias("target"), F.count_distinct("path").alias("n")).where("n = 1").drop("n")
    words = texts.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    return words.withColumn("key", casefold(F.col("token"))).join(known, "key").select("path", "at", "token", "target")


def rules_block(documents: DataFrame) -> str:
    """The managed block of live decisions, with a digest of its lines."""
    rows = documents.where("live_decision").orderBy("canonical_id").select("canonical_id", "title").collect()
    lines = [f"- {r.canonical_id}: {r.title or ''}".rstrip() for r in rows]
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return "\n".join([BEGIN, f"<!-- sha256 {digest} -->", *lines, END])


def splice(text: str, block: str) -> str:
    """A file's text with the block in place of the old one, or after the text."""
    if BEGIN in text and END in text:
        head, _, rest = text.partition(BEGIN)
        return head + block + rest.partition(END)[2]
    return (text.rstrip("\n") + "\n\n" if text.strip() else "") + block + "\n"


def has_drifted(text: str, block: str) -> bool:
    return block not in text
