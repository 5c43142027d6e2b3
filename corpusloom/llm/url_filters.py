"""URL filters whose block decisions travel along redirects and canonical links.

Rules name a host and a path prefix. A url is judged by the longest rule that
fits it. Urls that redirect to each other, or name each other as canonical,
are aliases: the components of those edges. One blocked member blocks every member
of its component that has no rule of its own; an explicit allow rule on a url
outranks what its aliases bring. Only DataFrame operations are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.store import materialize

_REL = r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_REFRESH_URL = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'>\s]+)"""


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a url; all empty where it is null or has no ``://``.

    The host is what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; the
    path follows up to ``? #``; the query, with its ``?``, up to ``#``.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)


def url_key(url: Column) -> Column:
    """What makes two urls the same node: host, path (``/`` if empty) and query; null without a host."""
    host, path, query = url_parts(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) urls of canonical links and meta refreshes in ``pages(url, html)``.

    Relative targets are resolved against the page. Pages with a null url or html give none.
    """
    tags = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv")).select(
        F.col("url").alias("src"),
        F.explode(F.expr(r"regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>', 0)")).alias("tag"),
    )
    href = F.concat(*(F.regexp_extract("tag", _HREF, i) for i in (1, 2, 3)))
    target = F.trim(
        F.when(F.col("tag").rlike(r"(?i)^<link") & F.col("tag").rlike(_REL), href).when(
            F.col("tag").rlike(r"(?i)^<meta") & F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _REFRESH_URL, 1)
        )
    )
    src = F.col("src")
    origin = F.regexp_extract(src, r"^[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract(src, r"^[^:]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    full = (
        F.when(F.col("dst").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("dst"))
        .when(F.col("dst").startswith("//"), F.concat(F.regexp_extract(src, r"^[^:]*:", 0), "dst"))
        .when(F.col("dst").startswith("/"), F.concat(origin, "dst"))
        .when(F.col("dst").startswith("?"), F.concat(F.regexp_extract(src, r"^[^?#]*", 0), "dst"))
        .when(F.col("dst").startswith("#"), F.concat(F.regexp_extract(src, r"^[^#]*", 0), "dst"))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), "dst"))
    )
    # explode keeps the optimizer from copying the long expression into each use of dst
    return tags.select("src", F.explode(F.array(target)).alias("dst")).where(F.col("dst") != "").select("src", full.alias("dst"))


def rule_of(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct ``(host, path)``: ``(host, path, rule, decision)``.

    ``rules(rule, rule_host, rule_path, decision)``. A rule fits its host and all
    subdomains where the path starts with its path. Of equally long rules an allow wins, then the
    larger string. Places without a fitting rule are absent. Hosts are matched by an
    equi-join over their suffixes, so the rule list may be large.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = (
        places.select("host", "path").where(F.col("host") != "").distinct()
        .withColumn("rule_host", F.explode(suffix)).join(rules, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
    )
    rank = F.struct(F.length("rule").alias("n"), (F.col("decision") == "allow").alias("allow"), F.col("rule").alias("rule"))
    best = F.max_by(F.struct("rule", "decision"), rank)
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.decision")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` to ``(page_id, host, path, rule, verdict, propagated)``.

    ``rules`` are (decision, ``host/path``) pairs; ``redirects(src, dst)`` adds
    crawled redirects to the edges found in the pages. Every input row gives one row: a null url,
    or one without a host, has empty parts and is allowed; repeated rows are judged alike; other columns
    of ``pages`` are ignored. ``propagated`` tells a verdict that aliases brought.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame(
        [(r, r.partition("/")[0], "/" + r.partition("/")[2], d) for d, r in dict.fromkeys(rules)],
        "rule string, rule_host string, rule_path string, decision string",
    )
    host, path, _ = url_parts(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"), url_key(F.col("url")).alias("node"))
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = materialize(
        edges.select(url_key(F.col("src")).alias("src"), url_key(F.col("dst")).alias("dst"))
        .where(F.col("src") != F.col("dst")).distinct(),
        "aliases",
    )
    members = connected_components(edges)
    place = F.concat(F.lit("x://"), F.col("node"))
    member_host, member_path, _ = url_parts(place)
    members = members.select("node", "component", member_host.alias("host"), member_path.alias("path"))
    blocked = (
        members.join(rule_of(members, table).where(F.col("decision") == "block"), ["host", "path"])
        .select("component").distinct()
    )
    tainted = members.join(blocked, "component").select("node", F.lit(True).alias("tainted"))
    # the key is wrapped so that the aggregated rules are dealt out once more: only then can a join split a
    # place that very many rows have
    place = F.struct("host", "path").alias("place")
    ruled = rule_of(keyed, table).select(place, "rule", "decision")
    judged = (
        keyed.where("host <> ''").select("*", place).join(ruled, "place", "left").join(tainted, "node", "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("decision", F.when(F.col("tainted"), "block"), F.lit("allow")).alias("verdict"),
            (F.col("decision").isNull() & F.col("tainted").isNotNull()).alias("propagated"),
        )
    )
    nowhere = keyed.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("propagated"))
    return judged.unionByName(nowhere)
