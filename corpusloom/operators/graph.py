"""The relationship graph: resolution of references, findings, degrees, neighbourhoods, cycles, coverage.

``references`` are rows (source_path, type, relationship, rel_ord, ref_ord, target); a reference line that repeats is an
edge each time. Documents of unknown type keep their aliases but have no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.registry import EDGES, NAMES
from corpusloom.functions.text import TOKEN, casefold
from corpusloom.sources.staging import staged

EXTERNAL = [e.section for e in EDGES if e.external]
FINDING = ["source", "code", "severity", "path", "line", "message", "relationship", "target", "identifier", "paths"]


def alias_table(documents: DataFrame) -> DataFrame:
    """``(key, alias, path)``: every alias of every document by its folded form."""
    return documents.select("path", F.explode("aliases").alias("alias")).withColumn("key", casefold(F.col("alias")))


def resolve_references(references: DataFrame, aliases: DataFrame, fold=casefold) -> DataFrame:
    """References with ``resolved_path`` and ``issue``: target-not-found, target-ambiguous, self-reference or null.

    ``aliases(key, path)`` are aggregated to one row for each key before the join, so no reference is multiplied
    however many documents share an alias. External relationships are not resolved.
    """
    keys = aliases.select("key", "path").distinct().groupBy("key").agg(F.count("*").alias("hits"), F.min("path").alias("only"))
    joined = references.withColumn("key", fold(F.col("target"))).join(keys, "key", "left")
    external = F.col("relationship").isin(*EXTERNAL)
    hits = F.coalesce("hits", F.lit(0))
    issue = (
        F.when(external, F.lit(None)).when(hits == 0, "target-not-found").when(hits > 1, "target-ambiguous")
        .when(F.col("only") == F.col("source_path"), "self-reference")
    )
    return joined.withColumn("issue", issue).withColumn("resolved_path", F.when(~external & (hits == 1), F.col("only"))).drop("key", "hits", "only")


def resolve_point(aliases: DataFrame, wanted: str) -> tuple[str, list[str]]:
    """('resolved' | 'not-found' | 'duplicate', sorted paths) of one identifier."""
    paths = [r.path for r in aliases.where(F.col("key") == wanted.strip().casefold()).select("path").distinct().orderBy("path").collect()]
    return ("not-found", "resolved", "duplicate")[min(len(paths), 2)], paths


def inbound_counts(edges: DataFrame) -> DataFrame:
    """``(resolved_path, n)``: resolved edges from other documents."""
    return edges.where("resolved_path is not null and issue is null").groupBy("resolved_path").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, threshold: int = 20) -> DataFrame:
    """``(path, inbound, outbound, degree, hub)`` of documents with resolved edges; a hub has more than ``threshold``."""
    good = edges.where("resolved_path is not null and issue is null")
    ends = good.select(F.col("resolved_path").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        good.select(F.col("source_path").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    total = ends.groupBy("path").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    return total.withColumn("degree", F.col("inbound") + F.col("outbound")).withColumn("hub", F.col("degree") > threshold)


def orphans(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Known documents that no resolved edge points to."""
    return documents.where(F.col("type").isin(*NAMES)).join(inbound_counts(edges).withColumnRenamed("resolved_path", "path"), "path", "left_anti")


def relationship_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship").agg(F.count("*").alias("n"))


def duplicate_identifiers(documents: DataFrame) -> DataFrame:
    """``(key, identifier, paths)`` of canonical ids that several documents have, the id as at the smallest path."""
    keyed = documents.select("path", "canonical_id", casefold(F.col("canonical_id")).alias("key"))
    groups = keyed.groupBy("key").agg(F.min_by("canonical_id", F.split("path", "/")).alias("identifier"), F.sort_array(F.collect_set("path")).alias("paths"))
    return groups.where(F.size("paths") > 1)


def finding(source: str, code: str, severity: str, /, **columns: Column) -> list[Column]:
    """The columns of a finding row; what is not given is null."""
    kinds = {"line": "long", "paths": "array<string>"}
    fixed = {"source": F.lit(source), "code": F.lit(code), "severity": F.lit(severity)}
    return [(fixed | columns).get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FINDING]


def cycles(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """``(member, component)``: nodes of strongly connected components with two nodes or more, named by their smallest.

    ``pairs(src, dst)``. Nodes without an edge in or out are trimmed first; then reachability is doubled until
    it stops growing. Self references are left out.
    """
    edges = staged(pairs.select("src", "dst").where("src <> dst").distinct())
    for _ in range(rounds):
        before = edges.count()
        edges = staged(
            edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            .join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        )
        if edges.count() == before:
            break
    reach = edges
    for _ in range(rounds):
        before = reach.count()
        step = reach.alias("a").join(reach.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        reach = staged(reach.unionByName(step).distinct())
        if reach.count() == before:
            break
    mutual = reach.where("src <> dst").alias("a").join(reach.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")))
    return mutual.groupBy(F.col("a.src").alias("member")).agg(F.min("a.dst").alias("least")).select(
        "member", F.least("member", "least").alias("component"))


def successors(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """``(old, live)``: the live documents that replace each retired one, found through retired ones between.

    ``pairs(newer, older)`` are resolved supersedes edges, ``live(path)`` the documents in force. A walk
    stops at a live document; nodes met before are not walked again, so cycles end. Walks are as long as their chains.
    """
    edges = pairs.select("newer", "older").distinct()
    ends = live.select(F.col("path").alias("at"))
    seen = staged(edges.select(F.col("older").alias("old"), F.col("newer").alias("at")).distinct())
    frontier = seen.join(ends, "at", "left_anti")
    while True:
        step = frontier.join(edges.withColumnRenamed("older", "at"), "at").select("old", F.col("newer").alias("at")).distinct()
        step = staged(step.join(seen, ["old", "at"], "left_anti"))
        if step.isEmpty():
            break
        seen = staged(seen.unionByName(step))
        frontier = step.join(ends, "at", "left_anti")
    return seen.join(ends, "at", "left_semi").select("old", F.col("at").alias("live"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(path, other, relationship, direction)``: resolved edges both ways."""
    good = edges.where("resolved_path is not null and issue is null")
    return good.select(F.col("source_path").alias("path"), F.col("resolved_path").alias("other"), "relationship", F.lit("out").alias("direction")).unionByName(
        good.select(F.col("resolved_path").alias("path"), F.col("source_path").alias("other"), "relationship", F.lit("in").alias("direction")))


def neighbourhood(links: DataFrame, start: DataFrame, depth: int = 2, frontier_cap: int | None = 1000, work_cap: int | None = 10_000) -> DataFrame:
    """``(path, hops)`` within ``depth`` undirected steps (5 at most) of ``start(path)``, itself at 0.

    ``links(path, other)``. A step's new nodes are cut to the first ``frontier_cap`` by path and all nodes to
    ``work_cap``; None lifts a cap. ``truncated`` tells whether a cap was met.
    """
    seen = start.select("path", F.lit(0).alias("hops")).distinct()
    frontier, truncated, total = seen.select("path"), False, 0
    for hop in range(1, min(depth, 5) + 1):
        step = frontier.join(links, "path").select(F.col("other").alias("path")).distinct().join(seen, "path", "left_anti")
        room = min(x for x in (frontier_cap, None if work_cap is None else work_cap - total, 1 << 62) if x is not None)
        if room < 1 << 62:
            step = staged(step.orderBy("path").limit(max(room, 0) + 1))
            n = step.count()
            truncated = truncated or n > room
            step = step.orderBy("path").limit(max(room, 0))
            total += min(n, max(room, 0))
        seen = seen.unionByName(step.withColumn("hops", F.lit(hop)))
        frontier = step
    return seen.withColumn("truncated", F.lit(truncated))


def incoming(edges: DataFrame, documents: DataFrame, path: str, cap: int = 1000) -> DataFrame:
    """References to a document: the first ``cap`` in edge order, then by relationship, id and path."""
    order = F.create_map(*(F.lit(x) for k, e in enumerate(EDGES) for x in (e.section, k)))
    first = edges.where((F.col("resolved_path") == path) & F.col("issue").isNull()).orderBy(F.split("source_path", "/"), "rel_ord", "ref_ord").limit(cap)
    named = first.join(documents.select(F.col("path").alias("source_path"), F.col("canonical_id").alias("id")), "source_path")
    return named.select("relationship", "id", F.col("source_path").alias("path"), order[F.col("relationship")].alias("rank")).orderBy("rank", "id", "path")


def outgoing(edges: DataFrame, path: str, cap: int = 1000) -> DataFrame:
    """``(relationship, targets)`` of a document as written, in order, at most ``cap`` references."""
    first = edges.where(F.col("source_path") == path).orderBy("rel_ord", "ref_ord").limit(cap)
    grouped = first.groupBy("relationship", "rel_ord").agg(F.sort_array(F.collect_list(F.struct("ref_ord", "target"))).alias("t"))
    return grouped.orderBy("rel_ord").select("relationship", F.transform("t", lambda x: x["target"]).alias("targets"))


def drift(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """``(source_path, target_path, target_ref, source_epoch, target_epoch)``: targets that changed after what refers to them.

    ``commits(path, epoch)``. Of several edges between two documents the first gives ``target_ref``.
    """
    good = edges.where("resolved_path is not null and issue is null")
    timed = good.join(commits.select(F.col("path").alias("source_path"), F.col("epoch").alias("source_epoch")), "source_path").join(
        commits.select(F.col("path").alias("resolved_path"), F.col("epoch").alias("target_epoch")), "resolved_path")
    late = timed.where("target_epoch > source_epoch")
    first = F.min_by("target", F.struct("rel_ord", "ref_ord")).alias("target_ref")
    return late.groupBy("source_path", F.col("resolved_path").alias("target_path")).agg(
        first, F.min("source_epoch").alias("source_epoch"), F.min("target_epoch").alias("target_epoch"))


def unlinked_mentions(documents: DataFrame, aliases: DataFrame, edges: DataFrame) -> DataFrame:
    """``(source_path, target_path, token)``: ids that a document's text names without a declared edge, the first naming of each.

    Only aliases of one document, with a digit in them, count as names.
    """
    unique = aliases.where(F.col("key").rlike("[0-9]")).groupBy("key").agg(F.min("path").alias("target_path"), F.count_distinct("path").alias("n")).where("n = 1")
    text = F.array_join(F.flatten(F.transform("search_sections", lambda s: s["lines"])), "\n")
    words = documents.select(F.col("path").alias("source_path"), F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    named = words.withColumn("key", casefold(F.col("token"))).join(unique, "key").where("source_path <> target_path")
    declared = edges.where("resolved_path is not null").select("source_path", F.col("resolved_path").alias("target_path")).distinct()
    return named.join(declared, ["source_path", "target_path"], "left_anti").groupBy("source_path", "target_path").agg(F.min_by("token", "at").alias("token"))


def coverage(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """``(gap, path)``: live requirements on no roadmap (unscheduled), live decisions that no known document refers to (unapplied), without a scope (unscoped)."""
    kinds = documents.select("path", "type")
    good = edges.where("resolved_path is not null and issue is null")
    both = good.select("source_path", "resolved_path").unionByName(good.select(F.col("resolved_path").alias("source_path"), F.col("source_path").alias("resolved_path")))
    near = both.join(kinds.withColumnRenamed("path", "resolved_path").withColumnRenamed("type", "near"), "resolved_path")
    live = documents.where(~F.col("retired")).select("path", "type")
    gap = lambda name, kind, linked: (
        live.where(F.col("type") == kind).join(linked.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti").select(F.lit(name).alias("gap"), "path"))
    return (
        gap("unscheduled", "requirement", near.where("near = 'roadmap'"))
        .unionByName(gap("unapplied", "decision", near.where("near in ('requirement', 'roadmap', 'design')")))
        .unionByName(gap("unscoped", "decision", edges.where("relationship = 'applies to'")))
    )


def relationship_findings(documents: DataFrame, edges: DataFrame, unsupported: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Every finding about relationships as one table of ``FINDING`` columns.

    ``listing(path)`` are the files that path scopes may name; without it scopes are not looked up.
    """
    kind = documents.select(F.col("path").alias("resolved_path"), F.col("type").alias("to_type"), F.col("retired").alias("to_retired"))
    live = documents.where(~F.col("retired")).select(F.col("path").alias("source_path"))
    resolved = edges.where("resolved_path is not null and issue is null").join(kind, "resolved_path")
    ranges = F.create_map(*(F.lit(x) for e in EDGES if e.range for x in (e.section, e.range[0])))
    forbids = [e.section for e in EDGES if e.forbids_retired]
    at = {"path": F.col("source_path"), "relationship": F.col("relationship"), "target": F.col("target")}
    broken = {"target-not-found": "error", "target-ambiguous": "error", "self-reference": "warning"}
    parts = [
        duplicate_identifiers(documents).select(*finding("relationships", "duplicate-artifact-identifier", "error", identifier=F.col("identifier"), paths=F.col("paths"))),
        unsupported.select(*finding("relationships", "relationship-edge-unsupported", "warning", path=F.col("source_path"), relationship=F.col("relationship"))),
        resolved.where(ranges[F.col("relationship")] != F.col("to_type")).select(*finding("relationships", "relationship-target-type-mismatch", "error", **at)),
        resolved.where(F.col("to_retired") & F.col("relationship").isin(*forbids)).join(live, "source_path", "left_semi")
        .select(*finding("relationships", "relationship-target-superseded", "warning", **at)),
    ]
    pairs = edges.where("relationship = 'supersedes' and resolved_path is not null").select(F.col("source_path").alias("src"), F.col("resolved_path").alias("dst"))
    rings = cycles(pairs).groupBy("component").agg(F.sort_array(F.collect_list("member")).alias("paths"))
    parts.append(rings.select(*finding("relationships", "relationship-cycle", "error", relationship=F.lit("supersedes"), paths=F.col("paths"))))
    parts += [edges.where(F.col("issue") == code).select(*finding("relationships", code, severity, **at)) for code, severity in broken.items()]
    if listing is not None:
        scopes = edges.where("relationship = 'applies to'").where(~F.col("target").rlike(r"[*?\[]") & F.col("target").contains("/"))
        clean = scopes.withColumn("file", F.regexp_replace(F.regexp_replace("target", r"^\./", ""), "/$", ""))
        folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
        known = listing.select(F.explode(folders).alias("file")).distinct()
        parts.append(clean.join(known, "file", "left_anti").select(*finding("relationships", "applies-to-target-not-found", "error", **at)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
