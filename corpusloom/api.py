"""One corpus and everything that can be asked of it; each answer is a DataFrame.

The three tables that all answers read (documents, edges, entries) are built once and cached.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import artifacts, compare, graph, parse, reports, retrieve, rules, search
from corpusloom.sources import exports, history, markdown


class Corpus:
    """``Corpus.read(spark, folder)``, or from any ``(path, content)`` rows."""

    def __init__(self, files: DataFrame, provider: str | None = None, overrides: dict | None = None, ceilings: dict | None = None, commits: DataFrame | None = None):
        self.files, self.provider, self.overrides, self.ceilings, self._commits = files, provider, overrides, ceilings, commits
        self.spark = files.sparkSession

    @classmethod
    def read(cls, spark: SparkSession, folder: str, recursive: bool = True, **how) -> Corpus:
        return cls(markdown.read_corpus(spark, folder, recursive), **how)

    @classmethod
    def at_revision(cls, spark: SparkSession, repository: str, revision: str, subpath: str = "", **how) -> Corpus:
        return cls(markdown.read_revision(spark, repository, revision, subpath), **how)

    @cached_property
    def documents(self) -> DataFrame:
        return artifacts.artifacts(parse.parse(self.files)).cache()

    @cached_property
    def edges(self) -> DataFrame:
        return graph.resolve_references(artifacts.references(self.documents), graph.alias_table(self.documents)).cache()

    @cached_property
    def entries(self) -> DataFrame:
        return artifacts.index_entries(self.documents, graph.inbound_counts(self.edges)).cache()

    @cached_property
    def findings(self) -> DataFrame:
        """With the ticket provider; portfolio and statistics leave it out."""
        return rules.validate(self.documents, self.provider, self.overrides, self.ceilings)

    @cached_property
    def states(self) -> DataFrame:
        return rules.validity(self.documents, rules.validate(self.documents, None, self.overrides, self.ceilings))

    @cached_property
    def commits(self) -> DataFrame:
        return self._commits if self._commits is not None else self.spark.createDataFrame([], "path string, epoch long")

    @cached_property
    def relationships(self) -> DataFrame:
        return graph.relationship_findings(self.documents, self.edges, artifacts.unsupported_sections(self.documents), self.files.select("path"))

    @cached_property
    def successors(self) -> DataFrame:
        pairs = self.edges.where("relationship = 'supersedes' and resolved_path is not null").select(F.col("source_path").alias("newer"), F.col("resolved_path").alias("older"))
        return graph.successors(pairs, self.documents.where("live_decision").select("path"))

    def validate(self) -> DataFrame:
        return self.findings.orderBy(F.split("path", "/"), "seq")

    def totals(self) -> DataFrame:
        return reports.totals(rules.validity(self.documents, self.findings))

    def validate_proposed(self, content: bytes, path: str = "-") -> DataFrame:
        """Findings of a document in place of the one with its id, its own and those of its references."""
        one = artifacts.artifacts(parse.parse(markdown.one_document(self.spark, content, path)))
        documents = compare.proposed(self.documents, one)
        edges = graph.resolve_references(artifacts.references(documents), graph.alias_table(documents))
        found = graph.relationship_findings(documents, edges, artifacts.unsupported_sections(documents))
        own = found.where((F.col("path") == path) | F.array_contains("paths", path))
        return rules.as_findings(rules.validate(one, self.provider, self.overrides, self.ceilings)).unionByName(own)

    def inspect(self) -> DataFrame:
        return artifacts.inspect(self.documents)

    def improve(self) -> DataFrame:
        return artifacts.improvement(self.documents)

    def index(self) -> DataFrame:
        return self.documents.select(F.col("canonical_id").alias("id"), "type", "title", "path", "aliases").orderBy(F.split("path", "/"))

    def resolve(self, identifier: str) -> tuple[str, list[str]]:
        return graph.resolve_point(graph.alias_table(self.documents), identifier)

    def find(self, query: str, type: str | None = None, tags: list[str] | None = None, live: bool = False, decisions: bool = False) -> DataFrame:
        found = search.search(self.entries, query, type, tags, live, decisions, snippets=True)
        return search.final_order(history.with_recency(found, self.commits) if "stamp" in self.commits.columns else found)

    def retrieve(self, task: str, scope: str | None = None, top_k: int = 5, budget: int = 8000, live_only: bool = True) -> DataFrame:
        return retrieve.ground(self.documents, self.entries, self.successors, task, scope, top_k, budget, live_only).orderBy("position")

    def decisions_for(self, path: str) -> DataFrame:
        return retrieve.decisions_for(self.documents, path)

    def related(self, path: str, depth: int = 1) -> DataFrame:
        near = graph.neighbourhood(graph.adjacency(self.edges).select("path", "other"), self.spark.createDataFrame([(path,)], "path string"), depth)
        return near.join(self.documents.select("path", "type", F.col("canonical_id").alias("id")), "path").orderBy("hops", "type", "id")

    def stats(self) -> DataFrame:
        return reports.statistics(self.documents, self.states)

    def portfolio(self) -> DataFrame:
        return reports.portfolio(self.documents, self.edges, self.states)

    def coverage(self) -> DataFrame:
        return graph.coverage(self.documents, self.edges).orderBy("gap", F.split("path", "/"))

    def review(self, reference_epoch: int, stale_after: int = reports.STALE_DAYS) -> DataFrame:
        return reports.review(self.documents, self.edges, self.states, self.commits, reference_epoch, stale_after)

    def doctor(self, hub: int = reports.HUB_DEGREE) -> DataFrame:
        return reports.doctor(self.documents, self.edges, self.findings, self.relationships, self.commits, hub)

    def gate(self, policy: dict[str, list[str]] | None = None) -> DataFrame:
        return reports.gate(rules.as_findings(self.findings).unionByName(self.relationships), **(policy or {}))

    def compare(self, newer: Corpus) -> dict[str, DataFrame]:
        """What changed towards another state: documents, validity, issues, types, lists, texts, referrers, and what to do."""
        changes = compare.state_diff(self.documents, newer.documents, "path", "content_hash")
        states = [rules.validity(c.documents, c.findings) for c in (self, newer)]
        moved = compare.transitions(*states, "path", "state")
        texts = [c.documents.select("path", F.explode("requirements").alias("r")).select("path", "r.id", F.col("r.text").alias("text"), F.col("r.line").alias("at")) for c in (self, newer)]
        pairs = compare.requirement_diff(*texts, ["path", "id"], "text", "at")
        # a requirement that came to a document that was there says nothing by itself
        added = changes.where("change = 'added'").select("path", "change")
        told = pairs.where("change <> 'added'").unionByName(pairs.where("change = 'added'").join(added, ["path", "change"], "left_semi").select(*pairs.columns))
        intents = compare.intent(told.select(F.concat_ws("#", "path", "id").alias("key"), "old", "new"))
        return {
            "changes": compare.change_order(changes, "path"), "transitions": moved, "requirements": pairs, "intent": intents,
            "issues": compare.issue_difference(*(compare.issue_key(c.relationships) for c in (self, newer))), "types": compare.type_deltas(self.documents, newer.documents),
            "sections": compare.sections_removed(self.documents, newer.documents),
            "unlinked": compare.unlinked_scope(added.join(newer.documents.select("path", "type"), "path"), newer.edges), "impact": compare.relationship_impact(changes, self.edges),
            "recommendations": compare.watch(changes, moved, intents),
        }

    def export(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(documents, nodes, links)."""
        return (exports.document_rows(self.documents), *exports.graph_rows(self.documents, self.edges))

    def register(self) -> None:
        """Temp views ``documents``, ``edges``, ``entries`` and ``findings``, and the SQL function ``casefold``."""
        for name in ("documents", "edges", "entries", "findings"):
            getattr(self, name).createOrReplaceTempView(name)
        self.spark.udf.register("casefold", lambda x: None if x is None else x.casefold(), "string")

