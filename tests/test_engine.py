import pytest
from corpus import DOCS
from pyspark.sql import functions as F

from corpusloom.operators import artifacts as A
from corpusloom.operators import compare, evaluate, graph, parse, rename, reports, retrieve, rules, search
from corpusloom.sources import exports


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(p, bytearray(t.encode())) for p, t in DOCS.items()]
    return spark.createDataFrame(rows, "path string, content binary")


@pytest.fixture(scope="module")
def documents(corpus):
    return A.artifacts(parse.parse(corpus)).cache()


@pytest.fixture(scope="module")
def edges(documents):
    return graph.resolve_references(A.references(documents), graph.alias_table(documents)).cache()


def by_path(df, *columns):
    return {r.path: tuple(r[c] for c in columns) for r in df.collect()}


def test_parse_reads_sections_requirements_and_front_matter(documents):
    r = {x.path: x for x in documents.collect()}["req/req-1.md"]
    assert r.title == "Sign in" and r.front_id == "APP-0123456789AB" and r.tags == ["Login", "Straße"]
    assert [(q.id, q.line) for q in r.requirements] == [("REQ-001", 15), ("REQ-002", 16), ("REQ-001", 17)]
    assert [(m.bad_id, m.empty_text) for m in r.malformed] == [(None, False), ("REQ-X", False), ("REQ-9", True)]
    assert [s.name for s in r.sections] == ["problem", "requirements", "success metrics", "related decisions", "related roadmaps"]


@pytest.mark.parametrize(("text", "kinds"), [
    ("# A\nb\n===\n", ["h1", "h1"]), ("a\n-\n", ["h2"]), ("```\n# no\n```\n# yes", ["h1"]), ("    # code\n", []), ("> # quoted\n", ["h1"]),
    ("- # item\n  text\n", ["h1", "text"]), ("<div>\n# no\n\n# yes", ["h1"]), ("[a]: b\n\ntext", ["text"]), ("a\n***\nb", ["text", "text"]), ("#no", ["text"]),
    ("- a\n\n  b\nc", ["text", "text"]), ("1. a\n2. b", ["text", "text"]),
])
def test_blocks(text, kinds):
    assert [b.kind for b in parse.blocks(text.split("\n"))] == kinds


@pytest.mark.parametrize(("data", "codes"), [
    (b"---\nid: x\n", {"malformed-frontmatter"}), (b"---\na: 1\na: 2\n---\n", {"duplicate-frontmatter-key"}), (b"---\nschema_version: 2\n---\n", {"unsupported-schema-version"}),
    (b"---\nschema_version: 1\nid: bad id\n---\n", {"invalid-id-syntax"}), (b"---\nschema_version: true\nx: 1\n---\n", {"invalid-metadata-field"}), (b"\xff# x", {"non-utf8-content"}),
    (b"x" * ((1 << 20) + 1), {"artifact-oversize"}), (None, {"unreadable-artifact"}), (b"---\n- a\n---\n", {"malformed-frontmatter"}), (b"---\na: &x 1\nb: *x\n---\n", {"malformed-frontmatter"}),
    (b"", set()), (b"## s\n\n" + b"line\n\n" * 50001, {"body-truncated"}), (b"## s\n\n" + b"y" * 300000, {"field-truncated"}),
])
def test_findings_of_reading(data, codes):
    assert {i["code"] for i in parse.parse_document(data)["issues"]} == codes


def test_types_identity_and_status(documents):
    assert by_path(documents, "type", "canonical_id", "status", "retired", "live_decision") == {
        "req/req-1.md": ("requirement", "APP-0123456789AB", None, False, False), "dec/DEC-1-old.md": ("decision", "DEC-1", "Superseded", True, False),
        "dec/DEC-2-new.md": ("decision", "DEC-2", "Accepted", False, True), "plan.md": ("roadmap", "plan", None, False, False),
        "notes/_x.md": ("unknown", "_x", None, False, False),
    }
    assert by_path(documents, "aliases")["dec/DEC-2-new.md"] == (["DEC-2", "DEC-2-new"],)
    assert {(r.section, r.required) for r in A.improvement(documents.where("path = 'plan.md'")).collect()} == {("success measures", False), ("assumptions", False), ("risks", False)}


def test_edges_and_their_findings(documents, edges):
    got = sorted((r.source_path, r.relationship, r.target, r.resolved_path, r.issue) for r in edges.where("relationship <> 'applies to'").collect())
    assert ("req/req-1.md", "related decisions", "dec-2", "dec/DEC-2-new.md", None) in got and len([g for g in got if g[2].lower() == "dec-2"]) == 2
    assert ("req/req-1.md", "related decisions", "nothing-here", None, "target-not-found") in got
    assert by_path(graph.inbound_counts(edges).withColumnRenamed("resolved_path", "path"), "n")["dec/DEC-2-new.md"] == (2,)
    listing = documents.sparkSession.createDataFrame([("src/store/a.py",), ("docs/a/b.md",)], "path string")
    found = {(r.code, r.path) for r in graph.relationship_findings(documents, edges, A.unsupported_sections(documents), listing).collect()}
    assert found == {("target-not-found", "req/req-1.md"), ("relationship-edge-unsupported", "plan.md"), ("applies-to-target-not-found", "dec/DEC-2-new.md")}
    assert {r.path for r in graph.orphans(documents, edges).collect()} == set()
    assert graph.resolve_point(graph.alias_table(documents), " dec-1 ") == ("resolved", ["dec/DEC-1-old.md"])
    assert {(r.gap, r.path) for r in graph.coverage(documents, edges).collect()} == set()
    mentions = graph.unlinked_mentions(documents, graph.alias_table(documents), edges).collect()
    assert [tuple(r) for r in mentions] == [("plan.md", "dec/DEC-1-old.md", "DEC-1")]


def test_cycles_and_walks(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {(r.member, r.component) for r in graph.cycles(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    newer = spark.createDataFrame([("v2", "v1"), ("v3", "v2"), ("w", "v1"), ("p", "q"), ("q", "p")], "newer string, older string")
    live = spark.createDataFrame([("v3",), ("w",)], "path string")
    assert {(r.old, r.live) for r in graph.successors(newer, live).collect()} == {("v1", "v3"), ("v1", "w"), ("v2", "v3")}
    links = spark.createDataFrame([("a", x) for x in "bcdef"] + [("b", "z")], "path string, other string")
    start = spark.createDataFrame([("a",)], "path string")
    got = graph.neighbourhood(links, start, 2, frontier_cap=3).collect()
    assert {(r.path, r.hops) for r in got} == {("a", 0), ("b", 1), ("c", 1), ("d", 1), ("z", 2)} and all(r.truncated for r in got)


def test_rules(documents):
    found = rules.validate(documents, provider="jira")
    codes = {}
    for r in found.collect():
        codes.setdefault(r.path, set()).add(r.code)
    assert codes["req/req-1.md"] >= {"req-missing-id", "malformed-req-id", "empty-req-text", "duplicate-req-id", "missing-risks", "ambiguous-verb", "requirement-normative-keyword", "requirement-non-ears"}
    assert codes["dec/DEC-2-new.md"] == {"invalid-decision-category"} and codes["plan.md"] == {"invalid-roadmap-horizon"}
    assert "notes/_x.md" not in codes and "dec/DEC-1-old.md" not in codes
    off = rules.validate(documents, overrides={"invalid-decision-category": "off"}, type_ceilings={"roadmap": "warning"})
    assert {(r.path, r.severity) for r in off.where("type <> 'requirement'").collect()} == {("plan.md", "warning")}
    states = rules.validity(documents, found)
    assert by_path(states, "state") == {"req/req-1.md": ("invalid",), "dec/DEC-1-old.md": ("valid",), "dec/DEC-2-new.md": ("invalid",), "plan.md": ("invalid",), "notes/_x.md": ("skipped",)}
    assert {r.code for r in rules.bundle_names(documents).collect()} == {"okf-unmapped-type"}


def test_search_and_grounding(documents, edges, spark):
    entries = A.index_entries(documents, graph.inbound_counts(edges))
    hits = search.final_order(search.search(entries, "store", snippets=True)).collect()
    assert [h.path for h in hits] == ["dec/DEC-2-new.md", "dec/DEC-1-old.md"] and hits[0].field == "title" and hits[0].snippet is None
    assert search.search(entries, "slow", snippets=True).where("path like 'dec/DEC-2%'").first().snippet == "Files are slow."
    assert [h.path for h in search.search(entries, "store", live_only=True).collect()] == ["dec/DEC-2-new.md"]
    assert [(h.path, h.lexical_rank) for h in search.search(entries, "files", decisions_only=True).collect()][0][0] == "dec/DEC-2-new.md"
    assert search.search(entries, "...").collect() == [] and search.search(entries, "store zebra").collect() == []
    assert [h.path for h in search.search(entries, "sign", tags=["STRASSE"]).collect()] == ["req/req-1.md"]
    assert [h.path for h in search.search(entries, "sig", type="requirement").collect()] == ["req/req-1.md"]
    found = retrieve.decisions_for(documents, "docs/x/y.md").collect()
    assert [(r.id, r.entry) for r in found] == [("DEC-2", "docs/**/*.md")] and retrieve.decisions_for(documents, "other.txt").collect() == []
    pairs = edges.where("relationship = 'supersedes'").select(F.col("source_path").alias("newer"), F.col("resolved_path").alias("older"))
    heirs = graph.successors(pairs, documents.where("live_decision").select("path"))
    got = retrieve.ground(documents, entries, heirs, "old store", scope="src/store/x.py", budget=100).orderBy("position").collect()
    assert [(r.path, r.channels, r.superseded) for r in got] == [("dec/DEC-2-new.md", ["scope", "supersedes"], ["dec/DEC-1-old.md"])]
    assert len(got[0].excerpt) == 20


def test_budget():
    big = {"matches": [{"x": "a" * 50}] * 10}
    assert len(retrieve.fit(big, 200)["matches"]) == 2 and retrieve.fit(big, 10_000) is big
    assert retrieve.fit({"content": "é" * 500}, 100)["content"] == "é" * 66
    item = retrieve.fit({"items": [{"excerpt": "a" * 100}]}, 90)["items"]
    assert 0 < len(item[0]["excerpt"]) < 100
    assert retrieve.call_budget(100, 500) == 100 and retrieve.call_budget(100, 5) == 5


def test_reports(documents, edges, spark):
    found = rules.validate(documents)
    states = rules.validity(documents, found)
    one = reports.portfolio(documents, edges, states).first()
    assert (one.checked, one.valid, one.invalid, one.skipped) == (4, 1, 3, 1) and 0 <= one.health <= 100
    assert one.filled == 4 and one.slots == 12 and one.completeness == 0.3333
    assert {(r.path, r.code) for r in reports.attention(documents, edges, states).collect()} >= {("req/req-1.md", "broken-relationship"), ("plan.md", "invalid-artifact"), ("plan.md", "missing-recommended")}
    commits = spark.createDataFrame([("req/req-1.md", 100), ("dec/DEC-2-new.md", 200)], "path string, epoch long")
    got = reports.review(documents, edges, states, commits, 86400 * 400).collect()
    assert [r.priority for r in got] == sorted(r.priority for r in got)
    assert {r.code for r in got} == {"invalid-artifact", "broken-relationship", "suspect-drift", "unclassified", "missing-recommended", "stale-corpus"}
    health = reports.doctor(documents, edges, found, graph.relationship_findings(documents, edges, A.unsupported_sections(documents)), commits)
    codes = {r.code for r in health.collect()}
    assert codes >= {"injection", "suspect-drift", "target-not-found", "invalid-roadmap-horizon"}
    assert not reports.severity_totals(health).first().ok
    assert reports.largest_feature(documents).first().path == "req/req-1.md"
    stats = {r.type: r for r in reports.statistics(documents, states).collect()}
    assert stats["requirement"].requirements == 3 and stats["decision"].invalid == ["dec/DEC-2-new.md"]
    assert [r.value for r in reports.bucket_counts(documents, "status", ["Proposed", "Accepted", "Superseded"]).collect()] == ["Accepted", "Superseded"]
    judged = reports.gate(health, off=["injection"], advisory=["target-not-found"])
    assert "injection" not in {r.code for r in judged.collect()} and {r.verdict for r in judged.where("code = 'target-not-found'").collect()} == {"advisory"}


def test_comparison(documents, corpus, spark):
    changed = dict(DOCS)
    changed["req/req-1.md"] = changed["req/req-1.md"].replace("- [REQ-002] Handle errors\n", "").replace("- fewer calls\n", "")
    changed.pop("plan.md")
    after = A.artifacts(parse.parse(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in changed.items()], "path string, content binary")))
    diff = compare.state_diff(documents, after, "path", "content_hash")
    assert {(r.path, r.change) for r in diff.collect()} == {("req/req-1.md", "modified"), ("plan.md", "removed")}
    assert compare.state_diff(documents, documents, "path", "content_hash").collect() == []
    assert [(r.path, r.code) for r in compare.sections_removed(documents, after).collect()] == [("req/req-1.md", "success_measures_removed")]
    accepted = documents.where("path like 'req%'").withColumn("sections", F.expr("concat(sections, array(named_struct('name', 'acceptance criteria', 'body', 'x')))"))
    assert ("req/req-1.md", "acceptance_criteria_removed") in {(r.path, r.code) for r in compare.sections_removed(accepted, after).collect()}
    fresh = spark.createDataFrame([("a.md", "decision"), ("b.md", "decision"), ("c.md", "unknown"), ("d.md", "prompt")], "path string, type string")
    links = spark.createDataFrame([("a.md", None), ("z.md", "d.md")], "source_path string, resolved_path string")
    assert [tuple(r) for r in compare.unlinked_scope(fresh, links).collect()] == [("b.md", "unlinked_scope")]
    states = [rules.validity(d, rules.validate(d)) for d in (documents, after)]
    assert compare.transitions(*states, "path", "state").collect() == []
    pairs = spark.createDataFrame([("a", "It must take 5 s", "It may be fast"), ("d", None, "simple"), ("e", "It must run", "It might run"), ("f", "fast", "Fast and easy"), ("b", "It must run", None), ("c", "x", "y")], "key string, old string, new string")
    assert {(r.key, r.code) for r in compare.intent(pairs).collect()} == {("a", "specificity_regression"), ("a", "ambiguity_introduced"), ("a", "constraint_weakened"), ("b", "constraint_removed"), ("d", "ambiguity_introduced"), ("f", "ambiguity_introduced")}
    assert compare.watch(diff, compare.transitions(*states, "path", "state"), compare.intent(pairs)).count() == 5
    one = after.where("path like 'dec/DEC-2%'").withColumn("path", F.lit("new.md"))
    assert sorted(r.path for r in compare.proposed(documents, one).collect()) == ["dec/DEC-1-old.md", "new.md", "notes/_x.md", "plan.md", "req/req-1.md"]


def test_evaluation():
    good = {"p_at_1": 1.0, "r_at_5": 0.99, "violations": 0}
    assert evaluate.gate(good, {"p_at_1": 1.0}, {"r_at_5": 0.95}, 0.02) == []
    assert len(evaluate.gate(dict(good, p_at_1=0.5, violations=2), {"p_at_1": 1.0}, {"p_at_1": 0.9}, 0.02)) == 3


def test_case_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "x", 3)], "case string, doc string, position int")
    rel = spark.createDataFrame([("q", "b"), ("q", "c"), ("none", "z")], "case string, doc string")
    bad = spark.createDataFrame([("q", "x")], "case string, doc string")
    got = {r.case: r for r in evaluate.case_metrics(ranked, rel, bad).collect()}
    assert (got["q"].p_at_1, got["q"].p_at_3, got["q"].r_at_5, got["q"].violations) == (0, 1 / 3, 0.5, 1) and got["none"].r_at_5 == 0
    assert evaluate.macro_means(evaluate.case_metrics(ranked, rel, bad)).first().r_at_5 == 0.25


def test_exports_and_rename(documents, edges, corpus):
    rows = {r.path: r for r in exports.document_rows(documents).collect()}
    assert rows["plan.md"].status == "unknown" and rows["dec/DEC-2-new.md"].id == "DEC-2"
    _, links = exports.graph_rows(documents, edges)
    assert ("DEC-2", "supersedes", "DEC-1") in {tuple(r) for r in links.collect()}
    texts = corpus.select("path", F.col("content").cast("string").alias("text"))
    page = exports.portal_page(exports.viewer_rows(documents, edges, texts), "t")
    assert "\\u003ch1\\u003e" in page and page.count("</script>") == 1
    bundle = {r.path: r.text for r in exports.bundle_rows(documents, edges).collect()}
    assert "supersedes: DEC-1" in bundle["dec/DEC-2-new.md"] and "DEC-2 New store" in bundle["index.md"]
    block = exports.rules_block(documents)
    assert "DEC-2: New store" in block and exports.has_drifted("x", block)
    once = exports.splice("# Agents\n", block)
    assert exports.splice(once, block) == once and not exports.has_drifted(once, block)
    assert [rename.refusal(documents, a, b) for a, b in (("nope", "A-1"), ("DEC-1", "x y"), ("DEC-1", "dec-2"), ("DEC-1", "DEC-9"))] == ["not-found", "invalid", "collides", "filename-only"]
    assert rename.refusal(documents, "APP-0123456789AB", "APP-1") is None
    lines = documents.sparkSession.createDataFrame([("a.md", 3, "- DEC-1", "reference"), ("a.md", 4, "DEC-1 in text", "text"), ("b.md", 1, "id: dec-1", "identity")], "path string, line int, text string, kind string")
    assert {(r.path, r.after) for r in rename.edits(lines, "DEC-1", "DEC-7").collect()} == {("a.md", "- DEC-7"), ("b.md", "id: DEC-7")}


def test_successors_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(f"v{i + 1}", f"v{i}") for i in range(53)], "newer string, older string").coalesce(1)
    live = spark.createDataFrame([("v53",)], "path string").coalesce(1)
    assert ("v0", "v53") in {(r.old, r.live) for r in graph.successors(pairs, live).collect()}


def test_requirement_standards(spark):
    cases = {
        "The system must act": ["requirement-normative-keyword"], "The system MUST act and SHALL log": ["requirement-not-singular"], "Handle errors": ["ambiguous-verb", "requirement-non-ears"],
        " If idle the system SHALL stop": ["requirement-ears-clause"], "If idle then it SHALL stop": [], "If idle, stop": ["requirement-non-ears"], "Ifs SHALL be": [], "MUST support export": ["ambiguous-verb"],
        "supports and handles SHALL": [], "Should it Must": ["requirement-normative-keyword", "requirement-not-singular"], "mustard SHALL be yellow": [],
    }
    for text, codes in cases.items():
        body = f"# T\n\n## Problem\n\nx\n\n## Requirements\n\n- [REQ-001] {text}\n\n## Success metrics\n\nx\n\n## Risks\n\nx\n"
        one = A.artifacts(parse.parse(spark.createDataFrame([("r.md", bytearray(body.encode()))], "path string, content binary")))
        assert [r.code for r in rules.validate(one).orderBy("seq").collect()] == codes, text
    shapes = spark.createDataFrame([("1234",), ("AB#1",), ("#12",), ("o/r#1",), ("INC00100",), ("AB1234",), ("A-1",)], "t string")
    fits = lambda p: [r.t for r in shapes.where(F.col("t").rlike(rules.TICKETS[p])).collect()]
    assert (fits("azure-devops"), fits("github"), fits("servicenow"), fits("linear"), fits("jira")) == (["1234", "AB#1"], ["o/r#1"], ["INC00100"], ["A-1"], [])


def test_numbers_and_sums_over_ranges(spark):
    from corpusloom.sources.staging import numbered, preceding, spread

    df = spark.range(1000).selectExpr("id * 7919 % 1009 AS v", "id % 3 AS kind", "id % 5 AS w")
    assert [r.n for r in numbered(df, "n", "v").orderBy("v").collect()] == list(range(1, 1001))
    want, total = {}, {}
    for r in sorted(df.collect(), key=lambda r: -r.v):
        want[r.v] = total.get(r.kind, 0)
        total[r.kind] = want[r.v] + r.w
    got = preceding(df, "before", "w", [F.desc("v")], "kind")
    assert {r.v: r.before for r in got.collect()} == want
    assert numbered(df.limit(0), "n", "v").collect() == [] and spread(spark.range(9).coalesce(1)).rdd.getNumPartitions() > 1
