"""Documents parsed, validated and reported on: Markdown made of whole texts, read by the parser.

Each row of ``documents`` becomes one Markdown document: its words, a type by ``doc_id % 6`` and, by
other remainders, the faults that the rules look for. The SQL states what must be found, from the same remainders.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import artifacts, compare, graph, parse, rename, reports, retrieve, rules
from corpusloom.plans.tables import table
from corpusloom.sources import exports
from corpusloom.sources.staging import staged

#: The Markdown of a row with ``doc_id``, ``lang``, ``source`` and ``body``: an expression of both SQL dialects.
MARKDOWN = """
CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'schema_version: ' || CASE WHEN doc_id % 29 = 0 THEN '2' ELSE '1' END || chr(10)
  || 'id: ' || CASE WHEN doc_id % 23 = 0 THEN 'bad id' ELSE 'DOC-' || lpad(CAST(doc_id AS STRING), 12, '0') END || chr(10)
  || 'tags: [' || lang || ', ' || source || ']' || chr(10) || '---' || chr(10) ELSE '' END
|| CASE WHEN doc_id % 17 = 0 THEN '' ELSE '# Document ' || CAST(doc_id AS STRING) || chr(10) || chr(10) END
|| CASE doc_id % 6
  WHEN 0 THEN '## Problem' || chr(10) || chr(10) || body || chr(10) || chr(10) || '## Requirements' || chr(10) || chr(10) || '- [REQ-001] '
    || CASE doc_id % 30 - doc_id % 6 WHEN 0 THEN 'The system must act' WHEN 6 THEN 'The system MUST act and SHALL log' WHEN 12 THEN 'Handle errors' WHEN 18 THEN 'If idle the system SHALL stop' ELSE 'The system SHALL act' END || chr(10)
    || CASE doc_id % 24 - doc_id % 6 WHEN 0 THEN '- no id here' WHEN 6 THEN '- [REQ-X] bad' WHEN 12 THEN '- [REQ-9]' ELSE '- [REQ-001] the system shall act' END || chr(10) || chr(10)
    || '## Success metrics' || chr(10) || chr(10) || '- fewer calls' || chr(10) || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '## Risks' || chr(10) || chr(10) || '- none' || chr(10) || chr(10) END
  WHEN 1 THEN '## Context' || chr(10) || chr(10) || body || chr(10) || chr(10) || '## Decision' || chr(10) || chr(10) || 'Use tables' || chr(10) || chr(10)
    || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '## Consequences' || chr(10) || chr(10) || 'slow' || chr(10) || chr(10) END
    || '## Status' || chr(10) || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'Odd' ELSE 'superseded' END || chr(10) || chr(10)
    || '## Category' || chr(10) || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'Magic' ELSE 'product' END || chr(10) || chr(10)
    || '## Supersedes' || chr(10) || chr(10) || '- DOC-' || CAST(doc_id - 6 AS STRING) || chr(10) || chr(10)
    || '## Applies to' || chr(10) || chr(10) || '- ./lib/' || source || '/' || chr(10) || '- docs/*.md' || chr(10) || chr(10)
  WHEN 2 THEN '## Outcomes' || chr(10) || chr(10) || body || chr(10) || chr(10) || '## Initiatives' || chr(10) || chr(10) || 'b' || chr(10) || chr(10)
    || '## Horizon' || chr(10) || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Next' ELSE CASE doc_id % 3 WHEN 2 THEN CASE doc_id % 5 WHEN 1 THEN 'sometime' ELSE 'Q3 2025' END ELSE 'now' END END || chr(10) || chr(10)
    || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '## Related requirements' || chr(10) || chr(10) || '- DOC-' || CAST(doc_id + 4 AS STRING) || chr(10) || chr(10) END
  WHEN 3 THEN '## Objective' || chr(10) || chr(10) || body || chr(10) || chr(10) || '## Input' || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || '## Instructions' || chr(10) || chr(10) || 'y' || chr(10) || chr(10)
    || CASE WHEN doc_id % 7 = 0 THEN '' ELSE CASE WHEN doc_id % 5 = 0 THEN '## Output' ELSE '## Expected output' END || chr(10) || chr(10) || 'z' || chr(10) || chr(10) END || '## Related decisions' || chr(10) || chr(10) || '* DOC-' || CAST(doc_id - 2 AS STRING) || chr(10) || chr(10)
  WHEN 4 THEN '## Context' || chr(10) || chr(10) || body || chr(10) || chr(10) || '## User need' || chr(10) || chr(10) || 'x' || chr(10) || chr(10) || '## Design' || chr(10) || chr(10) || 'y' || chr(10) || chr(10)
    || '## Constraints' || chr(10) || chr(10) || 'z' || chr(10) || chr(10) || '## Related prompts' || chr(10) || chr(10) || '- doc-' || CAST(doc_id - 1 AS STRING) || chr(10) || chr(10)
    || CASE WHEN doc_id % 5 = 0 THEN '## Supersedes' || chr(10) || chr(10) || '- DOC-1' || chr(10) || chr(10) ELSE '' END
    || '## Related tickets' || chr(10) || chr(10) || '- ' || CASE doc_id % 7 WHEN 0 THEN 'no ticket' WHEN 1 THEN 'https://t.test/1' ELSE 'ABC-12' END || chr(10) || chr(10)
  ELSE '## Notes' || chr(10) || chr(10) || body || chr(10) || chr(10) END
|| CASE WHEN doc_id % 19 = 0 THEN '# Second' || chr(10) ELSE '' END
"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """``(path, content)``: the Markdown documents."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N} ]", "")))
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", F.array_join(F.filter(lines, lambda x: x != ""), "\n").alias("body"))
    return rows.select(F.concat("source", F.lit("/DOC-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode(F.expr(MARKDOWN), "UTF-8").alias("content"))


@cache
def _documents(session: str, spark_of: tuple, sf: str) -> DataFrame:
    spark = spark_of[0]
    return staged(artifacts.artifacts(parse.parse(corpus(spark, sf))), "documents")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The parsed documents; parsed once in a session, as a written table."""
    return _documents(spark.sparkContext.applicationId, (spark,), sf)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return graph.resolve_references(artifacts.references(d), graph.alias_table(d))


_DOCS = """d AS (SELECT *, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[^\\p{L}\\p{N} ]', '', 'g'))), lambda x: x <> ''), chr(10)) AS body,
    source || '/DOC-' || doc_id || '.md' AS path, doc_id AS k,
    CASE doc_id % 6 WHEN 0 THEN 'requirement' WHEN 1 THEN 'decision' WHEN 2 THEN 'roadmap' WHEN 3 THEN 'prompt' WHEN 4 THEN 'design' ELSE 'unknown' END AS type FROM documents
), m AS (SELECT *, __MD__ AS md,
    CASE WHEN k % 17 <> 0 THEN 'Document ' || k WHEN k % 19 = 0 THEN 'Second' END AS title,
    CASE WHEN k % 2 = 0 AND k % 23 <> 0 THEN 'DOC-' || lpad(k::VARCHAR, 12, '0') END AS front_id,
    CASE WHEN type <> 'decision' THEN NULL ELSE CASE k % 4 WHEN 0 THEN 'Proposed' WHEN 1 THEN 'Accepted' WHEN 2 THEN 'Odd' ELSE 'Superseded' END END AS status,
    CASE WHEN type = 'decision' THEN CASE WHEN k % 5 = 0 THEN 'Magic' ELSE 'product' END END AS category FROM d
), l AS (SELECT *, 1 + length(substr(md, 1, strpos(md, '- [REQ-001]') - 1)) - length(replace(substr(md, 1, strpos(md, '- [REQ-001]') - 1), chr(10), '')) AS ln,
    length(md) - length(replace(md, chr(10), '')) AS n_lines FROM m
)""".replace("__MD__", MARKDOWN)

_SECTIONS = """sec AS (SELECT path, k, type, unnest(CASE k % 6
    WHEN 0 THEN [['problem', body], ['requirements', '[REQ-001] ' || CASE k % 30 - k % 6 WHEN 0 THEN 'The system must act' WHEN 6 THEN 'The system MUST act and SHALL log' WHEN 12 THEN 'Handle errors' WHEN 18 THEN 'If idle the system SHALL stop' ELSE 'The system SHALL act' END || chr(10)
        || CASE k % 24 - k % 6 WHEN 0 THEN 'no id here' WHEN 6 THEN '[REQ-X] bad' WHEN 12 THEN '[REQ-9]' ELSE '[REQ-001] the system shall act' END], ['success metrics', 'fewer calls'], CASE WHEN k % 7 <> 0 THEN ['risks', 'none'] END]
    WHEN 1 THEN [['context', body], ['decision', 'Use tables'], CASE WHEN k % 7 <> 0 THEN ['consequences', 'slow'] END, ['status', CASE k % 4 WHEN 0 THEN 'Proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'Odd' ELSE 'superseded' END],
        ['category', CASE WHEN k % 5 = 0 THEN 'Magic' ELSE 'product' END], ['supersedes', 'DOC-' || (k - 6)], ['applies to', './lib/' || source || '/' || chr(10) || 'docs/*.md']]
    WHEN 2 THEN [['outcomes', body], ['initiatives', 'b'], ['horizon', CASE WHEN k % 4 = 0 THEN 'Next' WHEN k % 5 = 1 THEN 'sometime' ELSE 'Q3 2025' END], CASE WHEN k % 5 <> 0 THEN ['related requirements', 'DOC-' || (k + 4)] END]
    WHEN 3 THEN [['objective', body], ['input', 'x'], ['instructions', 'y'], CASE WHEN k % 7 <> 0 THEN [CASE WHEN k % 5 = 0 THEN 'output' ELSE 'expected output' END, 'z'] END, ['related decisions', 'DOC-' || (k - 2)]]
    WHEN 4 THEN [['context', body], ['user need', 'x'], ['design', 'y'], ['constraints', 'z'], ['related prompts', 'doc-' || (k - 1)], CASE WHEN k % 5 = 0 THEN ['supersedes', 'DOC-1'] END,
        ['related tickets', CASE k % 7 WHEN 0 THEN 'no ticket' WHEN 1 THEN 'https://t.test/1' ELSE 'ABC-12' END]]
    ELSE [['notes', body]] END) AS s FROM m)"""

_REFERENCES = """refs AS (
  SELECT path AS source_path, type, 'supersedes' AS relationship, 'DOC-' || (k - 6) AS target, k - 6 AS wanted FROM m WHERE type = 'decision'
  UNION ALL SELECT path, type, 'applies to', './lib/' || source || '/', NULL FROM m WHERE type = 'decision'
  UNION ALL SELECT path, type, 'applies to', 'docs/*.md', NULL FROM m WHERE type = 'decision'
  UNION ALL SELECT path, type, 'related requirements', 'DOC-' || (k + 4), k + 4 FROM m WHERE type = 'roadmap' AND k % 5 <> 0
  UNION ALL SELECT path, type, 'related decisions', 'DOC-' || (k - 2), k - 2 FROM m WHERE type = 'prompt'
  UNION ALL SELECT path, type, 'related prompts', 'doc-' || (k - 1), k - 1 FROM m WHERE type = 'design'
  UNION ALL SELECT path, type, 'related tickets', CASE k % 7 WHEN 0 THEN 'no ticket' WHEN 1 THEN 'https://t.test/1' ELSE 'ABC-12' END, NULL FROM m WHERE type = 'design'
), e AS (SELECT r.*, t.path AS resolved_path, CASE WHEN r.wanted IS NOT NULL AND t.path IS NULL THEN 'target-not-found' END AS issue FROM refs r LEFT JOIN m t ON t.k = r.wanted)"""

_FINDINGS = """f AS (
  SELECT path, type, 'unsupported-schema-version' AS code, 'error' AS severity, NULL::BIGINT AS line FROM l WHERE k % 2 = 0 AND k % 29 = 0
  UNION ALL SELECT path, type, 'invalid-id-syntax', 'error', NULL FROM l WHERE k % 2 = 0 AND k % 23 = 0
  UNION ALL SELECT path, type, 'missing-title', 'error', NULL FROM l WHERE title IS NULL AND type <> 'unknown'
  UNION ALL SELECT path, type, 'multiple-titles', 'error', n_lines FROM l WHERE k % 19 = 0 AND k % 17 <> 0 AND type <> 'unknown'
  UNION ALL SELECT path, type, 'requirement-normative-keyword', 'error', ln FROM l WHERE type = 'requirement' AND k % 30 - k % 6 = 0
  UNION ALL SELECT path, type, 'requirement-normative-keyword', 'error', ln + 1 FROM l WHERE type = 'requirement' AND k % 24 - k % 6 = 18
  UNION ALL SELECT path, type, 'requirement-not-singular', 'warning', ln FROM l WHERE type = 'requirement' AND k % 30 - k % 6 = 6
  UNION ALL SELECT path, type, 'ambiguous-verb', 'warning', ln FROM l WHERE type = 'requirement' AND k % 30 - k % 6 = 12
  UNION ALL SELECT path, type, 'requirement-non-ears', 'warning', ln FROM l WHERE type = 'requirement' AND k % 30 - k % 6 = 12
  UNION ALL SELECT path, type, 'requirement-ears-clause', 'warning', ln FROM l WHERE type = 'requirement' AND k % 30 - k % 6 = 18
  UNION ALL SELECT path, type, 'req-missing-id', 'error', ln + 1 FROM l WHERE type = 'requirement' AND k % 24 - k % 6 = 0
  UNION ALL SELECT path, type, 'malformed-req-id', 'error', ln + 1 FROM l WHERE type = 'requirement' AND k % 24 - k % 6 = 6
  UNION ALL SELECT path, type, 'empty-req-text', 'error', ln + 1 FROM l WHERE type = 'requirement' AND k % 24 - k % 6 = 12
  UNION ALL SELECT path, type, 'duplicate-req-id', 'error', ln FROM l WHERE type = 'requirement' AND k % 24 - k % 6 = 18
  UNION ALL SELECT path, type, 'duplicate-req-text', 'warning', ln FROM l WHERE type = 'requirement' AND k % 24 - k % 6 = 18 AND k % 30 - k % 6 = 24
  UNION ALL SELECT path, type, 'missing-risks', 'warning', NULL FROM l WHERE type = 'requirement' AND k % 7 = 0
  UNION ALL SELECT path, type, 'empty-problem', 'warning', NULL FROM l WHERE type = 'requirement' AND body = ''
  UNION ALL SELECT path, type, 'missing-consequences', 'error', NULL FROM l WHERE type = 'decision' AND k % 7 = 0
  UNION ALL SELECT path, type, 'invalid-decision-status', 'error', NULL FROM l WHERE type = 'decision' AND status = 'Odd'
  UNION ALL SELECT path, type, 'invalid-decision-category', 'error', NULL FROM l WHERE type = 'decision' AND k % 5 = 0
  UNION ALL SELECT path, type, 'invalid-roadmap-horizon', 'error', NULL FROM l WHERE type = 'roadmap' AND k % 4 <> 0 AND k % 5 = 1
  UNION ALL SELECT path, type, 'roadmap-no-advancement-link', 'warning', NULL FROM l WHERE type = 'roadmap' AND k % 5 = 0
  UNION ALL SELECT path, type, 'missing-output', 'error', NULL FROM l WHERE type = 'prompt' AND (k % 7 = 0 OR k % 5 <> 0))"""
_TICKETS = ", ft AS (SELECT * FROM f UNION ALL SELECT path, type, 'malformed-ticket-reference', 'error', NULL FROM l WHERE type = 'design' AND k % 7 = 0)"
_STATES = "st AS (SELECT path, k, type, status, title, body, CASE WHEN type = 'unknown' THEN 'skipped' WHEN EXISTS (SELECT 1 FROM f WHERE f.path = l.path AND severity = 'error') THEN 'invalid' ELSE 'valid' END AS state FROM l)"


QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


# --- reading ----------------------------------------------------------------------------------------------------------
@query("parsed_documents", f"WITH {_DOCS} SELECT path, title, CASE WHEN k % 19 = 0 AND k % 17 <> 0 THEN [n_lines] ELSE [] END AS extra_title_lines, k % 2 = 0 AS has_front, front_id, CASE WHEN k % 2 = 0 THEN [lang, source] ELSE [] END AS tags, sha256(md) AS content_hash FROM l")
def parsed_documents(spark, sf):
    return documents(spark, sf).select("path", "title", "extra_title_lines", "has_front", "front_id", "tags", "content_hash")


@query("parsed_sections", f"WITH {_DOCS}, {_SECTIONS} SELECT path, s[1] AS name, md5(s[2]) AS body FROM sec WHERE s IS NOT NULL")
def parsed_sections(spark, sf):
    return documents(spark, sf).select("path", F.explode("sections").alias("s")).select("path", "s.name", F.md5(F.col("s.body").cast("binary")).alias("body"))


@query("search_sections", f"WITH {_DOCS}, {_SECTIONS} SELECT path, upper(s[1][1]) || s[1][2:] AS heading, CASE WHEN s[2] = '' THEN 0 ELSE len(string_split(s[2], chr(10))) END AS lines FROM sec WHERE s IS NOT NULL")
def search_sections(spark, sf):
    return documents(spark, sf).select("path", F.explode("search_sections").alias("s")).select("path", "s.heading", F.size("s.lines").cast("long").alias("lines"))


@query("parsed_requirements", f"WITH {_DOCS} SELECT path, 'REQ-001' AS id, CASE k % 30 - k % 6 WHEN 0 THEN 'The system must act' WHEN 6 THEN 'The system MUST act and SHALL log' WHEN 12 THEN 'Handle errors' WHEN 18 THEN 'If idle the system SHALL stop' ELSE 'The system SHALL act' END AS text, ln AS line FROM l WHERE type = 'requirement' UNION ALL SELECT path, 'REQ-001', 'the system shall act', ln + 1 FROM l WHERE type = 'requirement' AND k % 24 - k % 6 = 18")
def parsed_requirements(spark, sf):
    return documents(spark, sf).select("path", F.explode("requirements").alias("r")).select("path", "r.*")


@query("malformed_requirements", f"WITH {_DOCS} SELECT path, CASE k % 24 - k % 6 WHEN 0 THEN 'no id here' WHEN 6 THEN '[REQ-X] bad' ELSE '[REQ-9]' END AS raw, ln + 1 AS line, CASE k % 24 - k % 6 WHEN 6 THEN 'REQ-X' WHEN 12 THEN 'REQ-9' END AS bad_id, k % 24 - k % 6 = 12 AS empty_text FROM l WHERE type = 'requirement' AND k % 24 - k % 6 <> 18")
def malformed_requirements(spark, sf):
    return documents(spark, sf).select("path", F.explode("malformed").alias("r")).select("path", "r.*")


@query("captured_lists", f"WITH {_DOCS} SELECT path, CASE WHEN type <> 'requirement' OR body = '' THEN 0 ELSE len(string_split(body, chr(10))) END AS problem, (type = 'requirement')::BIGINT AS success_metrics, (type = 'requirement' AND k % 7 <> 0)::BIGINT AS risks FROM m")
def captured_lists(spark, sf):
    return documents(spark, sf).select("path", *(F.size(c).cast("long").alias(c) for c in ("problem", "success_metrics", "risks")))


@query("reading_issues", f"WITH {_DOCS}, {_FINDINGS} SELECT path, code, severity FROM f WHERE code IN ('unsupported-schema-version', 'invalid-id-syntax')")
def reading_issues(spark, sf):
    return documents(spark, sf).select("path", F.explode("issues").alias("i")).select("path", "i.code", "i.severity")


# --- type, identity, references ---------------------------------------------------------------------------------------
@query("typed_documents", f"""WITH {_DOCS} SELECT path, type, status, category, coalesce(status = 'Superseded', false) AS retired, coalesce(status = 'Accepted', false) AS live_decision,
  CASE type WHEN 'requirement' THEN CASE WHEN k % 7 = 0 THEN 0.71 ELSE 0.86 END WHEN 'decision' THEN CASE WHEN k % 7 = 0 THEN 0.67 ELSE 0.89 END WHEN 'roadmap' THEN 0.57 WHEN 'prompt' THEN CASE WHEN k % 7 = 0 THEN 0.55 ELSE 0.73 END WHEN 'design' THEN 0.62 ELSE 0 END::DOUBLE AS confidence FROM m""")
def typed_documents(spark, sf):
    return artifacts.inspect(documents(spark, sf)).select("path", "type", "status", "category", "confidence").join(documents(spark, sf).select("path", "retired", "live_decision"), "path")


@query("document_identity", f"WITH {_DOCS} SELECT path, coalesce(front_id, 'DOC-' || k) AS canonical_id, list_filter([front_id, 'DOC-' || k], lambda x: x IS NOT NULL) AS aliases FROM m")
def document_identity(spark, sf):
    return documents(spark, sf).select("path", "canonical_id", "aliases")


@query("document_references", f"WITH {_DOCS}, {_REFERENCES} SELECT source_path, type, relationship, target FROM refs")
def document_references(spark, sf):
    return artifacts.references(documents(spark, sf)).select("source_path", "type", "relationship", "target")


@query("document_edges", f"WITH {_DOCS}, {_REFERENCES} SELECT source_path, relationship, target, resolved_path, issue FROM e")
def document_edges(spark, sf):
    return edges(spark, sf).select("source_path", "relationship", "target", "resolved_path", "issue")


@query("unsupported_sections", f"WITH {_DOCS} SELECT path AS source_path, 'supersedes' AS relationship FROM m WHERE type = 'design' AND k % 5 = 0")
def unsupported_sections(spark, sf):
    return artifacts.unsupported_sections(documents(spark, sf))


@query("missing_sections", f"""WITH {_DOCS} SELECT path, type, unnest(CASE type WHEN 'requirement' THEN CASE WHEN k % 7 = 0 THEN ['risks', 'assumptions'] ELSE ['assumptions'] END
    WHEN 'decision' THEN CASE WHEN k % 7 = 0 THEN ['consequences', 'alternatives considered'] ELSE ['alternatives considered'] END WHEN 'roadmap' THEN ['success measures', 'assumptions', 'risks']
    WHEN 'prompt' THEN CASE WHEN k % 7 = 0 THEN ['output', 'constraints', 'examples', 'evaluation'] ELSE ['constraints', 'examples', 'evaluation'] END
    ELSE ['rationale', 'alternatives', 'accessibility', 'style guidance', 'open questions'] END) AS section FROM m WHERE type <> 'unknown'""".replace("SELECT path, type, unnest", "SELECT *, section IN ('consequences', 'output') AS required FROM (SELECT path, type, unnest").replace("WHERE type <> 'unknown'", "WHERE type <> 'unknown')"))
def missing_sections(spark, sf):
    return artifacts.improvement(documents(spark, sf))


@query("index_entries", f"WITH {_DOCS}, {_REFERENCES}, n AS (SELECT resolved_path AS path, count(*) AS n FROM e WHERE resolved_path IS NOT NULL GROUP BY 1) SELECT m.path, coalesce(front_id, 'DOC-' || k) AS id, type, title, coalesce(n, 0) AS inbound, coalesce(status = 'Superseded', false) AS retired FROM m LEFT JOIN n ON n.path = m.path")
def index_entries(spark, sf):
    return artifacts.index_entries(documents(spark, sf), graph.inbound_counts(edges(spark, sf))).select("path", "id", "type", "title", "inbound", "retired")


# --- rules ------------------------------------------------------------------------------------------------------------
def findings(spark, sf, **how):
    return rules.validate(documents(spark, sf), **how)


@query("validation_findings", f"WITH {_DOCS}, {_FINDINGS} SELECT path, type, code, severity, line FROM f")
def validation_findings(spark, sf):
    return findings(spark, sf).select("path", "type", "code", "severity", "line")


@query("validation_with_tickets", f"WITH {_DOCS}, {_FINDINGS} {_TICKETS} SELECT path, code, severity FROM ft")
def validation_with_tickets(spark, sf):
    return findings(spark, sf, provider="jira").select("path", "code", "severity")


@query("validation_with_policy", f"WITH {_DOCS}, {_FINDINGS} SELECT path, code, CASE WHEN code = 'missing-risks' THEN 'error' WHEN type = 'decision' THEN 'warning' ELSE severity END AS severity FROM f WHERE code <> 'requirement-non-ears'")
def validation_with_policy(spark, sf):
    return findings(spark, sf, overrides={"requirement-non-ears": "off", "missing-risks": "error"}, type_ceilings={"decision": "warning"}).select("path", "code", "severity")


@query("document_states", f"WITH {_DOCS}, {_FINDINGS}, {_STATES} SELECT path, type, state FROM st")
def document_states(spark, sf):
    return rules.validity(documents(spark, sf), findings(spark, sf))


@query("types_of_documents", f"WITH {_DOCS}, {_FINDINGS}, {_STATES} SELECT type, count(*) AS total, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'invalid') AS invalid FROM st GROUP BY 1")
def types_of_documents(spark, sf):
    return reports.by_type(document_states(spark, sf))


@query("totals_of_documents", f"WITH {_DOCS}, {_FINDINGS}, {_STATES} SELECT count(*) FILTER (state <> 'skipped') AS checked, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'invalid') AS invalid, count(*) FILTER (state = 'skipped') AS skipped FROM st")
def totals_of_documents(spark, sf):
    return reports.totals(document_states(spark, sf))


@query("severity_totals", f"WITH {_DOCS}, {_FINDINGS} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, false AS ok FROM f")
def severity_totals(spark, sf):
    return reports.severity_totals(findings(spark, sf))


@query("gate_of_documents", f"WITH {_DOCS}, {_FINDINGS} SELECT path, code, severity, CASE WHEN code = 'missing-risks' THEN 'blocking' WHEN code = 'missing-title' THEN 'advisory' WHEN severity = 'error' THEN 'blocking' ELSE 'advisory' END AS verdict FROM f WHERE code <> 'ambiguous-verb'")
def gate_of_documents(spark, sf):
    found = rules.as_findings(findings(spark, sf))
    return reports.gate(found, off=["ambiguous-verb"], blocking=["missing-risks"], advisory=["missing-title"]).select("path", "code", "severity", "verdict")


@query("bundle_names", f"WITH {_DOCS} SELECT path, type, 'okf-unmapped-type' AS code FROM m WHERE type = 'unknown'")
def bundle_names(spark, sf):
    return rules.bundle_names(documents(spark, sf))


# --- reports ----------------------------------------------------------------------------------------------------------
_SLOTS = "CASE type WHEN 'requirement' THEN CASE WHEN k % 7 = 0 THEN 1 ELSE 2 END WHEN 'decision' THEN 2 ELSE 0 END AS filled, CASE type WHEN 'design' THEN 5 WHEN 'unknown' THEN 0 ELSE 3 END AS slots"
_COMPLETE = f"c AS (SELECT sum(filled)::BIGINT AS filled, sum(slots)::BIGINT AS slots, round_even(sum(filled) / sum(slots), 4) AS completeness FROM (SELECT {_SLOTS} FROM m))"


@query("completeness", f"WITH {_DOCS}, {_COMPLETE} SELECT * FROM c")
def completeness(spark, sf):
    one = reports.completeness(documents(spark, sf))
    return one.select(F.col("filled").cast("long").alias("filled"), F.col("slots").cast("long").alias("slots"), "completeness")


@query("portfolio_health", f"""WITH {_DOCS}, {_FINDINGS}, {_STATES}, {_REFERENCES}, {_COMPLETE}, t AS (SELECT count(*) FILTER (state <> 'skipped') AS checked, count(*) FILTER (state = 'valid') AS valid FROM st),
  r AS (SELECT count(*) AS edges, count(*) FILTER (issue IS NULL) AS edges_valid FROM e)
  SELECT checked, valid, completeness, edges, edges_valid, round_even(100 * (0.5 * round_even(valid / checked, 4) + 0.25 * completeness + 0.25 * round_even(edges_valid / edges, 4)), 0)::INT AS health FROM t, c, r""")
def portfolio_health(spark, sf):
    one = reports.portfolio(documents(spark, sf), edges(spark, sf), document_states(spark, sf))
    return one.select("checked", "valid", "completeness", "edges", "edges_valid", "health")


_ATTENTION = """att AS (SELECT 'error' AS severity, path, 'invalid-artifact' AS code FROM st WHERE state = 'invalid' UNION ALL SELECT DISTINCT 'error', source_path, 'broken-relationship' FROM e WHERE issue IS NOT NULL
  UNION ALL SELECT 'warning', path, 'missing-recommended' FROM m WHERE type <> 'unknown')"""


@query("attention", f"WITH {_DOCS}, {_FINDINGS}, {_STATES}, {_REFERENCES}, {_ATTENTION} SELECT * FROM att")
def attention(spark, sf):
    return reports.attention(documents(spark, sf), edges(spark, sf), document_states(spark, sf))


def _commits(spark, sf):
    epoch = F.lit(1_600_000_000).cast("long") + F.col("doc_id") * 5003 % 1009 * 86_400
    return table(spark, sf, "documents").select(F.concat("source", F.lit("/DOC-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), epoch.alias("epoch"))


@query("review", f"""WITH {_DOCS}, {_FINDINGS}, {_STATES}, {_REFERENCES}, {_ATTENTION}, t AS (SELECT path, type, 1600000000 + k * 5003 % 1009 * 86400 AS epoch FROM m),
  rows AS (SELECT path, code FROM att UNION ALL SELECT path, 'unclassified' FROM m WHERE type = 'unknown'
    UNION ALL SELECT DISTINCT source_path, 'suspect-drift' FROM e JOIN t a ON a.path = source_path JOIN t b ON b.path = resolved_path WHERE issue IS NULL AND b.epoch > a.epoch
    UNION ALL SELECT '', 'stale-corpus' FROM t WHERE type <> 'unknown' HAVING floor((1800000000 - max(epoch)) / 86400) > 180)
  SELECT CASE code WHEN 'invalid-artifact' THEN 1 WHEN 'broken-relationship' THEN 2 WHEN 'suspect-drift' THEN 3 WHEN 'unclassified' THEN 4 WHEN 'missing-recommended' THEN 5 ELSE 6 END AS priority, path, code FROM rows""")
def review(spark, sf):
    return reports.review(documents(spark, sf), edges(spark, sf), document_states(spark, sf), _commits(spark, sf), 1_800_000_000)


@query("document_statistics", f"""WITH {_DOCS}, {_FINDINGS}, {_STATES}, n AS (SELECT path, type, state, CASE WHEN type <> 'requirement' THEN 0 WHEN k % 24 - k % 6 = 18 THEN 2 ELSE 1 END AS r, type <> 'requirement' AS no_metrics, type <> 'requirement' OR k % 7 = 0 AS no_risks FROM st)
  SELECT type, count(*) AS documents, sum(r)::BIGINT AS requirements, round_even(sum(r) / count(*), 2) AS mean_requirements, count(*) FILTER (no_metrics) AS without_metrics, count(*) FILTER (no_risks) AS without_risks, count(*) FILTER (state = 'invalid') AS invalid FROM n GROUP BY 1""")
def document_statistics(spark, sf):
    return reports.statistics(documents(spark, sf), document_states(spark, sf)).withColumn("invalid", F.size("invalid").cast("long"))


# --- governing documents ----------------------------------------------------------------------------------------------
@query("scope_entries", f"WITH {_DOCS} SELECT path, coalesce(front_id, 'DOC-' || k) AS id, title, status, unnest([0, 1]) AS ord, unnest(['lib/' || source, 'docs/*.md']) AS entry FROM m WHERE status = 'Accepted'")
def scope_entries(spark, sf):
    return retrieve.scope_entries(documents(spark, sf))


@query("decisions_for", f"WITH {_DOCS} SELECT coalesce(front_id, 'DOC-' || k) AS id, title, status, path, 'lib/' || source AS entry FROM m WHERE status = 'Accepted' AND source = 'src1'")
def decisions_for(spark, sf):
    return retrieve.decisions_for(documents(spark, sf), "lib/src1/core/a.py")


# --- comparison -------------------------------------------------------------------------------------------------------
def _newer(spark, sf):
    """The corpus after an edit: every fourth document calls its success metrics otherwise."""
    rows = corpus(spark, sf).withColumn("content", F.when(F.col("path").rlike("[02468]\\.md$"), F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("## Success metrics"), F.lit("## Other")), "UTF-8")).otherwise(F.col("content")))
    return parse.parse(rows)


@query("sections_removed", f"WITH {_DOCS} SELECT path, 'success_measures_removed' AS code FROM m WHERE type = 'requirement'")
def sections_removed(spark, sf):
    return compare.sections_removed(documents(spark, sf), _newer(spark, sf))


@query("unlinked_scope", f"WITH {_DOCS}, {_REFERENCES} SELECT path, 'unlinked_scope' AS code FROM m WHERE type <> 'unknown' AND k % 2 = 0 AND path NOT IN (SELECT source_path FROM refs) AND path NOT IN (SELECT resolved_path FROM e WHERE resolved_path IS NOT NULL)")
def unlinked_scope(spark, sf):
    return compare.unlinked_scope(documents(spark, sf).where("has_front").select("path", "type"), edges(spark, sf))


# --- exports, renaming ------------------------------------------------------------------------------------------------
@query("export_rows", f"WITH {_DOCS} SELECT coalesce(front_id, 'DOC-' || k) AS id, type, coalesce(status, 'unknown') AS status, title, path, CASE WHEN k % 2 = 0 THEN [lang, source] ELSE [] END AS tags FROM m")
def export_rows(spark, sf):
    return exports.document_rows(documents(spark, sf)).select("id", "type", "status", "title", "path", "tags")


@query("export_links", f"WITH {_DOCS}, {_REFERENCES} SELECT DISTINCT coalesce(a.front_id, 'DOC-' || a.k) AS source, relationship AS type, coalesce(b.front_id, 'DOC-' || b.k) AS target FROM e JOIN m a ON a.path = source_path JOIN m b ON b.path = resolved_path")
def export_links(spark, sf):
    return exports.graph_rows(documents(spark, sf), edges(spark, sf))[1]


@query("rename_edits", f"WITH {_DOCS}, {_REFERENCES} SELECT source_path AS path, target AS before, 'NEW-1-A' AS after FROM refs WHERE lower(target) = 'doc-7'")
def rename_edits(spark, sf):
    lines = artifacts.references(documents(spark, sf)).select(F.col("source_path").alias("path"), F.lit(0).alias("line"), F.col("target").alias("text"), F.lit("reference").alias("kind"))
    return rename.edits(lines, "DOC-7", "NEW-1-A").select("path", "before", "after")
