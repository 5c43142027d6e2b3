"""Structural rules: each emits an array of findings for a document; one table of findings comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.registry import CATEGORIES, TICKETS, TYPES, URL
from corpusloom.functions.text import first_line, path_name
from corpusloom.operators.graph import FINDING
from corpusloom.operators.parse import ISSUE, section

# Fixed word lists and patterns of the rules.
VAGUE = ["support", "handle", "allow", "enable"]
NORMATIVE = ["shall", "must", "should"]
AMBIGUOUS = ["easy", "fast", "flexible", "intuitive", "quickly", "robust", "scalable", "seamless", "simple", "user-friendly"]
HEDGES = ["should", "may", "could"]
MANDATORY = ["must", "shall"]
HORIZON = r"^(?i:now|next|later)$|^Q[1-4]\s+\d{4}$"
EARS_IF = r"(?i)^\s*if\b"
INJECTIONS = {
    "instruction-override": r"(?i)\b(?:ignore|disregard|forget|override|bypass)\b[^\n]{0,40}\b(?:previous|prior|above|earlier|preceding|all|the system|your)\b"
                            r"[^\n]{0,20}(?:instruction|instructions|prompt|directive|directives|rule|rules|context)",
    "role-reassignment": r"(?i)\byou are now\b|\bpretend to be\b|\bfrom now on,?\s+you\s+(?:are|will|must|should|shall)\b|\bact as if you\s+(?:are|were)\b",
    "ai-impersonation": r"(?i)\bas an ai(?:\s+language)?\s+model\b",
    "chat-role-injection": r"(?im)^\s*(?:system|assistant|developer|tool)\s*:",
    "conceal-from-user": r"(?i)\b(?:do not|don't|never|without)\b[^\n]{0,30}(?:tell|telling|inform|informing|mention|mentioning|reveal|revealing|notify)\b"
                         r"[^\n]{0,20}\b(?:the user|them|anyone)\b",
    "decision-steering": r"(?i)\b(?:ignore|disregard|override|bypass|violate)\b[^\n]{0,40}\b(?:recorded\s+)?(?:decision|decisions|adr|requirement|policy)\b",
}
MAX_REQUIREMENTS = 50


def any_word(words: list[str]) -> str:
    """A pattern that matches any of the words as a whole."""
    return r"(?iU)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in sorted(words, key=len, reverse=True)) + r")\b"


def words_in(text: Column, words: list[str]) -> Column:
    """The listed words that a text holds, each once, lower-case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(any_word(words)), F.lit(0)), F.lower))


def injections(documents: DataFrame, text: Column) -> DataFrame:
    """``(path, code)`` of the heuristics that a text meets."""
    hits = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(c)) for c, p in INJECTIONS.items())))
    return documents.select("path", F.explode(hits).alias("code"))


def _when(condition: Column, severity: str, code, message, line: Column | None = None) -> Column:
    code, message = (F.lit(x) if isinstance(x, str) else x for x in (code, message))
    row = F.struct(F.lit(severity).alias("severity"), code.alias("code"), message.alias("message"), (F.lit(None) if line is None else line).cast("long").alias("line"))
    return F.when(F.coalesce(condition, F.lit(False)), F.array(row)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def _each(items: Column, severity: str, code: str, message, line=lambda r: r["line"]) -> Column:
    return F.transform(items, lambda r: F.struct(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), message(r).alias("message"), line(r).cast("long").alias("line")))


def _requirement_rules() -> list[Column]:
    reqs, bad = F.col("requirements"), F.col("malformed")
    has = lambda name: F.exists("sections", lambda s: s["name"] == name)
    ids = F.transform(reqs, lambda r: r["id"])
    texts = F.transform(reqs, lambda r: F.lower(r["text"]))
    again = lambda keys: F.filter(reqs, lambda r, i: (F.array_position(keys, F.element_at(keys, i + 1)) == i + 1) & (F.size(F.filter(keys, lambda k: k == F.element_at(keys, i + 1))) > 1))
    return [
        _when(~has("problem"), "error", "missing-problem", "there is no problem section"),
        _when(~has("requirements"), "error", "missing-requirements", "there is no requirements section"),
        _each(F.filter(bad, lambda r: r["bad_id"].isNull()), "error", "req-missing-id", lambda r: r["raw"]),
        _each(F.filter(bad, lambda r: r["bad_id"].isNotNull() & ~r["empty_text"]), "error", "malformed-req-id", lambda r: r["bad_id"]),
        _each(F.filter(bad, lambda r: r["empty_text"]), "error", "empty-req-text", lambda r: r["bad_id"]),
        _each(again(ids), "error", "duplicate-req-id", lambda r: r["id"]),
        _each(again(texts), "warning", "duplicate-req-text", lambda r: r["id"]),
        _when(~has("success metrics"), "warning", "missing-success-metrics", "there is no success metrics section"),
        _when(~has("risks"), "warning", "missing-risks", "there is no risks section"),
        _when(has("problem") & (F.size("problem") == 0), "warning", "empty-problem", "the problem section is empty"),
        _when(F.size(reqs) > MAX_REQUIREMENTS, "warning", "too-many-requirements", F.format_string("%d requirements", F.size(reqs))),
        _each(F.filter(reqs, lambda r: r["text"].rlike(any_word(VAGUE))), "warning", "ambiguous-verb", lambda r: r["id"]),
    ]


def _requirement_standards() -> list[Column]:
    """How a requirement is worded: capital keywords, one of them, and a response to a condition."""
    reqs = F.col("requirements")
    modal = lambda r: F.regexp_extract_all(r["text"], F.lit(any_word(NORMATIVE)), F.lit(0))
    unanswered = lambda r: r["text"].rlike(EARS_IF) & ~r["text"].rlike(any_word(["then"]))
    return [
        _each(F.filter(reqs, lambda r: F.exists(modal(r), lambda k: k != F.upper(k))), "error", "requirement-normative-keyword", lambda r: r["id"]),
        _each(F.filter(reqs, lambda r: F.size(modal(r)) > 1), "warning", "requirement-not-singular", lambda r: r["id"]),
        _each(F.filter(reqs, lambda r: F.size(modal(r)) == 0), "warning", "requirement-non-ears", lambda r: r["id"]),
        _each(F.filter(reqs, lambda r: (F.size(modal(r)) > 0) & unanswered(r)), "warning", "requirement-ears-clause", lambda r: r["id"]),
    ]


def _type_rules(name: str) -> list[Column]:
    spec = next(t for t in TYPES if t.name == name)
    if name == "requirement":
        out = _requirement_rules()
    else:
        out = [_when(~F.exists("sections", lambda s: s["name"] == sec), "error", f"missing-{sec.replace(' ', '-')}", f"there is no {sec} section") for sec in map(str, spec.required)]
    status = F.col("status")
    out.append(_when(status.isNotNull() & ~F.lower(status).isin(*(s.lower() for s in spec.statuses)), "error", f"invalid-{name}-status", status))
    if name == "decision":
        category = F.col("category")
        out.append(_when(category.isNotNull() & ~F.lower(category).isin(*(c.lower() for c in CATEGORIES)), "error", "invalid-decision-category", category))
    if name == "roadmap":
        horizon = first_line(section("horizon"))
        out.append(_when(horizon.isNotNull() & ~horizon.rlike(HORIZON), "error", "invalid-roadmap-horizon", horizon))
        linked = F.exists("sections", lambda s: s["name"].isin("related requirements", "related decisions") & (F.trim(s["body"]) != ""))
        out.append(_when(~linked, "warning", "roadmap-no-advancement-link", "no requirement or decision is linked"))
    if name == "requirement":
        out += _requirement_standards()
    return out


def validate(documents: DataFrame, provider: str | None = None, overrides: dict[str, str] | None = None, type_ceilings: dict[str, str] | None = None) -> DataFrame:
    """``(path, type, code, severity, message, line, seq)``: findings of each document, in order.

    Documents of unknown type are skipped but for what reading them found. ``provider`` checks ticket references;
    ``type_ceilings`` lowers the severity of a type's findings, then ``overrides`` sets or drops (off) a rule's.
    """
    none = F.array().cast(f"array<{ISSUE}>")
    general = [
        F.col("issues"),
        _when(F.col("title").isNull(), "error", "missing-title", "there is no title"),
        F.transform("extra_title_lines", lambda x: F.struct(F.lit("error").alias("severity"), F.lit("multiple-titles").alias("code"), F.lit("a second title").alias("message"), x.alias("line"))),
        _when((F.upper("front_id") != F.upper(first_line(section("id")))), "error", "conflicting-identity", F.col("front_id")),
    ]
    typed = F.array().cast(f"array<{ISSUE}>")
    for t in TYPES:
        rules = _type_rules(t.name)
        if provider is not None:
            lines = F.filter(F.transform(F.split(F.coalesce(section("related tickets"), F.lit("")), "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[-*+]\s+", "")), lambda x: x != "")
            wrong = F.filter(lines, lambda x: ~(x.rlike(TICKETS[provider]) | x.rlike(URL)))
            rules.append(F.transform(wrong, lambda x: F.struct(F.lit("error").alias("severity"), F.lit("malformed-ticket-reference").alias("code"), x.alias("message"), F.lit(None).cast("long").alias("line"))))
        typed = F.when(F.col("type") == t.name, F.concat(*rules)).otherwise(typed)
    found = F.when(F.col("type") == "unknown", F.coalesce(F.col("issues"), none)).otherwise(F.concat(*general, typed))
    rows = documents.select("path", "type", F.posexplode(found).alias("seq", "f")).select("path", "type", "f.code", "f.severity", "f.message", "f.line", "seq")
    return override(rows, overrides or {}, type_ceilings or {})


def override(findings: DataFrame, rules: dict[str, str], ceilings: dict[str, str]) -> DataFrame:
    """A type's ceiling first, then the rule's own severity; ``off`` drops."""
    severity = F.col("severity")
    for name, top in ceilings.items():
        lowered = F.lit("off") if top == "off" else F.when(severity == "error", F.lit(top)).otherwise(severity)
        severity = F.when(F.col("type") == name, lowered).otherwise(severity)
    for code, value in rules.items():
        severity = F.when((F.col("code") == code) & (severity != "off"), F.lit(value)).otherwise(severity)
    return findings.withColumn("severity", severity).where("severity <> 'off'")


def as_findings(validated: DataFrame) -> DataFrame:
    out = validated.withColumn("source", F.lit("validation"))
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("array<string>" if c == "paths" else "string").alias(c) for c in FINDING))


def validity(documents: DataFrame, validated: DataFrame) -> DataFrame:
    """``(path, type, status)``: valid, invalid (an error) or skipped (unknown type)."""
    errors = validated.where("severity = 'error'").select("path").distinct().withColumn("bad", F.lit(True))
    return documents.select("path", "type").join(errors, "path", "left").select(
        "path", "type", F.when(F.col("type") == "unknown", "skipped").when(F.col("bad"), "invalid").otherwise("valid").alias("state"))


def bundle_names(documents: DataFrame) -> DataFrame:
    """Documents that a bundle cannot hold: unknown types, and names that the bundle itself uses."""
    reserved = F.lower(path_name(F.col("path"))).isin("index.md", "log.md")
    code = F.when(F.col("type") == "unknown", "okf-unmapped-type").when(reserved, "okf-reserved-filename-collision")
    return documents.select("path", "type", code.alias("code")).where("code is not null")

