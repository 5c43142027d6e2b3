"""The type registry as data: sections, vocabularies, relationships and their rules."""

from __future__ import annotations

from typing import NamedTuple


class ArtifactType(NamedTuple):
    name: str
    required: list[str]
    recommended: list[str]
    statuses: list[str]
    retired: list[str]
    synonyms: dict[str, str]
    relationships: list[str]


class EdgeKind(NamedTuple):
    section: str
    range: list[str]
    acyclic: bool = False
    forbids_retired: bool = False
    external: bool = False
    scoped: bool = False
    directional: bool = False
    provider: bool = False


# The order of types breaks ties of classification.
_COMMON = ["Proposed", "Accepted", "Superseded", "Deprecated"]
_RELATED = ["related requirements", "related decisions", "related roadmaps", "related prompts", "related designs"]
TYPES = [
    ArtifactType("requirement", ["problem", "requirements"], ["success metrics", "risks", "assumptions"], _COMMON, ["Superseded", "Deprecated"],
                 {"success criteria": "success metrics", "kpis": "success metrics", "kpi": "success metrics"}, [*_RELATED, "related tickets", "verified by"]),
    ArtifactType("decision", ["context", "decision", "consequences"], ["status", "category", "alternatives considered"], _COMMON, ["Superseded", "Deprecated"],
                 {"alternatives": "alternatives considered", "options considered": "alternatives considered"},
                 [*_RELATED, "supersedes", "related tickets", "applies to"]),
    ArtifactType("roadmap", ["outcomes", "initiatives"], ["success measures", "assumptions", "risks"], ["Planned", "Achieved", "Superseded", "Abandoned"],
                 ["Superseded", "Abandoned"], {"success metrics": "success measures"}, [*_RELATED, "related tickets"]),
    ArtifactType("prompt", ["objective", "input", "instructions", "output"], ["constraints", "examples", "evaluation"], ["Active", "Deprecated"], ["Deprecated"],
                 {"expected output": "output", "output specification": "output", "input specification": "input"}, [*_RELATED, "related tickets"]),
    ArtifactType("design", ["context", "user need", "design", "constraints"], ["rationale", "alternatives", "accessibility", "style guidance", "open questions"],
                 _COMMON, ["Superseded", "Deprecated"], {}, [*_RELATED, "related tickets"]),
]
CATEGORIES = ["Architecture", "Product", "Process", "Technical", "Other"]
EDGES = [
    EdgeKind("related requirements", ["requirement"], forbids_retired=True),
    EdgeKind("related decisions", ["decision"], forbids_retired=True),
    EdgeKind("related roadmaps", ["roadmap"], forbids_retired=True),
    EdgeKind("related prompts", ["prompt"], forbids_retired=True),
    EdgeKind("related designs", ["design"], forbids_retired=True),
    EdgeKind("supersedes", ["decision"], acyclic=True, directional=True),
    EdgeKind("related tickets", [], external=True, provider=True),
    EdgeKind("verified by", [], external=True),
    EdgeKind("applies to", [], external=True, scoped=True),
]
TICKETS = {
    "jira": r"^[A-Z][A-Z0-9]+-\d+$",
    "github": r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#\d+$",
    "linear": r"^[A-Z][A-Z0-9]*-\d+$",
    "azure-devops": r"^(?:AB#)?\d+$",
    "servicenow": r"^[A-Z]{2,}\d{5,}$",
}
URL = r"^https?://\S+$"
NAMES = [t.name for t in TYPES]
BY_NAME = {t.name: t for t in TYPES}
