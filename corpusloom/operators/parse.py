"""Markdown documents to nested rows: front matter, sections, requirements, findings of reading.

One Arrow function parses a document once; whatever follows works on its columns.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Fixed limits and names.
MAX_BYTES, MAX_FRONT_BYTES, MAX_DEPTH = 1 << 20, 64 << 10, 32
MAX_SECTION_CHARS, MAX_LINES = 262_144, 50_000
FIELDS = ["schema_version", "id", "type", "relationships", "tags"]
CAPTURED = {"problem": "problem", "requirements": "requirements", "success metrics": "success_metrics", "risks": "risks"}

ISSUE = "struct<severity:string,code:string,message:string,line:bigint>"
PARSED = (
    "title string, extra_title_lines array<bigint>, sections array<struct<name:string,body:string>>, "
    "search_sections array<struct<heading:string,lines:array<string>>>, "
    "requirements array<struct<id:string,text:string,line:bigint>>, "
    "malformed array<struct<raw:string,line:bigint,bad_id:string,empty_text:boolean>>, "
    "problem array<string>, success_metrics array<string>, risks array<string>, "
    "front_id string, front_type string, tags array<string>, has_front boolean, "
    f"issues array<{ISSUE}>"
)

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])(?:[ \t]+|$)(.*)$")
_QUOTE = re.compile(r" {0,3}> ?(.*)$")
_HTML = re.compile(r" {0,3}<(?:!--|[?!/]?[A-Za-z])")
_REFERENCE = re.compile(r" {0,3}\[[^\]]+\]:[ \t]*\S+")
_BRACKET = re.compile(r"\[([^\]]*)\]\s*(.*)$", re.S)
_REQUIREMENT = re.compile(r"REQ-\d+")


class Block(NamedTuple):
    kind: str  # h1..h6 or text
    text: str
    line: int  # from 1
    depth: int = 0


def split_front_matter(text: str) -> tuple[str | None, str, int, bool]:
    """(front matter or None, body, lines before the body, whether it never ends)."""
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return None, text, 0, False
    for k, line in enumerate(lines[1:], 1):
        if line.rstrip() in ("---", "..."):
            return "\n".join(lines[1:k]), "\n".join(lines[k + 1 :]), k + 1, False
    return None, text, 0, True


def blocks(lines: list[str], first: int = 1, depth: int = 0) -> list[Block]:
    """Headings and text blocks; code, HTML and reference definitions hold no text. Quotes and lists are entered."""
    out: list[Block] = []
    held: list[str] = []
    start = i = 0

    def flush() -> None:
        if held:
            out.append(Block("text", "\n".join(x.strip() for x in held), first + start, depth))
            held.clear()

    while i < len(lines):
        line = lines[i].expandtabs(4)
        if not line.strip():
            flush()
        elif held and _SETEXT.match(line):
            heading = "\n".join(x.strip() for x in held)
            out.append(Block("h1" if line.strip()[0] == "=" else "h2", heading, first + start, depth))
            held.clear()
        elif not held and line.startswith("    "):
            pass  # indented code
        elif m := _FENCE.match(line):
            flush()
            mark = m[1]
            while i + 1 < len(lines) and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i + 1]):
                i += 1
            i += 1
        elif _RULE.match(line):
            flush()
        elif m := _ATX.match(line):
            flush()
            out.append(Block(f"h{len(m[1])}", (m[2] or "").strip(), first + i, depth))
        elif depth < MAX_DEPTH and (m := _QUOTE.match(line)):
            flush()
            inner, at = [], i
            while i < len(lines) and (q := _QUOTE.match(lines[i])):
                inner.append(q[1])
                i += 1
            while i < len(lines) and lines[i].strip() and not _starts_block(lines[i]):
                inner.append(lines[i])
                i += 1
            out += blocks(inner, first + at, depth + 1)
            continue
        elif depth < MAX_DEPTH and (m := _ITEM.match(line)) and not (held and (not m[3].strip() or m[2][:-1] not in ("", "1"))):
            flush()
            width = len(line) - len(m[3]) if m[3] else len(m[1]) + len(m[2]) + 1
            inner, at = [m[3]], i
            i += 1
            while i < len(lines):
                more = lines[i].expandtabs(4)
                if not more.strip():
                    after = next((x for x in lines[i + 1 :] if x.strip()), None)
                    if after is None or not after.expandtabs(4).startswith(" " * width):
                        break
                    inner.append("")
                elif more.startswith(" " * width):
                    inner.append(more[width:])
                elif inner[-1].strip() and not _starts_block(more):
                    inner.append(more.strip())
                else:
                    break
                i += 1
            out += blocks(inner, first + at, depth + 1)
            continue
        elif not held and _HTML.match(line):
            while i + 1 < len(lines) and lines[i + 1].strip():
                i += 1
        elif not held and _REFERENCE.match(line):
            pass
        else:
            if not held:
                start = i
            held.append(line)
        i += 1
    flush()
    return out


def _starts_block(line: str) -> bool:
    return any(p.match(line) for p in (_ATX, _FENCE, _RULE, _QUOTE, _ITEM, _HTML))


def _issue(severity: str, code: str, message: str, line: int | None = None) -> dict:
    return {"severity": severity, "code": code, "message": message, "line": line}


def read_front_matter(source: str, issues: list[dict]) -> dict:
    """Metadata of front matter text; findings are appended to ``issues``."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        for k in keys:
            if keys.count(k) > 1:
                raise ValueError(f"duplicate key {k}")
        return dict(zip(keys, (loader.construct_object(v, deep=True) for _, v in node.value)))

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    if len(source.encode()) > MAX_FRONT_BYTES:
        issues.append(_issue("error", "malformed-frontmatter", "front matter is too large"))
        return {}
    try:
        if any(isinstance(t, yaml.AliasToken) for t in yaml.scan(source)):
            raise yaml.YAMLError("aliases are not allowed")
        depth = most = 0
        for event in yaml.parse(source):
            depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
            most = max(most, depth)
        if most > MAX_DEPTH:
            raise yaml.YAMLError("nested too deeply")
        data = yaml.load(source, Loader)  # noqa: S506 (a safe loader)
    except ValueError as e:
        issues.append(_issue("error", "duplicate-frontmatter-key" if "duplicate key" in str(e) else "malformed-frontmatter", str(e)))
        return {}
    except (yaml.YAMLError, RecursionError, TypeError) as e:
        issues.append(_issue("error", "malformed-frontmatter", str(e).split("\n")[0]))
        return {}
    if not isinstance(data, dict):
        issues.append(_issue("error", "malformed-frontmatter", "front matter is not a mapping"))
        return {}
    return _metadata(data, issues)


def _metadata(data: dict, issues: list[dict]) -> dict:
    from corpusloom.functions.registry import EDGES, NAMES
    from corpusloom.functions.text import ID_GRAMMAR

    bad = lambda message, code="invalid-metadata-field": issues.append(_issue("error", code, message))
    for key in data:
        if key not in FIELDS:
            bad(f"unsupported field {key!r}")
    version = data.get("schema_version")
    if "schema_version" not in data or not isinstance(version, int) or isinstance(version, bool):
        bad("schema_version must be an integer")
    elif version != 1:
        bad(f"unsupported schema_version {version}", "unsupported-schema-version")
    out: dict = {"id": None, "type": None, "tags": []}
    if (value := data.get("id")) is not None:
        if not isinstance(value, str):
            bad("id must be a string")
        elif not re.fullmatch(ID_GRAMMAR[1:-1], value.strip().upper()):
            bad(f"invalid id {value!r}", "invalid-id-syntax")
        else:
            out["id"] = value.strip().upper()
    if (value := data.get("type")) is not None:
        if value in NAMES:
            out["type"] = value
        else:
            bad(f"unknown type {value!r}")
    if (value := data.get("relationships")) is not None:
        known = {e.section.replace(" ", "_") for e in EDGES}
        if not isinstance(value, dict) or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in value.values()):
            bad("relationships must map names to lists of strings")
        elif unknown := [k for k in value if k not in known]:
            bad(f"unknown relationships {unknown}")
    if (value := data.get("tags")) is not None:
        if isinstance(value, list) and all(isinstance(x, str) and x.strip() for x in value):
            out["tags"] = [x.strip() for x in value]
        else:
            bad("tags must be a list of strings")
    return out


def requirement_of(text: str, line: int) -> tuple[str, dict]:
    """('ok', requirement) or ('bad', malformed requirement) of a requirement line."""
    m = _BRACKET.match(text)
    if not m:
        return "bad", {"raw": text, "line": line, "bad_id": None, "empty_text": False}
    name, rest = m[1].strip(), m[2].strip()
    if not _REQUIREMENT.fullmatch(name):
        return "bad", {"raw": text, "line": line, "bad_id": name, "empty_text": False}
    if not rest:
        return "bad", {"raw": text, "line": line, "bad_id": name, "empty_text": True}
    return "ok", {"id": name, "text": rest, "line": line}


def parse_document(data: bytes | None) -> dict:
    """One document to the columns of ``PARSED``; it never raises. Null bytes are an unreadable document."""
    issues: list[dict] = []
    out = {k: [] for k in ("extra_title_lines", "requirements", "malformed", "problem", "success_metrics", "risks", "tags")}
    out |= {"title": None, "front_id": None, "front_type": None, "has_front": False, "sections": [], "search_sections": [], "issues": issues}
    if data is None:
        issues.append(_issue("error", "unreadable-artifact", "the file cannot be read"))
        return out
    if len(data) > MAX_BYTES:
        issues.append(_issue("error", "artifact-oversize", f"the file has more than {MAX_BYTES} bytes"))
        return out
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("utf-8", "replace")
        issues.append(_issue("warning", "non-utf8-content", "the file is not UTF-8"))
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    front, body, offset, endless = split_front_matter(text)
    if endless:
        issues.append(_issue("error", "malformed-frontmatter", "front matter does not end", 1))
    if front is not None:
        meta = read_front_matter(front, issues)
        out |= {"has_front": True, "front_id": meta.get("id"), "front_type": meta.get("type"), "tags": meta.get("tags", [])}
    bodies: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    current = search = captured = None
    total, cut, full = 0, False, set()
    for b in blocks(body.split("\n"), offset + 1):
        if b.kind == "h1":
            if out["title"] is None:
                out["title"] = b.text.strip()
            else:
                out["extra_title_lines"].append(b.line)
            current = search = captured = None
        elif b.kind == "h2":
            current = b.text.strip().casefold()
            bodies.setdefault(current, [])
            search = {"heading": b.text.strip(), "lines": []}
            out["search_sections"].append(search)
            captured = CAPTURED.get(current)
        elif b.kind != "text":
            captured = None
        elif current is not None and not cut:
            for k, raw in enumerate(b.text.split("\n")):
                line = raw.strip()
                if not line:
                    continue
                if total >= MAX_LINES:
                    cut = True
                    break
                if used.get(current, 0) + len(line) > MAX_SECTION_CHARS:
                    full.add(current)
                    continue
                bodies[current].append(line)
                used[current] = used.get(current, 0) + len(line) + 1
                search["lines"].append(line)
                total += 1
                if captured == "requirements":
                    kind, row = requirement_of(line, b.line + k)
                    out["requirements" if kind == "ok" else "malformed"].append(row)
                elif captured:
                    out[captured].append(line)
    issues += [_issue("warning", "field-truncated", f"section {name!r} is cut") for name in sorted(full)]
    if cut:
        issues.append(_issue("warning", "body-truncated", f"only {MAX_LINES} lines are kept"))
    out["sections"] = [{"name": k, "body": "\n".join(v)} for k, v in bodies.items()]
    return out


def _parse(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_document(None if c is None else bytes(c)) for c in content], columns=[p.split(" ")[0] for p in PARSED.split(", ")])


def parse(corpus: DataFrame) -> DataFrame:
    """``corpus(path, content)`` to ``(path, content_hash, <PARSED>)``; one row for each document."""
    kind = f"struct<{', '.join(p.replace(' ', ':', 1) for p in PARSED.split(', '))}>"
    parsed = corpus.select("path", F.sha2("content", 256).alias("content_hash"), pandas_udf(_parse, kind)("content").alias("p"))
    return parsed.select("path", "content_hash", "p.*")


def section(name: str):
    """The body of a section of a parsed row; null if it has none."""
    return F.get(F.filter("sections", lambda s: s["name"] == name), F.lit(0))["body"]


def to_xhtml(text: str) -> str:
    """A document's body as XHTML: headings and paragraphs, everything escaped."""
    from html import escape

    _, body, _, _ = split_front_matter(text)
    tags = {f"h{k}": f"h{k}" for k in range(1, 7)} | {"text": "p"}
    return "\n".join(f"<{tags[b.kind]}>{escape(b.text)}</{tags[b.kind]}>" for b in blocks(body.split("\n")))
