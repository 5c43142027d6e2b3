"""Scalar functions over text: search tokens, identity keys, rounding, paths, patterns.

Built-in expressions wherever they give the right result; Arrow functions only for what the
JVM does differently (full case folding, half-even rounding of the exact double, title case).
"""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Fixed: reference list markers, ids and file stems.
LIST_MARKER = r"^(?:[-*+]|\d+[.)])\s+"
STEM_ID = r"^([A-Za-z]+-\d+)"
ID_GRAMMAR = r"^[A-Z][A-Z0-9]{1,9}-[0123456789ABCDEFGHJKMNPQRSTVWXYZ]{12}$"
TOKEN = r"[0-9A-Za-z]+(?:-[0-9A-Za-z]+)*"


def search_tokens(text: Column) -> Column:
    """Lower-case ASCII tokens: split at everything but 0-9A-Za-z and where a lower letter meets an upper one. Null gives []."""
    seams = F.regexp_replace(F.coalesce(text, F.lit("")), r"([a-z])([A-Z])", "$1 $2")
    return F.array_remove(F.split(F.lower(F.regexp_replace(seams, r"[^0-9A-Za-z]+", " ")), " "), "")


def query_terms(query: str) -> list[str]:
    """The tokens of a query, in order, repeats kept."""
    seams = re.sub(r"([a-z])([A-Z])", r"\1 \2", query)
    return [t.lower() for t in re.split(r"[^0-9A-Za-z]+", seams) if t]


def term_hits(tokens: Column, term: str) -> Column:
    """Whether any token starts with the term."""
    return F.exists(tokens, lambda t: t.startswith(term))


def term_frequency(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t.startswith(term)))


@pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@pandas_udf(T.DoubleType())
def _round(s: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else round(x, int(k)) for x, k in zip(s, n)], dtype="float64")


@pandas_udf(T.StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Every run of letters capitalised, as ``3D`` from ``3d`` and ``O'Neil`` from ``o'neil``."""
    return s.map(lambda x: None if x is None else x.title())


def casefold(text: Column) -> Column:
    """Full Unicode case folding, so that ß and SS are equal."""
    return _casefold(text)


def round_half_even(value: Column, digits: int) -> Column:
    """The exact double rounded half to even, unlike the decimal rounding of ``round`` and ``bround``."""
    return _round(value.cast("double"), F.lit(digits))


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_marker(line: Column) -> Column:
    """A line without its list marker."""
    return F.regexp_replace(strip(line), LIST_MARKER, "")


def first_line(text: Column) -> Column:
    """The first line that is not blank, stripped; null if there is none."""
    lines = F.transform(F.split(universal_newlines(F.coalesce(text, F.lit(""))), "\n"), strip)
    return F.get(F.filter(lines, lambda x: x != ""), F.lit(0))


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]+$", "")


def path_order(path: Column) -> Column:
    """Sorts paths by their components."""
    return F.split(path, "/")


def normal_path(path: str, root: str | None = None) -> str | None:
    """A scope path without ``.`` parts, relative to ``root``; None where it leaves the root."""
    path = path.strip()
    if posixpath.isabs(path):
        if root is None:
            return None
        path = posixpath.relpath(path, root)
    parts = [p for p in path.split("/") if p not in ("", ".")]
    return None if ".." in parts else "/".join(parts)


def glob_regex(glob: str) -> str:
    """The regular expression of a path glob: ``*`` and ``?`` within a component, ``**`` across, ``**/`` also none."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def iso_epoch(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO-8601 stamp with offset; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(stamp))


def age_days(reference: Column, committed: Column) -> Column:
    """Whole days between two epochs, floored, so that a future commit has a negative age."""
    return F.floor((reference - committed) / 86400)


def excerpt(content: Column, budget: int, items: int) -> Column:
    """The share of a budget of code points that one of ``items`` contents gets."""
    share = budget // max(items, 1)
    return F.substring(content, 1, share) if share >= 0 else F.expr("''")


def script_safe(json_text: Column) -> Column:
    """JSON that may stand inside an HTML script element."""
    return F.replace(F.replace(F.replace(json_text, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def new_id(prefix: str, millis: int, noise: int) -> str:
    """An identifier of 40 bits of time and 20 random bits in twelve base-32 digits."""
    value = ((millis & ((1 << 40) - 1)) << 20) | (noise & ((1 << 20) - 1))
    return prefix + "-" + "".join(_CROCKFORD[value >> shift & 31] for shift in range(55, -1, -5))


def canonical_json(value) -> str:
    """Compact JSON with sorted keys, for digests."""
    import json

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
