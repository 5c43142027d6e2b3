"""Renaming an identifier: the edits to the lines that name it, and why it may not be done."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import casefold, strip_marker
from corpusloom.operators.graph import alias_table


def refusal(documents: DataFrame, old: str, new: str) -> str | None:
    """not-found, ambiguous, collides, invalid or filename-only; None where the renaming may be done."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+", new.strip()):
        return "invalid"
    aliases = alias_table(documents)
    owners = [r.path for r in aliases.where(F.col("key") == old.strip().casefold()).select("path").distinct().limit(2).collect()]
    if not owners:
        return "not-found"
    if len(owners) > 1:
        return "ambiguous"
    if not aliases.where((F.col("key") == new.strip().casefold()) & (F.col("path") != owners[0])).isEmpty():
        return "collides"
    body = F.coalesce(F.get(F.filter("sections", lambda s: s["name"] == "id"), F.lit(0))["body"], F.lit(""))
    stated = documents.where(F.col("path") == owners[0]).select((F.lower("front_id").eqNullSafe(old.strip().lower()) | (F.lower(body) == old.strip().lower())).alias("s")).first().s
    return None if stated else "filename-only"


def edits(lines: DataFrame, old: str, new: str) -> DataFrame:
    """``(path, line, before, after)`` of ``lines(path, line, text, kind)``: reference and identity lines that hold just the old id."""
    text = strip_marker(F.col("text"))
    value = F.regexp_replace(text, r"^id:\s*", "")
    same = casefold(F.when(F.col("kind") == "identity", value).otherwise(text)) == old.strip().casefold()
    after = F.regexp_replace("text", rf"(?i){re.escape(old.strip())}", new.strip())
    return lines.where(F.col("kind").isin("reference", "identity") & same).select("path", "line", F.col("text").alias("before"), after.alias("after"))
