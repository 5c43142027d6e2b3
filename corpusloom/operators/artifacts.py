"""Typed documents: classification by sections, identity, status and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.registry import BY_NAME, EDGES, NAMES, TYPES
from corpusloom.functions.text import STEM_ID, casefold, first_line, path_stem, round_half_even, strip_marker
from corpusloom.operators.parse import section


def _mapped(names: Column, synonyms: dict[str, str]) -> Column:
    for old, new in synonyms.items():
        names = _replaced(names, old, new)
    return F.array_distinct(names)


def _replaced(names: Column, old: str, new: str) -> Column:
    return F.transform(names, lambda x: F.when(x == old, F.lit(new)).otherwise(x))


def classify(documents: DataFrame, names: Column | None = None) -> DataFrame:
    """Adds ``type``, ``confidence``, ``present`` and ``missing`` sections to documents with section names.

    The type whose sections fit best, half a point for a recommended one; a fit under one half or without
    a required section is ``unknown``. Of equal fits more required sections win, then the registry's order.
    """
    names = F.transform("sections", lambda s: s["name"]) if names is None else names
    fits = []
    for order, t in enumerate(TYPES):
        mapped = _mapped(names, t.synonyms)
        array = lambda xs: F.array(*map(F.lit, xs))
        required, recommended = F.array_intersect(array(t.required), mapped), F.array_intersect(array(t.recommended), mapped)
        fit = (F.size(required) + 0.5 * F.size(recommended)) / (len(t.required) + 0.5 * len(t.recommended))
        fits.append(F.struct(
            fit.alias("fit"), F.size(required).alias("n"), F.lit(-order).alias("order"), F.lit(t.name).alias("name"),
            F.concat(required, recommended).alias("present"), F.array_except(array(t.required + t.recommended), mapped).alias("missing"),
        ))
    best = documents.withColumn("_best", F.array_max(F.array(*fits)))
    known = (F.col("_best.fit") >= 0.5) & (F.col("_best.n") > 0)
    return best.select(
        *documents.columns,
        F.when(known, F.col("_best.name")).otherwise("unknown").alias("type"),
        round_half_even(F.col("_best.fit"), 2).alias("confidence"),
        F.when(known, F.col("_best.present")).otherwise(names).alias("present"),
        F.when(known, F.col("_best.missing")).otherwise(F.array().cast("array<string>")).alias("missing"),
    )


def identify(documents: DataFrame) -> DataFrame:
    """Adds ``canonical_id`` and ``aliases``: front matter id, ID section, numbered file stem, stem; aliases differ by case folding."""
    stem = path_stem(F.col("path"))
    number = F.nullif(F.regexp_extract(stem, STEM_ID, 1), F.lit(""))
    listed = F.array_compact(F.array("front_id", first_line(section("id")), number, stem))
    folded = documents.withColumn("_ids", listed).withColumn("_folds", F.split(casefold(F.array_join("_ids", "\x00")), "\x00"))
    keep = F.filter("_ids", lambda x, i: F.array_position("_folds", F.element_at("_folds", i + 1)) == i + 1)
    return folded.withColumn("canonical_id", F.get("_ids", F.lit(0))).withColumn("aliases", keep).drop("_ids", "_folds")


def status_of(documents: DataFrame) -> DataFrame:
    """Adds ``status`` (spelled as in the type's vocabulary where it is in it), ``category``, ``retired`` and ``live_decision``."""
    raw = first_line(section("status"))
    folded = documents.withColumn("_s", casefold(raw)).withColumn("_raw", raw)
    status, retired = F.col("_raw"), F.lit(False)
    for t in TYPES:
        words = F.create_map(*(F.lit(x) for s in t.statuses for x in (s.casefold(), s)))
        status = F.when(F.col("type") == t.name, F.coalesce(words[F.col("_s")], F.col("_raw"))).otherwise(status)
        retired = retired | ((F.col("type") == t.name) & F.col("_s").isin(*(s.casefold() for s in t.retired)))
    live = (F.col("type") == "decision") & (F.col("_s") == "accepted") & ~retired
    return folded.withColumns({
        "status": status, "category": first_line(section("category")), "retired": F.coalesce(retired, F.lit(False)),
        "live_decision": F.coalesce(live, F.lit(False)),
    }).drop("_s", "_raw")


def references(documents: DataFrame) -> DataFrame:
    """``(source_path, type, relationship, rel_ord, ref_ord, target)``: a row for each reference line that the document's type allows."""
    lines = _relationship_lines(documents)
    allowed = F.lit(False)
    for t in TYPES:
        allowed = allowed | ((F.col("type") == t.name) & F.col("relationship").isin(*t.relationships))
    return lines.where(allowed)


def _relationship_lines(documents: DataFrame) -> DataFrame:
    order = F.create_map(*(F.lit(x) for k, e in enumerate(EDGES) for x in (e.section, k)))
    found = documents.select("path", "type", F.explode("sections").alias("s")).where(F.col("s.name").isin(*(e.section for e in EDGES)))
    exploded = found.select(
        F.col("path").alias("source_path"), "type", F.col("s.name").alias("relationship"),
        order[F.col("s.name")].alias("rel_ord"), F.posexplode(F.split("s.body", "\n")).alias("ref_ord", "raw"),
    )
    return exploded.withColumn("target", strip_marker(F.col("raw"))).where(F.col("target") != "").drop("raw")


def unsupported_sections(documents: DataFrame) -> DataFrame:
    """``(source_path, relationship)`` of relationship sections that a known type does not declare."""
    found = documents.where(F.col("type").isin(*NAMES)).select(
        F.col("path").alias("source_path"), "type", F.explode(F.transform("sections", lambda s: s["name"])).alias("relationship")
    ).where(F.col("relationship").isin(*(e.section for e in EDGES)))
    allowed = F.lit(False)
    for t in TYPES:
        allowed = allowed | ((F.col("type") == t.name) & F.col("relationship").isin(*t.relationships))
    return found.where(~allowed).select("source_path", "relationship")


def artifacts(parsed: DataFrame) -> DataFrame:
    """Parsed documents with type, identity and status: the table that every report reads."""
    return status_of(identify(classify(parsed)))


def index_entries(documents: DataFrame, inbound: DataFrame | None = None) -> DataFrame:
    """The search index: ``(path, id, type, title, tags, aliases, sections, inbound, retired, live_decision, status)``."""
    base = documents.select(
        "path", F.col("canonical_id").alias("id"), "type", "title", "tags", "aliases", F.col("search_sections").alias("sections"),
        "retired", "live_decision", "status",
    )
    if inbound is None:
        return base.withColumn("inbound", F.lit(0).cast("long"))
    counts = inbound.select(F.col("resolved_path").alias("path"), F.col("n").alias("inbound"))
    return base.join(counts, "path", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0).cast("long")))


def improvement(documents: DataFrame) -> DataFrame:
    """``(path, section, required)``: a row for each section that a known document lacks."""
    missing = documents.where("type <> 'unknown'").select("path", "type", F.explode("missing").alias("section"))
    per_type = F.lit(False)
    for t in TYPES:
        per_type = per_type | ((F.col("type") == t.name) & F.col("section").isin(*t.required))
    return missing.select("path", "type", "section", per_type.alias("required"))


def inspect(documents: DataFrame) -> DataFrame:
    return documents.select("path", "type", "confidence", "present", "missing", "status", "category", "tags")


def type_schema(name: str) -> dict:
    """A type's registry entry as a plain mapping."""
    return BY_NAME[name]._asdict()
