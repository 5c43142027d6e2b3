"""Summaries over the artifacts, edges and findings: portfolio, statistics, review, health, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.registry import BY_NAME, NAMES, TYPES
from corpusloom.functions.text import age_days, path_name, round_half_even
from corpusloom.operators import graph, rules
from corpusloom.operators.graph import FINDING, finding

PRIORITIES = {"invalid-artifact": 1, "broken-relationship": 2, "suspect-drift": 3, "unclassified": 4, "missing-recommended": 5, "stale-corpus": 6}
STALE_DAYS, HUB_DEGREE = 180, 20


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded half to even; 1.0 of nothing."""
    return F.coalesce(round_half_even(F.try_divide(part, whole), digits), F.lit(1.0))


def by_type(states: DataFrame) -> DataFrame:
    """``(type, total, valid, invalid)`` for every known type, zero where there is none. ``states(path, type, state)``."""
    slots = states.sparkSession.createDataFrame([(k, n) for k, n in enumerate([*NAMES, "unknown"])], "ord int, type string")
    counts = states.groupBy("type").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "valid").alias("valid"), F.count_if(F.col("state") == "invalid").alias("invalid"))
    return slots.join(counts, "type", "left").na.fill(0, ["total", "valid", "invalid"]).orderBy("ord").drop("ord")


def totals(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count_if(F.col("state") != "skipped").alias("checked"), F.count_if(F.col("state") == "valid").alias("valid"),
        F.count_if(F.col("state") == "invalid").alias("invalid"), F.count_if(F.col("state") == "skipped").alias("skipped"))


def completeness(documents: DataFrame) -> DataFrame:
    """One row ``(filled, slots, completeness)`` over the recommended sections of known documents."""
    filled, slots = F.lit(0), F.lit(0)
    for t in TYPES:
        here = F.col("type") == t.name
        filled = F.when(here, F.size(F.array_intersect("present", F.array(*map(F.lit, t.recommended))))).otherwise(filled)
        slots = F.when(here, F.lit(len(t.recommended))).otherwise(slots)
    one = documents.agg(F.coalesce(F.sum(filled), F.lit(0)).alias("filled"), F.coalesce(F.sum(slots), F.lit(0)).alias("slots"))
    return one.withColumn("completeness", ratio(F.col("filled"), F.col("slots")))


def relationship_summary(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(total, valid, broken, orphaned, coverage)``."""
    known = documents.where(F.col("type").isin(*NAMES))
    total = edges.agg(F.count("*").alias("total"), F.count_if(F.col("issue").isNull()).alias("valid"), F.count_if(F.col("issue").isNotNull()).alias("broken"))
    linked = known.join(edges.select(F.col("source_path").alias("path")).distinct(), "path", "left_semi").agg(F.count("*").alias("linked"))
    number = known.agg(F.count("*").alias("known"))
    alone = graph.orphans(documents, edges).agg(F.count("*").alias("orphaned"))
    one = total.crossJoin(linked).crossJoin(number).crossJoin(alone)  # a row each
    return one.select("total", "valid", "broken", "orphaned", ratio(F.col("linked"), F.col("known")).alias("coverage"))


def health(validity: Column, complete: Column, integrity: Column) -> Column:
    """0 to 100: half for validity, a quarter each for completeness and integrity."""
    return round_half_even(100 * (0.5 * validity + 0.25 * complete + 0.25 * integrity), 0).cast("int")


def portfolio(documents: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """One row of totals, completeness, relationship summary and health."""
    one = totals(states).crossJoin(completeness(documents)).crossJoin(relationship_summary(documents, edges).withColumnRenamed("valid", "edges_valid").withColumnRenamed("total", "edges"))
    return one.withColumn("health", health(ratio(F.col("valid"), F.col("checked")), F.col("completeness"), ratio(F.col("edges_valid"), F.col("edges"))))


def attention(documents: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """``(severity, path, code)`` rows that ask for work, errors first."""
    lacking = F.lit(False)
    for t in TYPES:
        lacking = lacking | ((F.col("type") == t.name) & (F.size(F.array_intersect("missing", F.array(*map(F.lit, t.recommended)))) > 0))
    rows = (
        states.where("state = 'invalid'").select(F.lit("error").alias("severity"), "path", F.lit("invalid-artifact").alias("code"))
        .unionByName(edges.where("issue is not null").select(F.lit("error").alias("severity"), F.col("source_path").alias("path"), F.lit("broken-relationship").alias("code")).distinct())
        .unionByName(documents.where(lacking).select(F.lit("warning").alias("severity"), "path", F.lit("missing-recommended").alias("code")))
    )
    return rows.orderBy("severity", F.split("path", "/"), "code")


def statistics(documents: DataFrame, states: DataFrame) -> DataFrame:
    """``(type, documents, requirements, mean_requirements, without_metrics, without_risks, invalid)``."""
    joined = documents.join(states.select("path", "state"), "path")
    mean = F.try_divide(F.sum(F.size("requirements")), F.count("*"))
    return joined.groupBy("type").agg(
        F.count("*").alias("documents"), F.sum(F.size("requirements")).alias("requirements"), round_half_even(mean, 2).alias("mean_requirements"),
        F.count_if(F.size("success_metrics") == 0).alias("without_metrics"), F.count_if(F.size("risks") == 0).alias("without_risks"),
        F.sort_array(F.collect_list(F.when(F.col("state") == "invalid", F.col("path")))).alias("invalid"),
    )


def largest_feature(documents: DataFrame) -> DataFrame:
    """The requirement document with most requirements; of equals the first name, a longer one before its own beginning."""
    name = path_name(F.col("path"))
    # greater keys are later: negated code points make the smallest name, and of prefixes the longer, the greatest
    key = F.transform(F.split(name, ""), lambda c: -F.ascii(c))
    ranked = documents.where("type = 'requirement'").select("path", F.size("requirements").alias("n"), key.alias("key"))
    return ranked.orderBy(F.desc("n"), F.desc("key"), F.split("path", "/")).limit(1).select("path", "n")


def bucket_counts(documents: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """``(value, n)``: words of a vocabulary in its order, then others sorted."""
    order = F.create_map(*(F.lit(x) for k, w in enumerate(vocabulary) for x in (w, k)))
    counts = documents.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("_o", F.coalesce(order[F.col("value")], F.lit(len(vocabulary)))).orderBy("_o", "value").drop("_o")


def section_presence(edges: DataFrame) -> DataFrame:
    """``(relationship, documents)``: how many documents have each relationship."""
    return edges.groupBy("relationship").agg(F.count_distinct("source_path").alias("documents"))


def review(documents: DataFrame, edges: DataFrame, states: DataFrame, commits: DataFrame, reference_epoch: int, stale_after: int = STALE_DAYS) -> DataFrame:
    """``(priority, path, code)``: what to look at, most urgent first. ``commits(path, epoch)``."""
    priority = F.create_map(*(F.lit(x) for c, p in PRIORITIES.items() for x in (c, p)))
    rows = attention(documents, edges, states).select("path", "code")
    rows = rows.unionByName(documents.where("type = 'unknown'").select("path", F.lit("unclassified").alias("code")))
    rows = rows.unionByName(graph.drift(edges, commits).select(F.col("source_path").alias("path"), F.lit("suspect-drift").alias("code")).distinct())
    newest = commits.join(documents.where("type <> 'unknown'").select("path"), "path", "left_semi").agg(F.max("epoch").alias("newest"))
    stale = newest.where(age_days(F.lit(reference_epoch), F.col("newest")) > stale_after)
    rows = rows.unionByName(stale.select(F.lit("").alias("path"), F.lit("stale-corpus").alias("code")))
    return rows.withColumn("priority", priority[F.col("code")]).select("priority", "path", "code").orderBy("priority", F.split("path", "/"), "code")


def doctor(documents: DataFrame, edges: DataFrame, validated: DataFrame, relationships: DataFrame, commits: DataFrame | None = None, hub: int = HUB_DEGREE) -> DataFrame:
    """Every health finding as one table: rules, relationships, orphans, hubs, injection, unlinked mentions, drift."""
    text = F.array_join(F.flatten(F.transform("search_sections", lambda s: s["lines"])), "\n")
    parts = [
        rules.as_findings(validated), relationships,
        graph.orphans(documents, edges).select(*finding("health", "orphan", "warning", path=F.col("path"))),
        graph.degrees(edges, hub).where("hub").select(*finding("health", "hub", "warning", path=F.col("path"), message=F.col("degree"))),
        rules.injections(documents, text).select(*finding("health", "injection", "error", path=F.col("path"), message=F.col("code"))),
        graph.unlinked_mentions(documents, graph.alias_table(documents), edges).select(
            *finding("health", "unlinked-mention", "warning", path=F.col("source_path"), target=F.col("target_path"), identifier=F.col("token"))),
    ]
    if commits is not None:
        parts.append(graph.drift(edges, commits).select(*finding("health", "suspect-drift", "warning", path=F.col("source_path"), target=F.col("target_path"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("severity", F.split("path", "/"), "code")


def severity_totals(findings: DataFrame) -> DataFrame:
    one = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return one.withColumn("ok", F.col("errors") == 0)


def gate(findings: DataFrame, off: list[str] = (), blocking: list[str] = (), advisory: list[str] = ()) -> DataFrame:
    """``FINDING`` columns and ``verdict``: off beats blocking beats advisory; otherwise errors block. Those that are off go."""
    for name in (*off, *blocking, *advisory):
        if not isinstance(name, str):
            raise ValueError(f"a policy names a code by text, not {name!r}")
    code = F.col("code")
    verdict = (
        F.when(code.isin(*off) if off else F.lit(False), "off").when(code.isin(*blocking) if blocking else F.lit(False), "blocking")
        .when(code.isin(*advisory) if advisory else F.lit(False), "advisory").otherwise(F.when(F.col("severity") == "error", "blocking").otherwise("advisory"))
    )
    judged = findings.withColumn("verdict", verdict).where("verdict <> 'off'").select(*FINDING, "verdict")
    return judged.orderBy(F.split("path", "/"), F.coalesce("line", F.lit(0)), "source", "code", "message")


def retired_statuses(type_name: str) -> list[str]:
    return BY_NAME[type_name].retired
