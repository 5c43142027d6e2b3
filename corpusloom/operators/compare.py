"""Two states of a corpus: changes, transitions, requirement diffs, and what they say about intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import rules

CHANGES = ["added", "modified", "removed"]


def state_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, change)`` of rows that were added, removed, or have another value. Rows with equal values are absent."""
    a = old.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def change_order(changes: DataFrame, key: str) -> DataFrame:
    return changes.orderBy(F.array_position(F.array(*map(F.lit, CHANGES)), F.col("change")), key)


def transitions(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """``(key, transition)``: newly invalid, also of rows that are new; newly valid, only of rows that were there."""
    a = old.select(key, F.col(state).alias("_a"))
    b = new.select(key, F.col(state).alias("_b"))
    moved = (
        F.when((F.col("_b") == "invalid") & ~F.coalesce(F.col("_a") == "invalid", F.lit(False)), "newly-invalid")
        .when((F.col("_b") == "valid") & (F.col("_a") == "invalid"), "newly-valid")
    )
    return b.join(a, key, "left").select(key, moved.alias("transition")).where("transition is not null")


def issue_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows of either side that the other lacks, with ``side``: introduced or resolved."""
    return new.subtract(old).withColumn("side", F.lit("introduced")).unionByName(old.subtract(new).withColumn("side", F.lit("resolved")))


def issue_key(findings: DataFrame, root: Column | None = None) -> DataFrame:
    """Findings by what makes them the same in two states: code, severity and where, paths relative and joined in order."""
    where = F.coalesce(F.array_join(F.array_sort("paths"), ","), F.col("path"))
    where = where if root is None else F.replace(where, root, F.lit(""))
    return findings.select("code", "severity", where.alias("where"), "target").distinct()


def requirement_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``(keys, change, old, new)``: rows by key, of repeated keys the last value counts."""
    last = lambda df, name: df.groupBy(*keys).agg(F.max_by(value, order).alias(name), F.lit(True).alias(f"in_{name}"))
    both = last(old, "old").join(last(new, "new"), keys, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select(*keys, change.alias("change"), "old", "new").where("change is not null")


def list_difference(old: Column, new: Column) -> tuple[Column, Column]:
    """(added, removed) entries of two ordered lists, each once, in order."""
    return F.array_except(new, old), F.array_except(old, new)


def type_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(type, before, after, delta)``."""
    a = old.groupBy("type").agg(F.count("*").alias("before"))
    b = new.groupBy("type").agg(F.count("*").alias("after"))
    return a.join(b, "type", "full_outer").na.fill(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def intent(pairs: DataFrame) -> DataFrame:
    """``(key, code)`` of requirements' texts ``pairs(key, old, new)``: what a change weakens.

    specificity_regression: digits went. ambiguity_introduced: ambiguous words came, also with a new document (a null
    old text). constraint_weakened: no mandatory word is left, and a hedge is there. constraint_removed: a mandatory text is gone.
    """
    old, new = F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))
    changed = F.col("old").isNotNull() & F.col("new").isNotNull()
    has = lambda text, words: F.size(rules.words_in(text, words)) > 0
    more = F.size(F.array_except(rules.words_in(new, rules.AMBIGUOUS), rules.words_in(old, rules.AMBIGUOUS))) > 0
    codes = F.array_compact(F.array(
        F.when(changed & old.rlike("[0-9]") & ~new.rlike("[0-9]"), F.lit("specificity_regression")),
        F.when(F.col("new").isNotNull() & more, F.lit("ambiguity_introduced")),
        F.when(changed & has(old, rules.MANDATORY) & ~has(new, rules.MANDATORY) & has(new, rules.HEDGES), F.lit("constraint_weakened")),
        F.when(F.col("new").isNull() & has(old, rules.MANDATORY), F.lit("constraint_removed")),
    ))
    return pairs.select("key", F.explode(codes).alias("code"))


#: Fixed: sections whose loss is told, by the code that tells it.
LOST = {"acceptance_criteria_removed": ["acceptance criteria"], "success_measures_removed": ["success measures", "success metrics"]}


def sections_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, code)`` of documents in both states whose acceptance criteria or success measures are no longer filled."""
    filled = lambda c, names: F.exists(c, lambda s: s["name"].isin(*names) & (F.trim(s["body"]) != ""))
    both = old.select("path", F.col("sections").alias("a")).join(new.select("path", F.col("sections").alias("b")), "path")
    codes = F.array_compact(F.array(*(F.when(filled("a", names) & ~filled("b", names), F.lit(code)) for code, names in LOST.items())))
    return both.select("path", F.explode(codes).alias("code"))


def unlinked_scope(added: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, code)`` of added documents ``(path, type)`` of a known type that declare no reference and that none resolves to."""
    linked = edges.select(F.explode(F.array("source_path", "resolved_path")).alias("path")).where("path is not null").distinct()
    return added.where("type <> 'unknown'").join(linked, "path", "left_anti").select("path", F.lit("unlinked_scope").alias("code"))


def relationship_impact(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, referrers)``: documents that refer to changed ones, in order of reference."""
    good = edges.where("resolved_path is not null and issue is null")
    hit = good.join(changes.where("change <> 'added'").select(F.col("path").alias("resolved_path")), "resolved_path", "left_semi")
    listed = hit.groupBy(F.col("resolved_path").alias("path")).agg(F.sort_array(F.collect_set("source_path")).alias("referrers"))
    return listed


def watch(changes: DataFrame, moved: DataFrame, intents: DataFrame) -> DataFrame:
    """``(path, recommendation)`` of a comparison: each once, in the order of urgency."""
    parts = [
        moved.where("transition = 'newly-invalid'").select("path", F.lit("repair the document").alias("recommendation"), F.lit(0).alias("o")),
        intents.select(F.col("key").alias("path"), F.lit("check what the change weakens").alias("recommendation"), F.lit(1).alias("o")),
        changes.where("change = 'removed'").select("path", F.lit("check what referred to it").alias("recommendation"), F.lit(2).alias("o")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("path", "recommendation").agg(F.min("o").alias("o")).orderBy("o", "path").drop("o")


def proposed(documents: DataFrame, one: DataFrame) -> DataFrame:
    """A corpus with a proposed document in place of the one with the same id."""
    same = one.select(F.lower("canonical_id").alias("_id"))
    return documents.withColumn("_id", F.lower("canonical_id")).join(same, "_id", "left_anti").drop("_id").unionByName(one)


def change_collapse(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows at which a key's value differs from the one before."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return events.withColumn("_changed", first | ~F.col(value).eqNullSafe(before)).where("_changed").drop("_changed")
