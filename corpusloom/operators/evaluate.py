"""Retrieval quality: precision, recall and violations at k, their means, and the gate on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import round_half_even

CUTS = (1, 3, 5)


def case_metrics(ranked: DataFrame, relevant: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """``(case, p_at_k..., r_at_k..., violations)``.

    ``ranked(case, doc, position)`` from 1, ``relevant(case, doc)``, ``forbidden(case, doc)``. Precision divides by k,
    recall by the number of relevant documents (1.0 of none). Cases without results count as zero.
    """
    marks = relevant.select("case", "doc").distinct().withColumn("good", F.lit(1))
    if forbidden is not None:
        bad = forbidden.select("case", "doc").distinct().withColumn("bad", F.lit(1))
    else:
        bad = marks.where("false").select("case", "doc", F.lit(1).alias("bad"))
    joined = ranked.where(F.col("position") <= max(CUTS)).join(marks, ["case", "doc"], "left").join(bad, ["case", "doc"], "left")
    hits = joined.groupBy("case").agg(
        *(F.count_if((F.col("position") <= k) & F.col("good").isNotNull()).alias(f"h{k}") for k in CUTS), F.count("bad").alias("violations"))
    totals = relevant.groupBy("case").agg(F.count_distinct("doc").alias("n"))
    cases = totals.join(hits, "case", "full_outer").na.fill(0, ["n", "violations", *(f"h{k}" for k in CUTS)])
    return cases.select(
        "case", *((F.col(f"h{k}") / k).alias(f"p_at_{k}") for k in CUTS),
        *(F.coalesce(F.try_divide(F.col(f"h{k}"), F.col("n")), F.lit(1.0)).alias(f"r_at_{k}") for k in CUTS), "violations")


def macro_means(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = [c for c in metrics.columns if c.startswith(("p_at_", "r_at_"))]
    return metrics.groupBy(*(by or [])).agg(*(round_half_even(F.avg(c), 6).alias(c) for c in names), F.sum("violations").alias("violations"))


def gate(overall: dict, baseline: dict, floors: dict, tolerance: float, violations_limit: int = 0) -> list[str]:
    """Reasons against a run: too many violations, under a floor, or under the baseline by more than the tolerance; p_at_1 and r_at_5 are gated."""
    out = [f"violations {overall['violations']} > {violations_limit}"] if overall["violations"] > violations_limit else []
    for name in ("p_at_1", "r_at_5"):
        if name in floors and overall[name] < floors[name]:
            out.append(f"{name} {overall[name]} < floor {floors[name]}")
        if name in baseline and overall[name] < baseline[name] - tolerance:
            out.append(f"{name} {overall[name]} < baseline {baseline[name]}")
    return out
