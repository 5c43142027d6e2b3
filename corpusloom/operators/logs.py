"""Summaries of event logs: tool calls and command usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import round_half_even


def tool_summary(events: DataFrame) -> DataFrame:
    """``(tool, calls, errors, truncated, mean_ms, sessions, first, last)`` of ``events(tool, outcome, truncated, duration_ms, session, ts)``."""
    return events.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if(F.col("outcome").isin("error", "exception")).alias("errors"),
        F.count_if(F.col("truncated")).alias("truncated"), round_half_even(F.avg("duration_ms"), 0).cast("long").alias("mean_ms"),
        F.count_distinct("session").alias("sessions"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def command_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("command").agg(F.count("*").alias("calls"), F.count_distinct("session").alias("sessions"))


def last_days(events: DataFrame, days: int = 7) -> DataFrame:
    """``(day, calls)`` of the last distinct UTC days, oldest first; a day is the date at the start of the stamp."""
    day = F.substring(F.col("ts").cast("string"), 1, 10)
    counts = events.groupBy(day.alias("day")).agg(F.count("*").alias("calls"))
    return counts.orderBy(F.desc("day")).limit(days).orderBy("day")
