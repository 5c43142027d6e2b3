"""Line logs of JSON events, configuration and evaluation files."""

from __future__ import annotations

import json
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOOL_EVENT = "schema_version int, ts string, session string, tool string, outcome string, error string, duration_ms long, truncated boolean"
COMMAND_EVENT = "schema_version int, ts string, session string, command string, outcome string, duration_ms long"


def read_events(spark: SparkSession, path: str, schema: str = TOOL_EVENT) -> tuple[DataFrame, DataFrame]:
    """(events, one row ``skipped``): lines that are no JSON object are skipped and counted, blank lines only skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"), F.col("value").rlike(r"^\s*\{").alias("object"))
    good = F.col("object") & F.col("e._bad").isNull()
    events = parsed.where(good).select("e.*").drop("_bad")
    return events, parsed.agg(F.count_if(~good).alias("skipped"))


def append_events(events: DataFrame, path: str) -> None:
    """Events appended as JSON lines."""
    events.write.mode("append").json(path)


def read_config(start: str, name: str = ".corpusloom/config.yaml") -> dict:
    """The nearest configuration file at or above a folder; {} if there is none or it is no mapping."""
    import yaml

    at = os.path.abspath(start)
    while True:
        file = posixpath.join(at, name)
        if os.path.isfile(file):
            with open(file, encoding="utf-8") as f:
                try:
                    data = yaml.safe_load(f)
                except yaml.YAMLError:
                    return {}
            return data if isinstance(data, dict) else {}
        if (up := os.path.dirname(at)) == at:
            return {}
        at = up


def policy(config: dict) -> dict[str, list[str]]:
    """off, blocking and advisory codes of a configuration; a bare ``off:`` key that YAML reads as false counts. Raises ValueError on other shapes."""
    section = (config.get("enforcement") or {}) if isinstance(config.get("enforcement") or {}, dict) else None
    if section is None:
        raise ValueError("enforcement must be a mapping")
    out = {}
    for name in ("off", "blocking", "advisory"):
        value = section.get(name, section.get(False) if name == "off" else None) or []
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise ValueError(f"enforcement.{name} must be a list of codes")
        out[name] = value
    return out


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, relevant, forbidden) of an evaluation file. Raises ValueError where the shape is wrong."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    cases = data.get("cases") if isinstance(data, dict) else None
    if not isinstance(cases, list) or not all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("relevant"), list) for c in cases):
        raise ValueError("an evaluation file holds cases with an id and a list of relevant documents")
    rows = [(c["id"], c.get("query"), c.get("tool", "search_artifacts"), c.get("category"), c.get("type")) for c in cases]
    pairs = lambda name: [(c["id"], d) for c in cases for d in c.get(name) or []]
    return (
        spark.createDataFrame(rows, "case string, query string, tool string, category string, type string"),
        spark.createDataFrame(pairs("relevant"), "case string, doc string"), spark.createDataFrame(pairs("must_not_return"), "case string, doc string"),
    )
