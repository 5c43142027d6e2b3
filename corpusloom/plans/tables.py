"""Adapters: the driver's tables as corpora, references, events and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.search import build_index
from corpusloom.sources import index as store
from corpusloom.sources.staging import shared_root, spread


TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name in TEXTS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search entries of the documents: heading = language, body = lines, inbound = id modulo 5, retired = labelled as poor."""
    docs = table(spark, sf_dir, "documents")
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("retired"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    stem = F.concat(F.lit("DOC-"), F.col("doc_id").cast("string"))
    return docs.join(poor, "doc_id", "left").select(
        F.concat_ws("/", "source", F.concat(stem, F.lit(".md"))).alias("path"), stem.alias("id"), F.col("lang").alias("type"),
        F.get(lines, F.lit(0)).alias("title"), F.array("lang", "source").alias("tags"), F.array(stem).alias("aliases"),
        F.array(F.struct(F.col("lang").alias("heading"), lines.alias("lines"))).alias("sections"),
        (F.col("doc_id") % 5).alias("inbound"), F.coalesce("retired", F.lit(False)).alias("retired"),
        F.lit(False).alias("live_decision"),
    )


def search_index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The index of ``entries``: the published one if it was made of these files, else a new one, published for later queries."""
    made_of = store.files_hash(spark, [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"])
    root = f"{shared_root(spark)}/search-{made_of}"
    found = store.current(spark, root, made_of)
    if found is None:
        store.publish(root, build_index(entries(spark, sf_dir)), made_of)
        found = store.current(spark, root, made_of)
    return found


ENTRIES_SQL = r"""
lined AS (
  SELECT d.doc_id, d.source, d.lang, 'DOC-' || d.doc_id AS id,
    list_filter(string_split(coalesce(d.text, ''), chr(10)), lambda x: trim(x) <> '') AS lines,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0) AS retired
  FROM documents d
), entries AS (
  SELECT doc_id, source || '/' || id || '.md' AS path, id, lang AS type, lines[1] AS title, doc_id % 5 AS inbound, retired, lang, source, lines FROM lined
), raw AS (
  SELECT path, type, inbound, retired, id AS r_id, coalesce(title, '') AS r_title, path AS r_path, lang AS r_heading,
    array_to_string(lines, ' ') AS r_body, lang || ' ' || source AS r_tags FROM entries
), tok AS (
  SELECT path, type, inbound, retired, __TOKENS__ FROM raw
)"""
_TOKEN_SQL = (
    "list_filter(string_split(lower(regexp_replace(regexp_replace(r_{f}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^0-9A-Za-z]+', ' ', 'g')), ' '), "
    "lambda x: x <> '') AS t_{f}"
)
FIELDS = ["id", "title", "path", "heading", "body", "tags"]
ENTRIES_SQL = ENTRIES_SQL.replace("__TOKENS__", ", ".join(_TOKEN_SQL.format(f=f) for f in FIELDS))
BOOSTS = {"id": 4.0, "title": 3.0, "path": 2.0, "heading": 1.5, "body": 1.0, "tags": 2.5}


def tf(field: str, term: str) -> str:
    return f"len(list_filter(t_{field}, lambda x: starts_with(x, '{term}')))"


def hit(field: str, term: str) -> str:
    return f"{tf(field, term)} > 0"


def search_sql(terms: list[str], where: str = "true", live: bool = False, columns: str = "path, tier::BIGINT AS tier, round(bm25, 9) AS bm25, lexical_rank, graph_rank, round(fused, 12) AS fused") -> str:
    """The whole search as SQL, in the same order of operations."""
    distinct = list(dict.fromkeys(terms))
    any_hit = {t: "(" + " OR ".join(hit(f, t) for f in FIELDS) + ")" for t in distinct}
    tiers = ["id", "title", "tags", "path", "heading", "body"]
    tier = "CASE " + " ".join(f"WHEN {' OR '.join(hit(f, t) for t in distinct)} THEN {k}" for k, f in enumerate(tiers)) + " END"
    stats = ", ".join([f"sum(len(t_{f}))::DOUBLE / count(*) AS mean_{f}" for f in FIELDS] + [f"count(*) FILTER ({any_hit[t]}) * {terms.count(t)} AS df_{k}" for k, t in enumerate(distinct)])
    score = []
    for t in terms:
        k = distinct.index(t)
        w = " + ".join(
            f"CASE WHEN {tf(f, t)} > 0 THEN {b}::DOUBLE * ({tf(f, t)}::DOUBLE / CASE WHEN mean_{f} > 0 THEN (1.0::DOUBLE - 0.75::DOUBLE) + 0.75::DOUBLE * (len(t_{f})::DOUBLE / mean_{f}) ELSE 1.0::DOUBLE END) ELSE 0.0::DOUBLE END"
            for f, b in BOOSTS.items())
        score.append(f"CASE WHEN df_{k} <> 0 AND ({w}) > 0 THEN ln(1.0::DOUBLE + ((n - df_{k})::DOUBLE + 0.5::DOUBLE) / (df_{k}::DOUBLE + 0.5::DOUBLE)) * (({w}) / (1.2::DOUBLE + ({w}))) ELSE 0.0::DOUBLE END")
    return f"""
WITH {ENTRIES_SQL}, stats AS (SELECT count(*) AS n, {stats} FROM tok),
matched AS (
  SELECT path, inbound, {tier} AS tier, {' + '.join(score)} AS bm25 FROM tok, stats
  WHERE {' AND '.join(any_hit[t] for t in distinct)} AND {where} {'AND NOT retired' if live else ''}
), ranked AS (
  SELECT *, rank() OVER (ORDER BY bm25 DESC) AS lexical_rank, rank() OVER (ORDER BY inbound DESC) AS graph_rank FROM matched
), fused AS (SELECT *, 1.0::DOUBLE / (60 + lexical_rank) + 0.5::DOUBLE / (60 + graph_rank) AS fused FROM ranked)
SELECT {columns} FROM fused"""
