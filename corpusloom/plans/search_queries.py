"""Search, facets, postings and evaluation over the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.text import excerpt, first_line, path_stem, search_tokens
from corpusloom.operators import evaluate
from corpusloom.operators.search import corpus_stats, final_order, indexed_counts, indexed_postings, search
from corpusloom.plans.tables import ENTRIES_SQL, FIELDS, entries, hit, search_index, search_sql, table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _find(spark, sf, text, **how):
    return search(entries(spark, sf), text, index=search_index(spark, sf), **how)


def _scores(ranked):
    """Scores to nine places: the logarithms of two engines may differ in the last bit."""
    return ranked.select("path", F.col("tier").cast("long").alias("tier"), F.round("bm25", 9).alias("bm25"), "lexical_rank", "graph_rank", F.round("fused", 12).alias("fused"))


@query("search_documents", search_sql(["the", "er"]))
def search_documents(spark, sf):
    return _scores(_find(spark, sf, "the er"))


@query("search_duplicate_terms", search_sql(["en", "en", "de"]))
def search_duplicate_terms(spark, sf):
    return _scores(_find(spark, sf, "en En de"))


@query("search_by_type", search_sql(["src"], where="type = 'de'"))
def search_by_type(spark, sf):
    return _scores(_find(spark, sf, "src", type="de"))


@query("search_live_only", search_sql(["doc", "th"], live=True))
def search_live_only(spark, sf):
    return _scores(_find(spark, sf, "doc th", live_only=True))


@query("search_by_tag", search_sql(["doc"], where="r_tags_src = 'fr src3'").replace("SELECT path, type, inbound, retired, list", "SELECT path, type, inbound, retired, r_tags AS r_tags_src, list", 1))
def search_by_tag(spark, sf):
    return _scores(_find(spark, sf, "doc", tags=["FR", "src3"]))


@query("search_top_k", search_sql(["an", "on"], columns="path, lexical_rank, graph_rank, row_number() OVER (ORDER BY round(fused, 12) DESC, path) AS position")
       + " QUALIFY position <= 20")
def search_top_k(spark, sf):
    top = final_order(_find(spark, sf, "an on")).limit(20)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.round("fused", 12).desc(), "path")).cast("long")).select("path", "lexical_rank", "graph_rank", "position")


@query("post_filtered_search", search_sql(["doc"], columns="path, lexical_rank, graph_rank") + " JOIN (SELECT 'src1/' AS p) ON starts_with(path, p)")
def post_filtered_search(spark, sf):
    """A filter after ranking: ranks keep their gaps."""
    return _find(spark, sf, "doc").where(F.col("path").startswith("src1/")).select("path", "lexical_rank", "graph_rank")


@query("corpus_stats", f"""WITH {ENTRIES_SQL} SELECT count(*) AS n, {', '.join(f'sum(len(t_{f}))::DOUBLE / count(*) AS mean_{f}' for f in FIELDS)},
  count(*) FILTER ({' OR '.join(hit(f, 'the') for f in FIELDS)}) AS df_0, count(*) FILTER ({' OR '.join(hit(f, 'zz') for f in FIELDS)}) AS df_1 FROM tok""")
def stats_query(spark, sf):
    index, terms = search_index(spark, sf), ["the", "zz"]
    return corpus_stats(indexed_counts(index, terms), terms, index["totals"])


@query("prefix_document_frequency", f"""WITH {ENTRIES_SQL}, words AS (SELECT path, unnest(list_distinct(t_body)) AS token FROM tok)
  SELECT substr(token, 1, 2) AS prefix, count(DISTINCT path) AS documents FROM words GROUP BY 1""")
def prefix_df(spark, sf):
    words = search_index(spark, sf)["postings"].where("field = 'body'").select("path", F.substring("token", 1, 2).alias("prefix"))
    return words.distinct().groupBy("prefix").agg(F.count("*").alias("documents"))


@query("posting_intersection", f"""WITH {ENTRIES_SQL} SELECT path FROM tok
  WHERE {' AND '.join('(' + ' OR '.join(hit(f, t) for f in FIELDS) + ')' for t in ('ing', 'er', 'src1'))}""")
def posting_intersection(spark, sf):
    return indexed_postings(search_index(spark, sf), ["ing", "er", "src1"])


@query("first_hit_snippets", f"""WITH {ENTRIES_SQL.replace('SELECT path, type, inbound, retired, list', 'SELECT path, type, inbound, retired, r_lines, list', 1).replace("lang || ' ' || source AS r_tags FROM entries", "lang || ' ' || source AS r_tags, lines AS r_lines FROM entries")}
  SELECT path, list_filter(r_lines, lambda l: len(list_filter(list_filter(string_split(lower(regexp_replace(regexp_replace(l, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^0-9A-Za-z]+', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: starts_with(x, 'ou'))) > 0)[1] AS snippet
  FROM tok WHERE {hit('body', 'ou')} AND NOT ({' OR '.join(hit(f, 'ou') for f in ('id', 'title', 'tags', 'path', 'heading'))})""")
def first_hit_snippets(spark, sf):
    return _find(spark, sf, "ou", snippets=True).where("field = 'body'").select("path", "snippet")


@query("search_token_lengths", f"WITH {ENTRIES_SQL} SELECT path, len(t_body) AS n_tokens, len(list_distinct(t_body)) AS n_distinct FROM tok")
def search_token_lengths(spark, sf):
    index = search_index(spark, sf)
    distinct = index["postings"].where("field = 'body'").groupBy("path").agg(F.count("*").alias("n"))
    return index["documents"].join(distinct, "path", "left").select("path", F.col("len_body").cast("long").alias("n_tokens"), F.coalesce("n", F.lit(0).cast("long")).alias("n_distinct"))


@query("excerpts", "SELECT doc_id, substr(text, 1, 1600) AS excerpt, length(substr(text, 1, 1600)) AS n FROM documents")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", excerpt(F.col("text"), 8000, 5).alias("excerpt")).withColumn("n", F.length("excerpt").cast("long"))


@query("first_lines", "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line, regexp_replace(source || '/' || doc_id || '.a.md', '^.*/', '') AS name FROM documents")
def first_lines(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(path_stem(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".a.md"))), F.lit(".md"))
    return docs.select("doc_id", first_line(F.col("text")).alias("line"), name.alias("name"))


@query("page_headings", """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS heading FROM pages)
  SELECT page_id, heading FROM h""")
def page_headings(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1))).alias("heading"))


_EVAL_SQL = """
WITH ranked AS (
  SELECT doc_id // 10 AS c, doc_id AS doc, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY n_chars DESC, doc_id) AS position FROM documents
), relevant AS (SELECT d.doc_id // 10 AS c, d.doc_id AS doc FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1
), forbidden AS (SELECT d.doc_id // 10 AS c, d.doc_id AS doc FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1
), hits AS (
  SELECT r.c, count(*) FILTER (position <= 1 AND g.doc IS NOT NULL) AS h1, count(*) FILTER (position <= 3 AND g.doc IS NOT NULL) AS h3,
    count(*) FILTER (position <= 5 AND g.doc IS NOT NULL) AS h5, count(b.doc) AS violations
  FROM ranked r LEFT JOIN relevant g ON g.c = r.c AND g.doc = r.doc LEFT JOIN forbidden b ON b.c = r.c AND b.doc = r.doc WHERE position <= 5 GROUP BY r.c
), totals AS (SELECT c, count(DISTINCT doc) AS n FROM relevant GROUP BY c)
, cases AS (SELECT h.c AS "case", h1 / 1.0::DOUBLE AS p_at_1, h3 / 3.0::DOUBLE AS p_at_3, h5 / 5.0::DOUBLE AS p_at_5,
  CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE h1::DOUBLE / n END AS r_at_1, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE h3::DOUBLE / n END AS r_at_3,
  CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE h5::DOUBLE / n END AS r_at_5, violations FROM hits h LEFT JOIN totals t USING (c))
"""


def _cases(spark, sf):
    docs = table(spark, sf, "documents").withColumn("case", F.floor(F.col("doc_id") / 10)).withColumnRenamed("doc_id", "doc")
    position = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("n_chars"), "doc"))
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "doc")
    known = docs.select("case", "doc").join(labels, "doc")
    return evaluate.case_metrics(docs.select("case", "doc", position.alias("position")), known.where("quality = 1"), known.where("toxic = 1"))


@query("retrieval_quality_cases", _EVAL_SQL + "SELECT * FROM cases")
def retrieval_quality_cases(spark, sf):
    return _cases(spark, sf)


@query("retrieval_quality_violations", _EVAL_SQL + "SELECT count(*) AS cases, sum(violations)::BIGINT AS violations FROM cases")
def retrieval_quality_violations(spark, sf):
    return _cases(spark, sf).agg(F.count("*").alias("cases"), F.sum("violations").alias("violations"))


@query("identifier_tokens", r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '[^0-9A-Za-z-]+', ' ', 'g'), ' '), lambda x: regexp_matches(x, '[0-9]'))) AS n FROM documents""")
def identifier_tokens(spark, sf):
    words = F.split(F.regexp_replace("text", "[^0-9A-Za-z-]+", " "), " ")
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(words, lambda x: x.rlike("[0-9]"))).cast("long").alias("n"))


def page_tokens(spark, sf):
    return table(spark, sf, "pages").select("page_id", search_tokens(F.col("url")).alias("tokens"))
