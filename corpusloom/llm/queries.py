"""The registered queries opN_<name> and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import byte_bpe, mixing, ngram_join, quality_lm, quality_rules, tiff, token_records, token_tree, toxicity, url_filters
from corpusloom.sources.staging import spread

URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


OP1_SQL = r"""
WITH RECURSIVE rules(decision, rule) AS (
  VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'),
         ('block', 'example.net/de/8'), ('block', 'org/es/')
), tags AS (
  SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), targets AS (
  SELECT src, trim(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
      THEN coalesce(regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1), '')
        || coalesce(regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2), '')
        || coalesce(regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3), '')
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
      THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''>\s]+)', 1)
    END) AS dst FROM tags
), links AS (
  SELECT src, CASE
    WHEN regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN dst
    WHEN starts_with(dst, '//') THEN regexp_extract(src, '^[^:]*:') || dst
    WHEN starts_with(dst, '/') THEN regexp_extract(src, '^[^:]*://[^/?#]*') || dst
    WHEN starts_with(dst, '?') THEN regexp_extract(src, '^[^?#]*') || dst
    WHEN starts_with(dst, '#') THEN regexp_extract(src, '^[^#]*') || dst
    ELSE regexp_extract(src, '^[^:]*://[^/?#]*')
      || CASE regexp_extract(src, '^[^:]*://[^/?#]*(/(?:[^?#]*/)?)', 1) WHEN '' THEN '/'
         ELSE regexp_extract(src, '^[^:]*://[^/?#]*(/(?:[^?#]*/)?)', 1) END || dst END AS dst
  FROM targets WHERE dst <> ''
), urls AS (
  SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT src FROM links UNION ALL SELECT dst FROM links)
), rests AS (
  SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM urls
), parts AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM rests
), judged AS (
  SELECT url, host, path,
    CASE WHEN host <> '' THEN host || CASE path WHEN '' THEN '/' ELSE path END || query END AS node,
    (SELECT max({'n': length(r.rule), 'allow': (r.decision = 'allow')::INT, 'rule': r.rule, 'decision': r.decision})
     FROM rules r WHERE (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
       AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))) AS best
  FROM parts p
), edges AS (
  SELECT s.node AS a, d.node AS b FROM links l JOIN judged s ON s.url = l.src JOIN judged d ON d.url = l.dst
  WHERE s.node <> d.node
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), tainted(node) AS (
  SELECT b FROM both_ways JOIN judged ON node = a WHERE best.decision = 'block'
  UNION SELECT b FROM tainted JOIN both_ways ON a = node
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule,
  coalesce(best.decision, CASE WHEN t.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  (best.decision IS NULL AND t.node IS NOT NULL) AS propagated
FROM pages LEFT JOIN judged j ON j.url = pages.url LEFT JOIN (SELECT DISTINCT node FROM tainted) t ON t.node = j.node
"""


def op2_token_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_tree.count_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that are labelled as good and not as toxic."""
    return _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.quality_classifier(_table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id FROM sets
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digests(tiff.store_texts(_table(spark, sf_dir, "documents")))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_records.token_records(_table(spark, sf_dir, "documents"), path, end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_token_tree": op2_token_tree,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_toxicity": op4_toxicity,
        "op5_mixing": op5_mixing,
        "op6_quality_lm": op6_quality_lm,
        "op7_ngram_join": op7_ngram_join,
        "op8_quality_rules": op8_quality_rules,
        "op9_tiff": op9_tiff,
        "op10_token_records": op10_token_records,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op7_ngram_join": OP7_SQL}
