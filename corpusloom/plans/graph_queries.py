"""The relationship graph over the foreign keys of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.registry import NAMES
from corpusloom.operators import graph
from corpusloom.plans.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Orders refer to customers; some keys are moved out of range, some customers share an alias, some orders name themselves.
_ORDERS = """
refs AS (SELECT 'O' || o_orderkey AS source_path, 'related designs' AS relationship,
  CASE WHEN o_orderkey % 97 = 0 THEN 'o' || o_orderkey WHEN o_orderkey % 11 = 0 THEN 'C-' || o_custkey ELSE 'c' || o_custkey END AS target FROM orders
), aliases AS (SELECT 'c' || c_custkey AS key, 'C' || c_custkey AS path FROM customer
  UNION SELECT 'c' || c_custkey, 'D' || c_custkey FROM customer WHERE c_custkey % 50 = 0 UNION SELECT 'o' || o_orderkey, 'O' || o_orderkey FROM orders
), keys AS (SELECT key, count(DISTINCT path) AS hits, min(path) AS only_path FROM aliases GROUP BY key
), edges AS (SELECT source_path, target, CASE WHEN hits IS NULL THEN 'target-not-found' WHEN hits > 1 THEN 'target-ambiguous' WHEN only_path = source_path THEN 'self-reference' END AS issue,
  CASE WHEN hits = 1 THEN only_path END AS resolved_path FROM refs LEFT JOIN keys ON key = lower(target))
"""


def _order_edges(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    target = F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("o"), key)).when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("C-"), cust)).otherwise(F.concat(F.lit("c"), cust))
    refs = orders.select(F.concat(F.lit("O"), key).alias("source_path"), F.lit("related designs").alias("relationship"), F.lit(0).alias("rel_ord"), F.lit(0).alias("ref_ord"), target.alias("target"))
    named = lambda letter, df, c: df.select(F.concat(F.lit("c" if letter == "D" else letter.lower()), F.col(c).cast("string")).alias("key"), F.concat(F.lit(letter), F.col(c).cast("string")).alias("path"))
    aliases = named("C", customers, "c_custkey").unionByName(named("D", customers.where("c_custkey % 50 = 0"), "c_custkey")).unionByName(named("O", orders, "o_orderkey"))
    return graph.resolve_references(refs, aliases, fold=F.lower)


@query("resolve_references", f"WITH {_ORDERS} SELECT source_path, target, issue, resolved_path FROM edges")
def resolve_references(spark, sf):
    return _order_edges(spark, sf).select("source_path", "target", "issue", "resolved_path")


@query("inbound_counts", f"WITH {_ORDERS} SELECT resolved_path, count(*) AS n FROM edges WHERE resolved_path IS NOT NULL AND issue IS NULL GROUP BY 1")
def inbound_counts(spark, sf):
    return graph.inbound_counts(_order_edges(spark, sf))


@query("degrees_and_hubs", """WITH e AS (SELECT DISTINCT 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem), ends AS (SELECT b AS path, 1 AS i, 0 AS o FROM e UNION ALL SELECT a, 0, 1 FROM e)
  SELECT path, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound, sum(i + o)::BIGINT AS degree, sum(i + o) > 20 AS hub FROM ends GROUP BY path""")
def degrees_and_hubs(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("source_path"), F.concat(F.lit("S"), "l_suppkey").alias("resolved_path"), F.lit(None).cast("string").alias("issue")).distinct()
    return graph.degrees(e)


@query("orphans", f"WITH {_ORDERS} SELECT 'C' || c_custkey AS path FROM customer WHERE 'C' || c_custkey NOT IN (SELECT resolved_path FROM edges WHERE resolved_path IS NOT NULL AND issue IS NULL)")
def orphans(spark, sf):
    docs = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("path"), F.lit("design").alias("type"))
    return graph.orphans(docs, _order_edges(spark, sf)).select("path")


@query("duplicate_identifiers", "SELECT md5(text) AS key, md5(text) AS identifier, list_sort(list(DISTINCT source || '/' || doc_id)) AS paths FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_identifiers(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.md5(F.col("text").cast("binary")).alias("canonical_id"))
    return graph.duplicate_identifiers(docs)


_NATIONS = """links AS (SELECT 'N' || n_nationkey AS path, 'R' || n_regionkey AS other FROM nation UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"""


@query("neighbourhood", f"""WITH RECURSIVE {_NATIONS}, walk(path, hops) AS (SELECT 'R1', 0 UNION SELECT other, hops + 1 FROM walk JOIN links USING (path) WHERE hops < 3)
  SELECT path, min(hops) AS hops FROM walk GROUP BY path""")
def neighbourhood(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    one = n.select(F.concat(F.lit("N"), "n_nationkey").alias("path"), F.concat(F.lit("R"), "n_regionkey").alias("other")).unionByName(
        s.select(F.concat(F.lit("S"), "s_suppkey").alias("path"), F.concat(F.lit("N"), "s_nationkey").alias("other")))
    links = one.unionByName(one.select(F.col("other").alias("path"), F.col("path").alias("other")))
    return graph.neighbourhood(links, spark.createDataFrame([("R1",)], "path string"), 3, None, None).select("path", "hops")


_RINGS = "pairs AS (SELECT n_nationkey AS src, CASE WHEN n_nationkey % 5 = 4 AND n_nationkey % 10 = 4 THEN n_nationkey - 4 ELSE n_nationkey + 1 END AS dst FROM nation)"


@query("cycles", f"""WITH RECURSIVE {_RINGS}, reach(src, dst) AS (SELECT src, dst FROM pairs UNION SELECT r.src, p.dst FROM reach r JOIN pairs p ON p.src = r.dst)
  SELECT a.src AS member, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""")
def cycles(spark, sf):
    k = F.col("n_nationkey")
    return graph.cycles(table(spark, sf, "nation").select(k.alias("src"), F.when((k % 5 == 4) & (k % 10 == 4), k - 4).otherwise(k + 1).alias("dst")))


@query("successors", """WITH RECURSIVE pairs AS (SELECT c_custkey AS older, c_custkey + 1 AS newer FROM customer WHERE c_custkey % 9 <> 0 UNION SELECT c_custkey, c_custkey + 2 FROM customer WHERE c_custkey % 13 = 0),
  walk(old, cur) AS (SELECT older, newer FROM pairs UNION SELECT w.old, p.newer FROM walk w JOIN pairs p ON p.older = w.cur WHERE w.cur % 4 <> 0)
  SELECT old, cur AS live FROM walk WHERE cur % 4 = 0 AND cur <= (SELECT max(c_custkey) FROM customer)""")
def successors(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    pairs = c.where("k % 9 <> 0").select(F.col("k").alias("older"), (F.col("k") + 1).alias("newer")).unionByName(c.where("k % 13 = 0").select(F.col("k").alias("older"), (F.col("k") + 2).alias("newer")))
    return graph.successors(pairs, c.where("k % 4 = 0").withColumnRenamed("k", "path"))


_TIMES = """timed AS (SELECT 'O' || o_orderkey AS source_path, 'O' || o_orderkey || '-' || l_linenumber AS target_path, 'line ' || l_linenumber AS target,
  epoch(o_orderdate)::BIGINT AS source_epoch, epoch(min(l_shipdate))::BIGINT AS target_epoch FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_linenumber, o_orderdate)"""


@query("drift", f"WITH {_TIMES} SELECT source_path, target_path, min(target) AS target_ref, min(source_epoch) AS source_epoch, min(target_epoch) AS target_epoch FROM timed WHERE target_epoch > source_epoch GROUP BY 1, 2")
def drift(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    name = lambda *c: F.concat(*(F.lit(x) if x in ("O", "-", "line ") else F.col(x).cast("string") for x in c))
    edges = li.select(name("O", "l_orderkey").alias("source_path"), name("O", "l_orderkey", "-", "l_linenumber").alias("resolved_path"), name("line ", "l_linenumber").alias("target"),
                      F.lit(0).alias("rel_ord"), F.lit(0).alias("ref_ord"), F.lit(None).cast("string").alias("issue"))
    edges = edges.join(o.select(name("O", "o_orderkey").alias("source_path")), "source_path", "left_semi")
    times = o.select(name("O", "o_orderkey").alias("path"), F.unix_timestamp("o_orderdate").alias("epoch")).unionByName(
        li.groupBy(name("O", "l_orderkey", "-", "l_linenumber").alias("path")).agg(F.min(F.unix_timestamp("l_shipdate")).alias("epoch")))
    return graph.drift(edges, times)


# Customers as documents of the five types that refer to each other.
_TYPES = {"AUTOMOBILE": "requirement", "BUILDING": "decision", "FURNITURE": "roadmap", "HOUSEHOLD": "prompt", "MACHINERY": "design"}
_SECTIONS = ["related requirements", "related decisions", "related roadmaps", "related prompts", "related designs", "supersedes"]
_DOCS = f"""
docs AS (SELECT 'C' || c_custkey AS path, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items())} ELSE 'unknown' END AS type, c_acctbal < 0 AS retired, c_custkey AS k FROM customer
), m AS (SELECT max(c_custkey) AS m FROM customer
), refs AS (SELECT path AS source_path, (CASE k % 6 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SECTIONS))} END) AS relationship, CASE WHEN k % 23 = 0 THEN k ELSE (k * 7) % (m + 3) END AS t FROM docs, m
), edges AS (SELECT source_path, relationship, 'c' || t AS target, CASE WHEN d.path IS NULL THEN 'target-not-found' WHEN d.path = source_path THEN 'self-reference' END AS issue, d.path AS resolved_path, d.type AS to_type, d.retired AS to_retired
  FROM refs LEFT JOIN docs d ON d.k = t)
"""


def _customer_graph(spark, sf):
    c = table(spark, sf, "customer")
    kind = F.create_map(*(F.lit(x) for pair in _TYPES.items() for x in pair))
    docs = c.select(F.concat(F.lit("C"), "c_custkey").alias("path"), F.coalesce(kind[F.col("c_mktsegment")], F.lit("unknown")).alias("type"), (F.col("c_acctbal") < 0).alias("retired"), F.col("c_custkey").alias("k"))
    docs = docs.withColumn("canonical_id", F.col("path"))
    most = c.agg(F.max("c_custkey").alias("m"))
    section = F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("k") % 6 + 1).cast("int"))
    target = F.when(F.col("k") % 23 == 0, F.col("k")).otherwise(F.col("k") * 7 % (F.col("m") + 3))
    refs = docs.crossJoin(F.broadcast(most)).select(F.col("path").alias("source_path"), "type", section.alias("relationship"), F.lit(0).alias("rel_ord"), F.lit(0).alias("ref_ord"), F.concat(F.lit("c"), target).alias("target"))
    aliases = docs.select(F.lower("path").alias("key"), "path")
    return docs, graph.resolve_references(refs, aliases, fold=F.lower)


@query("relationship_findings", f"""WITH {_DOCS}, kinds(relationship, want) AS (VALUES {', '.join(f"('{s}', '{w}')" for s, w in zip(_SECTIONS, [*NAMES, 'decision']))})
  SELECT 'relationship-target-type-mismatch' AS code, 'error' AS severity, source_path AS path, relationship, target FROM edges JOIN kinds USING (relationship) WHERE issue IS NULL AND to_type <> want
  UNION ALL SELECT 'relationship-target-superseded', 'warning', source_path, relationship, target FROM edges JOIN docs s ON s.path = source_path WHERE issue IS NULL AND to_retired AND NOT s.retired AND relationship <> 'supersedes'
  UNION ALL SELECT issue, CASE issue WHEN 'self-reference' THEN 'warning' ELSE 'error' END, source_path, relationship, target FROM edges WHERE issue IS NOT NULL""")
def relationship_findings(spark, sf):
    docs, edges = _customer_graph(spark, sf)
    none = spark.createDataFrame([], "source_path string, relationship string")
    found = graph.relationship_findings(docs, edges, none)
    return found.where("code not in ('relationship-cycle', 'duplicate-artifact-identifier')").select("code", "severity", "path", "relationship", "target")


@query("relationship_counts", f"WITH {_DOCS} SELECT relationship, count(*) AS n FROM edges GROUP BY 1")
def relationship_counts(spark, sf):
    return graph.relationship_counts(_customer_graph(spark, sf)[1])


@query("coverage_gaps", f"""WITH {_DOCS}, good AS (SELECT source_path AS a, resolved_path AS b FROM edges WHERE issue IS NULL), near AS (SELECT a, b FROM good UNION SELECT b, a FROM good),
  n AS (SELECT a, type FROM near JOIN docs ON path = b)
  SELECT 'unscheduled' AS gap, path FROM docs WHERE NOT retired AND type = 'requirement' AND path NOT IN (SELECT a FROM n WHERE type = 'roadmap')
  UNION ALL SELECT 'unapplied', path FROM docs WHERE NOT retired AND type = 'decision' AND path NOT IN (SELECT a FROM n WHERE type IN ('requirement', 'roadmap', 'design'))
  UNION ALL SELECT 'unscoped', path FROM docs WHERE NOT retired AND type = 'decision'""")
def coverage_gaps(spark, sf):
    docs, edges = _customer_graph(spark, sf)
    return graph.coverage(docs, edges)


@query("adjacency", f"WITH {_DOCS} SELECT source_path AS path, resolved_path AS other, relationship, 'out' AS direction FROM edges WHERE issue IS NULL UNION ALL SELECT resolved_path, source_path, relationship, 'in' FROM edges WHERE issue IS NULL")
def adjacency(spark, sf):
    return graph.adjacency(_customer_graph(spark, sf)[1])


@query("incoming_references", f"WITH {_DOCS} SELECT relationship, source_path AS id, source_path AS path FROM edges WHERE issue IS NULL AND resolved_path = 'C42'")
def incoming_references(spark, sf):
    docs, edges = _customer_graph(spark, sf)
    return graph.incoming(edges, docs, "C42").select("relationship", "id", "path")


@query("outgoing_references", f"WITH {_DOCS} SELECT relationship, list(target) AS targets FROM edges WHERE source_path = 'C23' GROUP BY 1")
def outgoing_references(spark, sf):
    return graph.outgoing(_customer_graph(spark, sf)[1], "C23")
