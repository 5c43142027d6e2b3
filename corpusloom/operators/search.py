"""Field-weighted keyword search with rank fusion, as one DataFrame pipeline.

``entries`` has path, id, type, title, tags, aliases, sections (heading, lines) and inbound.
Terms match by prefix; every distinct term must match some field. Statistics are those of the whole
corpus whatever the facets; ranks are over what matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import casefold, query_terms, search_tokens, term_frequency, term_hits
from corpusloom.sources.staging import staged

# Fixed: weights in the order in which a score is summed, and the constants of the formulas.
BOOSTS = {"id": 4.0, "title": 3.0, "path": 2.0, "heading": 1.5, "body": 1.0, "tags": 2.5}
TIERS = ["id", "title", "tags", "path", "heading", "body"]
K1, B, FUSION, GRAPH_WEIGHT = 1.2, 0.75, 60, 0.5
#: Ranges that a ranking is cut into.
QUANTILES = 128


def barrier(rows: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """``rows`` with more columns that are computed once for each row, whatever refers to them later.

    The optimizer would copy the expressions into every filter and projection above; it does not do so through a generator.
    """
    held = rows.select("*", F.explode(F.array(F.struct(*columns))).alias(name))
    return held.select(*rows.columns, f"{name}.*")


def field_tokens(entries: DataFrame) -> DataFrame:
    """``entries`` with the six token arrays ``t_id`` ... ``t_tags``."""
    join = lambda column: F.array_join(F.coalesce(column, F.array().cast("array<string>")), " ")
    return barrier(entries, [
        search_tokens(join(F.col("aliases"))).alias("t_id"),
        search_tokens(F.col("title")).alias("t_title"),
        search_tokens(F.col("path")).alias("t_path"),
        search_tokens(join(F.transform("sections", lambda s: s["heading"]))).alias("t_heading"),
        search_tokens(join(F.flatten(F.transform("sections", lambda s: s["lines"])))).alias("t_body"),
        search_tokens(join(F.col("tags"))).alias("t_tags"),
    ], "tokens")


def term_counts(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """Token arrays replaced by ``len_<field>`` and, for the k-th distinct term, ``tf_<k>_<field>``."""
    columns = [F.size(f"t_{f}").alias(f"len_{f}") for f in BOOSTS]
    columns += [term_frequency(F.col(f"t_{f}"), t).alias(f"tf_{k}_{f}") for k, t in enumerate(dict.fromkeys(terms)) for f in BOOSTS]
    return barrier(tokens, columns, "counts").drop(*(f"t_{f}" for f in BOOSTS))


def _runs(tokens: Column) -> Column:
    """``(token, tf)`` of each distinct token: the tokens in order, cut where they change."""
    size = F.size(tokens)
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(size))
    return F.when(size > 0, F.zip_with(starts, ends, lambda a, b: F.struct(F.get(tokens, a).alias("token"), (b - a).alias("tf"))))


def build_index(entries: DataFrame) -> dict[str, DataFrame]:
    """The tables of an inverted index of ``entries``, whose paths are unique; ``search`` takes them in place of the texts.

    ``documents``: the slim columns of an entry with ``len_<field>``. ``totals``: their number and the sums of lengths.
    ``postings(token, field, path, tf)``: a row for each distinct token of a field, in ranges by token and path, so
    that a frequent token is split and a prefix reads only the row groups that may hold it. Texts are tokenized once;
    counts are made inside a row, so the only shuffle is that of the ranges.
    """
    tokens = field_tokens(entries)
    slim = [c for c in entries.columns if c not in ("sections", "aliases")]
    ordered = barrier(tokens, [F.array_sort(f"t_{f}").alias(f"o_{f}") for f in BOOSTS], "ordered")
    runs = barrier(ordered, [_runs(F.col(f"o_{f}")).alias(f"r_{f}") for f in BOOSTS], "runs")
    held = staged(runs.select(*slim, *(F.size(f"t_{f}").alias(f"len_{f}") for f in BOOSTS), *(f"r_{f}" for f in BOOSTS)), "tokens")

    def named(f: str) -> Column:
        return F.transform(F.coalesce(f"r_{f}", F.array()), lambda r: F.struct(r["token"].alias("token"), F.lit(f).alias("field"), r["tf"].alias("tf")))

    rows = F.flatten(F.array(*map(named, BOOSTS)))
    postings = held.select("path", F.explode(rows).alias("p")).select("p.token", "p.field", "path", "p.tf")
    documents = held.drop(*(f"r_{f}" for f in BOOSTS))
    return {"documents": documents, "totals": documents.agg(*_totals()), "postings": postings.repartitionByRange("token", "path").sortWithinPartitions("token", "path")}


def indexed_counts(index: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """``path`` and the ``tf_<k>_<field>`` of ``term_counts`` for the documents that some term hits, from the postings."""
    distinct = list(dict.fromkeys(terms))
    starts = [F.col("token").startswith(t) for t in distinct]
    held = index["postings"].where(reduce(Column.__or__, starts) if starts else F.lit(False))
    sums = [F.sum(F.when(starts[k] & (F.col("field") == f), F.col("tf")).otherwise(0)).alias(f"tf_{k}_{f}") for k in range(len(distinct)) for f in BOOSTS]
    return held.groupBy("path").agg(*(sums or [F.count("*").alias("_")]))


def _hit(k: int, fields=tuple(BOOSTS)) -> Column:
    return reduce(Column.__or__, (F.col(f"tf_{k}_{f}") > 0 for f in fields))


def _totals() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(f"len_{f}").alias(f"s_{f}") for f in BOOSTS)]


def corpus_stats(counts: DataFrame, terms: list[str], totals: DataFrame | None = None) -> DataFrame:
    """One row: ``n``, mean lengths ``mean_<field>`` and ``df_<k>`` for the k-th distinct term, from ``term_counts``.

    A term that the query repeats counts its documents once per repeat. Lengths are summed as integers. With the
    ``totals`` of an index, ``counts`` need only hold the documents that some term hits.
    """
    found = [(F.count_if(_hit(k)) * terms.count(t)).alias(f"df_{k}") for k, t in enumerate(dict.fromkeys(terms))]
    if totals is None:
        one = counts.agg(*_totals(), *found)
    else:
        one = totals.crossJoin(F.broadcast(counts.agg(*found))) if found else totals  # one row each
    means = [F.coalesce(F.try_divide(F.col(f"s_{f}"), F.col("n")), F.lit(0.0)).alias(f"mean_{f}") for f in BOOSTS]
    return one.select("n", *means, *(c for c in one.columns if c.startswith("df_")))


def bm25f(terms: list[str]) -> Column:
    """The score of a row of ``term_counts`` with ``weighted_<k>``; terms are added in the query's order."""
    place = {t: k for k, t in enumerate(dict.fromkeys(terms))}
    score = F.lit(0.0)
    for term in terms:
        d, n, weighted = F.col(f"df_{place[term]}"), F.col("n"), F.col(f"weighted_{place[term]}")
        idf = F.log(1.0 + ((n - d) + 0.5) / (d + 0.5))
        score = score + F.when((d != 0) & (weighted > 0), idf * (weighted / (K1 + weighted))).otherwise(0.0)
    return score


def weighted_frequency(k: int) -> Column:
    """The k-th term's frequencies over normalised lengths, fields added in a fixed order, absent ones skipped."""
    weighted = F.lit(0.0)
    for field, boost in BOOSTS.items():
        tf, mean = F.col(f"tf_{k}_{field}"), F.col(f"mean_{field}")
        norm = F.when(mean > 0, (1.0 - B) + B * (F.col(f"len_{field}") / F.nullif(mean, F.lit(0.0)))).otherwise(1.0)
        weighted = weighted + F.when(tf > 0, boost * (tf / norm)).otherwise(0.0)
    return weighted


def matches(counts: DataFrame, terms: list[str]) -> DataFrame:
    """Rows that hold every distinct term somewhere, with the best ``tier`` (0-5) and its ``field``."""
    n = len(dict.fromkeys(terms))
    if not n:
        return counts.where("false").withColumns({"tier": F.lit(0), "field": F.lit("")})
    tier = F.coalesce(*(F.when(reduce(Column.__or__, (_hit(i, (f,)) for i in range(n))), k) for k, f in enumerate(TIERS)))
    found = counts.where(reduce(Column.__and__, (_hit(i) for i in range(n)))).withColumn("tier", tier)
    return found.withColumn("field", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1))


def first_hit(terms: list[str]) -> Column:
    """``struct(section, snippet)`` of the first section heading or body line that a term hits, by the winning tier."""
    hit = lambda text: reduce(Column.__or__, (term_hits(search_tokens(text), t) for t in dict.fromkeys(terms)))
    heading = F.filter("sections", lambda s: hit(s["heading"]))
    lines = F.flatten(F.transform("sections", lambda s: F.transform(s["lines"], lambda x: F.struct(s["heading"].alias("section"), x.alias("snippet")))))
    body = F.get(F.filter(lines, lambda x: hit(x["snippet"])), F.lit(0))
    top = F.get(heading, F.lit(0))["heading"]
    return F.when(F.col("field") == "heading", F.struct(top.alias("section"), top.alias("snippet"))).when(F.col("field") == "body", body)


def has_tags(wanted: list[str]) -> Column:
    """Whether all wanted tags are among a row's, compared whole and case-folded."""
    have = F.transform("tags", F.lower)
    return F.size(F.array_except(F.array(*(F.lit(w.casefold()) for w in wanted)), have)) == 0


def search(
    entries: DataFrame, query: str, type: str | None = None, tags: list[str] | None = None, live_only: bool = False,
    decisions_only: bool = False, snippets: bool = False, index: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Matches with ``bm25``, ``lexical_rank``, ``graph_rank``, ``fused``, ``tier``, ``field`` and ``position``.

    ``type``, ``tags`` and ``live_only`` (column ``retired``) filter before ranks are given; ``decisions_only`` keeps live
    decisions (column ``live_decision``) after, so their ranks keep gaps. A query without tokens matches nothing.
    With the ``index`` of the entries (``build_index``), texts are read for snippets alone.
    """
    terms = query_terms(query)
    if index is None:
        # texts are read once: statistics and scores come from the slim counts
        counts = staged(term_counts(field_tokens(entries), terms).drop("sections", "aliases"), "counts")
        found, stats = counts, corpus_stats(counts, terms)
    else:
        counts = indexed_counts(index, terms)
        found, stats = counts.join(index["documents"], "path"), corpus_stats(counts, terms, index["totals"])
    if type is not None or decisions_only:
        found = found.where(F.col("type") == (type or "decision"))
    if tags:
        folded = found.withColumn("tags", F.split(casefold(F.array_join("tags", "\x00")), "\x00"))
        found = folded.where(has_tags(tags))
    found = matches(found, terms)
    if live_only:
        found = found.where(~F.coalesce(F.col("retired"), F.lit(False)))
    scored = found.crossJoin(F.broadcast(stats))  # one row of statistics
    scored = barrier(scored, [weighted_frequency(k).alias(f"weighted_{k}") for k in range(len(set(terms)))] or [F.lit(0).alias("weighted_0")], "w")
    scored = scored.withColumn("bm25", bm25f(terms))
    drop = [c for c in scored.columns if c.startswith(("tf_", "len_", "mean_", "df_", "weighted_"))] + ["n"]
    # scores are evaluated once, for the ranks and for the rows
    ranked = fuse(staged(scored.drop(*drop), "scored"))
    if snippets:
        held = ranked.join(entries.select("path", "sections"), "path").withColumn("hit", first_hit(terms))
        ranked = held.withColumns({"section": F.col("hit.section"), "snippet": F.col("hit.snippet")}).drop("hit", "sections")
    if decisions_only:
        ranked = ranked.where("live_decision")
    return ranked


def _ranks(scored: DataFrame, names: dict[str, str]) -> DataFrame:
    """A column for each of ``names`` (rank to the column that it ranks): one plus the number of rows with a greater value.

    Approximate quantiles cut the values into ranges: one for each quantile itself, one for what lies between two. A
    value of many rows is a quantile, so its rows need no order and are dealt to many tasks; no other range holds more
    than a small share. The driver gets the quantiles and the number of rows in each range, whatever the input.
    """
    values = {rank: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for rank, c in names.items()}
    steps = [k / QUANTILES for k in range(QUANTILES + 1)]
    found = scored.agg(*(F.percentile_approx(v, steps, 20 * QUANTILES).alias(rank) for rank, v in values.items())).first()
    place = {}
    for rank, v in values.items():
        bounds = F.array(*(F.lit(x) for x in sorted(set(found[rank] or [0.0]))))
        place[rank] = F.size(F.filter(bounds, lambda b: b < v)) * 2 + F.array_contains(bounds, v).cast("int")
    held = barrier(scored, [v.alias(f"value_{rank}") for rank, v in values.items()] + [p.alias(f"range_{rank}") for rank, p in place.items()], "placed")
    parts = F.explode(F.array(*(F.struct(F.lit(rank).alias("rank"), F.col(f"range_{rank}").alias("range")) for rank in names)))
    rows = held.select(parts.alias("p")).groupBy("p.rank", "p.range").count().collect()
    for rank in names:
        above, total = [], 0
        for r in sorted((r for r in rows if r["rank"] == rank), key=lambda r: -r["range"]):
            above += [F.lit(r["range"]), F.lit(total)]
            total += r["count"]
        at = F.col(f"range_{rank}")
        deal = F.when(at % 2 == 1, F.pmod(F.xxhash64("path"), F.lit(QUANTILES))).otherwise(0)
        inside = F.rank().over(Window.partitionBy(at, deal).orderBy(F.desc(f"value_{rank}")))
        offset = F.element_at(F.create_map(*above), at) if above else F.lit(0)
        held = held.withColumn(rank, (inside + offset).cast("long"))
    return held.drop(*(f"{x}_{rank}" for x in ("value", "range") for rank in names))


def fuse(scored: DataFrame) -> DataFrame:
    """Competition ranks of ``bm25`` and ``inbound`` (null counts as 0), and their reciprocal-rank fusion."""
    ranked = _ranks(scored, {"lexical_rank": "bm25", "graph_rank": "inbound"})
    fused = 1.0 / (FUSION + F.col("lexical_rank")) + GRAPH_WEIGHT / (FUSION + F.col("graph_rank"))
    return ranked.withColumn("fused", fused)


def final_order(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.round("fused", 12).desc(), "path")


def postings(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """Paths that hold every term: each token names the terms it starts with, and a path must have them all. One pass, one shuffle of paths."""
    distinct = list(dict.fromkeys(terms))
    words = F.array_distinct(F.flatten(F.array(*(F.col(f"t_{f}") for f in TIERS))))
    held = F.array_distinct(F.flatten(F.transform(words, lambda w: F.filter(F.array(*map(F.lit, distinct)), lambda t: w.startswith(t)))))
    return tokens.where(F.size(held) == len(distinct)).select("path")


def indexed_postings(index: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """``postings`` from an index: paths with a token for every term."""
    n = len(dict.fromkeys(terms))
    return indexed_counts(index, terms).where(reduce(Column.__and__, map(_hit, range(n)), F.lit(n > 0))).select("path")
