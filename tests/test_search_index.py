"""The inverted index against a search of the texts, and ranks by ranges against counting."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search as S
from corpusloom.sources import index as store

SCHEMA = "path string, id string, type string, title string, tags array<string>, aliases array<string>, sections array<struct<heading: string, lines: array<string>>>, inbound long, retired boolean, live_decision boolean"


@pytest.fixture(scope="module")
def entries(spark):
    rng, words = random.Random(5), ["store", "stored", "token", "tokenRefresh", "DEC-1", "straße", "the", "", "a b"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [
        (f"d{k % 3}/e-{k}.md", f"E-{k}", rng.choice(["decision", "requirement"]), None if k % 7 == 0 else text(3), rng.choice([None, [], ["x", "the"]]), [f"E-{k}"],
         rng.choice([None, [], [(text(2), [text(rng.randrange(9)) for _ in range(4)])]]), k % 4, k % 5 == 0, k % 2 == 0)
        for k in range(60)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(entries, spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index") / "search")
    assert store.current(spark, root, "x") is None
    store.publish(root, S.build_index(entries), "x")
    assert store.current(spark, root, "y") is None
    return store.current(spark, root, "x")


@pytest.mark.parametrize("query, how", [("sto tok", {}), ("the the e", {"type": "decision"}), ("store", {"live_only": True, "tags": ["X"]}), ("store zebra", {}), ("e", {"decisions_only": True}), ("...", {})])
def test_index_finds_what_the_texts_give(entries, index, query, how):
    columns = ["path", "tier", "field", "bm25", "lexical_rank", "graph_rank", "fused"]
    plain = S.search(entries, query, **how).select(*columns).orderBy("path").collect()
    assert S.search(entries, query, index=index, **how).select(*columns).orderBy("path").collect() == plain


def test_postings(entries, index):
    tokens = S.field_tokens(entries)
    want = tokens.select("path", F.explode(F.split(F.concat_ws(" ", *(f"t_{f}" for f in S.BOOSTS)), " ")).alias("token")).where("token <> ''").groupBy("path", "token").count().collect()
    have = index["postings"].groupBy("path", "token").agg(F.sum("tf").alias("count")).collect()
    assert sorted(map(tuple, have)) == sorted(map(tuple, want))
    for terms in (["sto"], ["sto", "tok"], []):
        assert sorted(S.indexed_postings(index, terms).collect()) == (sorted(S.postings(tokens, terms).collect()) if terms else [])


def test_index_of_nothing(entries):
    index = S.build_index(entries.where("false"))
    assert S.search(entries, "store", index=index).collect() == []


def test_ranks_count_greater_values(spark):
    rng = random.Random(9)
    rows = [(f"p{k}", rng.choice([0.0, 0.0, 1.5, rng.random()]), rng.choice([None, 0, 0, 7, rng.randrange(999)])) for k in range(900)]
    got = S.fuse(spark.createDataFrame(rows, "path string, bm25 double, inbound long")).collect()
    assert len(got) == 900
    for r in got:
        assert r.lexical_rank == 1 + sum(x[1] > r.bm25 for x in rows)
        assert r.graph_rank == 1 + sum((x[2] or 0) > (r.inbound or 0) for x in rows)
