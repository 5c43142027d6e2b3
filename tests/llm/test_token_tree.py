import random

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from test_token_records import hard_texts

from corpusloom.llm import token_tree as T

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return T.Counter.load(PATH, P.PATTERN)


def check(tree, text, counter):
    assert tree.text() == text
    assert [p for x, _ in tree.leaves for p in x] == counter.pieces(text), repr(text)
    assert tree.tokens == len(counter.library.encode_ordinary(text))


def test_edits_of_hard_texts(counter, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(T, "LEAF", 3)
    parts = [" ", "  ", "\n", "a", "tion", "é", "1", "'", "r", "e", "s", "!", "'re", "　", "", "\t ", "中", "ve"]
    for text in hard_texts()[:1500]:
        tree = T.TokenTree.of(counter, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + rng.choice([0, 1, 3, 30])))
            new = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            check(tree, text, counter)


def test_many_edits_at_once_and_growth(counter):
    rng = random.Random(7)
    text = " ".join("word%d" % rng.randint(0, 99) for _ in range(5000))
    tree = T.TokenTree.of(counter, text)
    edits = [(a, a + 3, "x y" * rng.randint(0, 2)) for a in range(0, len(text) - 10, 97)]
    n = tree.apply(edits)
    for a, b, new in reversed(edits):
        text = text[:a] + new + text[b:]
    check(tree, text, counter)
    assert n < 10 * len(edits)
    for _ in range(30):
        tree.edit(500, 500, " more text" * 60)
        text = text[:500] + " more text" * 60 + text[500:]
    check(tree, text, counter)
    for a in (0, 10, 777, len(text)):
        want, at = 0, 0
        for p in counter.pieces(text):
            at += len(p)
            want += len(counter.library.encode_ordinary(p)) if at <= a else 0
        assert tree.tokens_before(a) == want


def test_long_text_is_edited_locally(counter):
    tree = T.TokenTree.of(counter, "the cat sat on 12 mats. " * 20000)
    assert tree.edit(100_000, 100_003, "dog") < 20


def test_counts_of_documents(spark, counter):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1), (0, "", 1), (0, "mail a.b@c.de now +1 (456) 555-2186", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    size = lambda t: len(counter.library.encode_ordinary(t))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_edits, r.n_tokens_edited) for r in T.count_tokens(df, PATH, P.PATTERN).collect())
    want = sorted((str(d), size(t or ""), len(T.REDACTED.findall(t or "")), size(T.REDACTED.sub(T.REPLACEMENT, t or ""))) for d, t, _ in rows)
    assert got == want and sum(w[2] for w in want) > 5
    assert T.count_tokens(df.limit(0), PATH, P.PATTERN).collect() == []


def test_kept_trees_take_edits(spark, counter):
    rows = [(1, "one two  three", "x"), (2, None, "x"), (3, "x" * 10000 + " end", "x"), (4, "kept", "x")]
    trees = T.build_trees(spark.createDataFrame(rows, "doc_id long, text string, pieces string"), PATH, P.PATTERN)
    edits = [(1, 0, 3, "1"), (1, 2, 5, None), (1, 90, 99, "!"), (2, 0, 9, "new"), (3, None, 2, "no"), (9, 0, 1, "no"), (None, 0, 1, "no")]
    got = {r.doc_id: ("".join(r.pieces), sum(r.counts)) for r in
           T.apply_edits(trees, spark.createDataFrame(edits, "doc_id long, start int, end int, new string"), PATH, P.PATTERN).collect()}
    want = {1: "1wo  three!", 2: "new", 3: rows[2][1], 4: "kept"}
    assert got == {d: (t, len(counter.library.encode_ordinary(t))) for d, t in want.items()}
