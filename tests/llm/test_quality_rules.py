import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import quality_rules as Q
from corpusloom.llm.textscan import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, min_repeat):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) for k in range(3) if win[tuple(w[i : i + 3])] > 1}
    covered, longest = set(), 0
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j:
                k = 0
                while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                if k >= min_repeat:
                    longest = max(longest, k)
                    covered.update(range(i, i + k))
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
        len(covered), longest,
    )


def texts():
    rng = random.Random(5)
    out = [None, "", "   ", "a", "\n\n", "a b c", "a b c a b c", "x " * 60, "é|é\té\n é|é\té", "l1 a\nl1 a\n l1 a\nl1 a"]
    for _ in range(60):
        vocab = [rng.choice("abcdefgé#") * rng.randint(1, 3) for _ in range(rng.randint(1, 8))]
        sep = [" ", "\n", "  ", "\t", " ", "\r\n"]
        out.append("".join(rng.choice(vocab) + rng.choice(sep) for _ in range(rng.randint(0, 70))))
    return out


@pytest.mark.parametrize("min_repeat", [1, 3, 8])
def test_counts_against_brute_force(min_repeat):
    t = texts()
    got = Q.measure(pa.array(t, pa.string()), min_repeat)
    assert [tuple(int(got[k][i]) for k in got) for i in range(len(t))] == [brute(x, min_repeat) for x in t]


@pytest.mark.parametrize("limit", [1, 7, 40])
def test_one_long_text_in_parts(limit):
    for x in filter(None, texts()):
        got = Q.measure(pa.array([x], pa.string()), 3, limit)
        assert tuple(int(v[0]) for v in got.values()) == brute(x, 3)
        assert list(got) == list(Q.measure(pa.array([x, x]), 3))


def test_slices_keep_every_row_and_split_at_the_limit():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"] * 7})
    parts = list(slices(batch, "text", 50))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and len(parts) > 7


def test_operator_on_edge_rows(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    rows = [(1, clean, "a"), (1, clean, "b"), (None, clean, None), (2, None, "c"), (3, "", "d"), (4, "x " * 90, "e"),
            (5, clean + " " + clean, "f"), (6, "long " + " ".join(map(str, range(40000))), "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in Q.quality_rules(df).collect())
    assert got == [(0, 80, False, True), (1, 80, False, True), (1, 80, False, True), (2, 0, True, False), (3, 0, True, False),
                   (4, 90, True, False), (5, 160, True, False), (6, 40001, False, True)]
    assert Q.quality_rules(df.limit(0)).collect() == []


def test_method_rejects_what_base_passes(spark):
    words = [f"u{i}" for i in range(400)]
    block = " ".join(words[:110])
    df = spark.createDataFrame([(1, " ".join(words) + " " + block), (2, " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept, r.longest_repeat) for r in Q.quality_rules(df).collect()}
    assert got == {1: (False, False, 110), 2: (False, True, 0)}


def test_long_repeats_are_exact():
    t = " ".join(["a"] * 1000)
    got = Q.measure(pa.array([t]), 8)
    assert got["longest_repeat"][0] == 999 and got["covered_words"][0] == 1000 and np.all(got["n_repeat_words"] == 1000)
