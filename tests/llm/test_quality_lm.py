import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import quality_lm as L
from corpusloom.llm import sidecar, textscan


def words_of(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", fold)


def brute(texts):
    """Interpolated modified Kneser-Ney by its definition: a function from (word before, word) to its probability."""
    pairs = Counter()
    for t in texts:
        w = [None, *words_of(t)]
        pairs.update(zip(w, w[1:]))
    follows = Counter(w for _, w in pairs)
    d, e = ([0.0, *L.discounts(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4)))] for c in (pairs, follows))
    total, left = Counter(), defaultdict(float)
    for (u, _), n in pairs.items():
        total[u] += n
        left[u] += d[min(n, 3)]
    share = sum(e[min(n, 3)] for n in follows.values()) / len(pairs)

    def p(u, w):
        n, k = pairs.get((u, w), 0), follows.get(w, 0)
        lower = (k - e[min(k, 3)]) / len(pairs) + share / (len(follows) + 1)
        return (n - d[min(n, 3)]) / total[u] + left[u] / total[u] * lower if total[u] else lower

    return p, sorted(follows, key=str)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    parts = ["the", "The", "of", "and,", "is", "É", "é", "A", "7", "-", "中", "x\x0b", "re\ntion", " "]
    return [" ".join(rng.choice(parts[: rng.randint(3, 14)]) for _ in range(rng.randint(0, 80))) for _ in range(n)] + [None, "", " \n"]


@pytest.mark.parametrize("chunk,slice_bytes", [(1 << 20, 1 << 19), (50, 40)])
def test_bits_are_those_of_the_definition(spark, tmp_path, monkeypatch, chunk, slice_bytes):
    monkeypatch.setattr(L, "CHUNK", chunk)
    whole = textscan.pieces
    monkeypatch.setattr(L, "pieces", lambda batch, column: whole(batch, column, slice_bytes))
    texts = corpus()
    more = texts + ["zzz Qq!", "中中 the of", "of " * 300, "q" * 500 + " of"]
    frame = lambda x: spark.createDataFrame([(i, t) for i, t in enumerate(x)], "doc_id long, text string").repartition(3)
    frame(texts).write.parquet(str(tmp_path / "a"))
    frame(more).write.parquet(str(tmp_path / "b"))
    model = L.train(spark.read.parquet(str(tmp_path / "a")))
    p, vocabulary = brute(texts)
    scored = L.perplexities(spark.read.parquet(str(tmp_path / "b")), model).collect()
    assert sorted(r.doc_id for r in scored) == list(range(len(more)))
    for r in scored:
        w = [None, *words_of(more[r.doc_id])]
        assert r.n_scored == len(w) - 1
        if len(w) == 1:
            assert r.bits is None
        else:
            assert abs(r.bits - -sum(math.log2(p(u, v)) for u, v in zip(w, w[1:])) / (len(w) - 1)) < 1e-9, r
    assert abs(sum(p("of", w) for w in vocabulary) + p("of", "unseen") - 1) < 1e-9


def test_blobs_and_codes_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 500, np.uint64))
    numbers = [rng.integers(0, 2**40, len(keys)).astype(np.uint64) for _ in range(2)]
    for k in (0, 1, len(keys)):
        got = L.unpack(L.pack(keys[:k], *(x[:k] for x in numbers)))
        assert [x.tolist() for x in got] == [keys[:k].tolist(), *(x[:k].tolist() for x in numbers)]
    assert (textscan.unmix(textscan.mix(keys)) == keys).all()
    code, doc = L.pair_codes(pa.array(["a B", "", None, "b"]))
    assert doc.tolist() == [0, 0, 3] and code[0] >> np.uint64(32) == 0 == code[2] >> np.uint64(32)
    assert code[1] >> np.uint64(32) == code[0] & np.uint64(2**32 - 1) and (code[1] ^ code[2]) & np.uint64(2**32 - 1) == 0


def test_a_very_long_text_is_cut_into_parts(monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 60_000)
    rng = random.Random(2)
    text = " ".join(rng.choice(["a", "bb", "ccc", "d" * 2000]) for _ in range(200_000))
    batch = pa.RecordBatch.from_arrays([pa.array(["x y", text, "z"])], ["text"])
    code, doc = L.pair_codes(batch.column(0))
    parts = list(L.chunks(iter([batch]), ["text"]))
    assert len(parts) > 1 and max(len(p[0]) for p in parts) <= 60_000
    assert (np.concatenate([p[0] for p in parts]) == code).all() and (np.concatenate([np.repeat(p[1], p[2]) for p in parts]) == doc).all()
    assert [len(rows) for p in parts for rows in p[3]] == [1, 1, 1]


def test_scans_that_differ_are_told(spark, tmp_path):
    spark.range(10).selectExpr("id AS doc_id").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert sidecar.repeatable(docs.where("doc_id > 1"), "t").inputFiles() == docs.inputFiles()
    assert sidecar.repeatable(docs.orderBy("doc_id"), "t").inputFiles() != docs.inputFiles()
    path = sidecar.keep(sidecar.numbered(docs, "doc_id").where("at % 4 = 1").selectExpr("*", "1L AS mark"), "at")
    marks = sidecar.Marks(path, 0)
    assert marks.of(pa.array(range(5)), 0).tolist() == [0, 1, 0, 0, 0] and marks.of(pa.array(range(5, 10)), 5).tolist() == [1, 0, 0, 0, 1]
    with pytest.raises(RuntimeError):
        marks.of(pa.array([0, 7, 2]), 0)


def test_classifier_keeps_clean_and_drops_junk(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    rows = []
    for i in range(400):
        t = " ".join(rng.choice(words) for _ in range(60))
        rows.append((i, t.upper().replace(" ", "!! ") if i % 10 == 9 else t, "en" if i % 2 else None, "clash"))
    rows += [(1, rows[1][1], "en", "x"), (900, None, "en", "x"), (901, "", "xx", "x"), (None, rows[2][1], "yy", "x"), (902, rows[0][1] * 500, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits string")
    ids = spark.createDataFrame([(i,) for i in range(400) if i % 10 != 9 and i % 3] + [(None,), (1,)], "doc_id long")
    got = L.quality_classifier(docs, ids, quantile=1.0).collect()
    assert len(got) == len(rows)
    lost = 0
    for r in got:
        if r.doc_id in (900, 901):
            assert not r.kept and r.perplexity is None
        elif r.doc_id is not None and r.doc_id < 400 and r.doc_id % 10 == 9:
            assert not r.kept
        else:
            lost += not r.kept
    assert lost <= 5  # of documents that the limits do not come from
    kept = L.keep_documents(docs, ids, quantile=1.0)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    nothing = L.quality_classifier(docs, ids.limit(0)).where("doc_id < 400").collect()
    assert all(r.kept for r in nothing)
    assert L.quality_classifier(docs.limit(0), ids).collect() == []


def test_registered_limit_is_a_quantile_of_the_trusted(spark, tmp_path):
    from corpusloom.llm.queries import op6_quality_lm

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = op6_quality_lm(spark, str(tmp_path)).collect()
    held = [i for i, f in spark.range(400).selectExpr("id", "pmod(xxhash64(id), 5) = 0").collect() if f]
    bits = sorted(r.perplexity for r in got if r.doc_id in held)
    # more than 99 % of the held-out documents are within the limit, which is the largest or second largest of them
    assert len(bits) > 60 and all(bits[-2] <= r.most <= bits[-1] * 1.001 for r in got)
    assert sum(r.kept for r in got) >= 390
