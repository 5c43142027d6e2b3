import random

import public_tokenizers as P
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusloom.llm import byte_bpe, quality_lm, quality_rules
from corpusloom.llm.queries import trusted
from test_ngram_join import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus(seed=9, n=260):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if i % 13 == 12:
            t = [w.upper() + "!!" for w in t]
        if i % 7 == 0 and i % 13 != 12 and rows:
            t = rng.choice([r for r in rows if "!!" not in r[1]] or [rows[0]])[1].split(" ")
            if rng.random() < 0.7:
                t[rng.randrange(len(t))] = "changed"
        if i % 17 == 0:
            t = t[:10] * 9
        rows.append((i, " ".join(t), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), 0, "x"))
    return rows + [(None, " ".join(words[:60]), "en", "a", None, None), (3000, None, "en", "a", 1, "y"), (3001, "", None, None, 1, "y"), rows[40], rows[41]]


@pytest.fixture()
def tables(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int(r[0] % 13 != 12), 0) for r in rows if r[0] is not None and r[0] % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, str(tmp_path)


def test_stages_against_brute_force(spark, tables):
    rows, where = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    key = lambda r: tuple(map(str, r))

    stage = dict(corpus_pipeline.STAGES)
    ruled = stage["quality_rules"](spark, docs, where)
    good = quality_rules.judge(pa.array([r[1] for r in rows]))["kept"]
    assert sorted(map(key, ruled.collect())) == sorted(key(r) for r, k in zip(rows, good) if k)
    assert ruled.schema == docs.schema

    classed = stage["quality_classifier"](spark, ruled, where)
    verdict = quality_lm.quality_classifier(ruled, trusted(spark, where)).where("kept")
    assert sorted(str(r.doc_id) for r in classed.collect()) == sorted(str(r.doc_id) for r in verdict.collect())
    assert not any("!!" in r.text for r in classed.collect()) and classed.count() > 120 and classed.schema == docs.schema

    kept = [tuple(r) for r in classed.collect()]
    one = [tuple(r) for r in stage["ngram_join"](spark, classed, where).collect()]
    sets = [shingle_set(r[1]) for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, r in zip(group, kept):
        least[g] = min(least.get(g, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(map(key, one)) == sorted(map(key, least.values())) and len(one) < len(kept)

    joined = spark.createDataFrame(one, docs.schema)
    mixed = stage["mixing"](spark, joined, where)
    assert sorted(map(key, mixed.collect())) == sorted(map(key, one)) and mixed.schema == docs.schema

    model = byte_bpe.Bpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    out = {str(r.doc_id): model.decode(r.ids).decode() for r in corpus_pipeline.run(spark, where).collect()}
    assert out == {str(r[0]): r[1] for r in one}


def test_stages_take_empty_tables(spark, tables):
    _, where = tables
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs2 = stage(spark, docs, where)
        assert docs2.collect() == []


def test_mixing_repeated_rows_and_order(spark, tables):
    rows, where = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    from corpusloom.llm import mixing

    mixed = [r.doc_id for r in mixing.mixed_documents(docs, 3, block_bytes=500).collect()]
    assert len(mixed) == len(rows)
    slots = {}
    for r in mixing.mix_sources(docs, block_bytes=500).collect():
        slots[r.doc_id] = min(slots.get(r.doc_id, (r.slot, r.offset)), (r.slot, r.offset))
    order = [slots[d] for d in mixed]
    assert order == sorted(order)


def test_run_tells_the_order_of_the_mix(spark, tables, monkeypatch):
    rows, where = tables
    docs = spark.createDataFrame([(i, "word " * (1 + i % 7 * (i % 60)), "en", "abc"[i % 3], 0, "x") for i in range(600)], SCHEMA)
    from corpusloom.llm import mixing

    whole = mixing.mix_sources
    monkeypatch.setattr(mixing, "mix_sources", lambda d, **how: whole(d, **{"block_bytes": 500} | how))
    stages = [("mixing", corpus_pipeline.mix), corpus_pipeline.STAGES[-1]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    path = f"{where}/mix"
    docs.write.parquet(f"{path}/documents.parquet")
    got = sorted(corpus_pipeline.run(spark, path).collect(), key=lambda r: [r[c] for c in corpus_pipeline.PLACE])
    slots = {r.doc_id: (r.slot, r.offset) for r in whole(docs, block_bytes=500).collect()}
    assert [r.doc_id for r in got] == sorted(slots, key=slots.get) and len({r.part for r in got}) > 1
