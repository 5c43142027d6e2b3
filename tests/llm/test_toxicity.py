import random
import zlib

import numpy as np

from corpusloom.llm import toxicity as T


def made(seed, n, toxic_share=0.3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < toxic_share
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty" + rng.choice("xyz"), "Foul"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = made(1, 900)
    extra = [(None, "vile nastyx foul", "en"), (5000, None, "en"), (5001, "", "en"), (0, rows[0][1], "en"), (5002, "abc " * 50000, "de")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string")
    lab = spark.createDataFrame([(*x, 1) for x in labels] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, predicted int")
    got = T.toxicity(docs, lab).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(labels)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(test) > 150 and np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[5000].score == by[5001].score and by[5000].predicted == by[5002].predicted == 0


def test_held_out_labels_change_nothing(spark):
    rows, labels = made(2, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = []
    for flip in (False, True):
        lab = [(i, 1 - t if flip and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
        model = T.train(docs, spark.createDataFrame(lab, "doc_id long, toxic int"))
        out.append((model.features.tolist(), model.weights.tolist(), model.bias))
    assert out[0] == out[1]


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame(made(3, 20)[0], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in T.toxicity(docs, none).collect()} == {0}
    assert T.toxicity(docs.limit(0), none).collect() == []


def test_hidden_positives_do_not_pull_the_scores_down():
    rng = np.random.default_rng(0)
    n = 2000
    toxic = rng.random(n) < 0.4
    rows = [np.unique(np.append(rng.integers(100, 5000, 20), 7 if t else 100)).astype(np.uint32) for t in toxic]
    positive = toxic & (rng.random(n) < 0.2)
    model = T.fit(rows, positive, ~positive | positive, 0.4)
    assert 7 in model.features.tolist()
    k = model.features.tolist().index(7)
    assert model.bias + model.weights[k] > 1 and model.bias < -1
