"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other training text is unlabelled, whatever it
holds. With class prior p the risk of a score function is p R+(1) + max(0, R_u(0) - p R+(0)):
the unlabelled loss minus the part that hidden positives bring, never below zero. A logistic
model over word and word-beginning features is fitted in numpy by full-batch steps;
where the bracket is negative, the step goes against it, as the method prescribes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import bounded_batches
from corpusloom.llm.textscan import slices

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5)
THRESHOLD = 0.3  # fixed by the contract


class Model(NamedTuple):
    features: np.ndarray  # ascending uint32 hashes
    weights: np.ndarray
    bias: float


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    marks = [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]
    return [zlib.crc32(m.encode()) for m in marks]


def text_features(text: str | None) -> np.ndarray:
    """The distinct features of a whole text; none for null."""
    found: set[int] = set()
    for w in set(_WORD.findall((text or "").lower())):
        found.update(word_features(w))
    return np.fromiter(found, np.uint32, len(found))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be used: crc32 of the id as text mod 4 is 2, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """(rows, prior): bounded samples as ``(positive, mark, features)``, and the share of positives among labelled training rows.

    Rows are chosen by a hash of their id so that about ``positives`` toxic and ``unlabelled``
    other rows are expected; all of them where there are fewer. Unlabelled rows come from all
    training rows, labelled or not: their labels are not looked at.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    toxic, labelled = known.agg(F.count_if(F.col("toxic") == 1), F.count("toxic")).first()
    free = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id")))
    total = free.count()
    drawn = lambda seed, want, have: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, want / max(have, 1)) * (1 << 30))
    chosen = known.where((F.col("toxic") == 1) & drawn(1, positives, toxic)).select("doc_id", F.lit(True).alias("positive"))
    # about `positives` rows of 9 bytes, whatever the input: safe to broadcast
    rows = free.join(F.broadcast(chosen), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    rows = rows.withColumn("unlabelled", drawn(2, unlabelled, total)).where("positive or unlabelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.sort(text_features(t.as_py())).view(np.int32) for t in batch.column("text")]
            off = np.cumsum([0, *map(len, made)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *made])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("positive", "unlabelled", "mark")), lists],
                                             ["positive", "unlabelled", "mark", "features"])

    marked = rows.select("positive", "unlabelled", F.xxhash64("text", "doc_id").alias("mark"), "text")
    return marked.mapInArrow(run, "positive boolean, unlabelled boolean, mark long, features array<int>"), toxic / max(labelled, 1)


def select_features(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, most: int, least_count: int = 5) -> np.ndarray:
    """The ``most`` features that stand out most among positives against unlabelled texts."""
    everything, inverse = np.unique(np.concatenate([np.zeros(0, np.uint32), *rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    in_p = np.bincount(inverse, weights=positive[owner], minlength=len(everything))
    in_u = np.bincount(inverse, weights=unlabelled[owner], minlength=len(everything))
    n_p, n_u = max(positive.sum(), 1), max(unlabelled.sum(), 1)
    gain = (in_p / n_p - in_u / n_u) / np.sqrt((in_u + 1) / n_u / n_p)
    gain[in_p < min(least_count, n_p)] = 0
    best = np.argsort(-gain, kind="stable")[:most]
    return np.sort(everything[best[gain[best] > 5]])


def fit(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float,
        most: int = 1024, steps: int = 400, rate: float = 0.05, shrink: float = 0.3) -> Model:
    """The model of least non-negative risk. Weights shrink by ``shrink`` over the number of positives.

    Without positives or features it scores every text low.
    """
    features, decay = select_features(rows, positive, unlabelled, most), shrink / max(positive.sum(), 1)
    flat = np.concatenate([np.zeros(0, np.uint32), *rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.searchsorted(features, flat)
    hit = at < len(features)
    hit[hit] = features[at[hit]] == flat[hit]
    row, col = owner[hit], at[hit]
    w, bias = np.zeros(len(features)), -3.0
    prior = min(max(prior, 1e-4), 0.9)
    p, u = np.flatnonzero(positive), np.flatnonzero(unlabelled)
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1 if len(p) and len(u) and len(w) else 0):
        g = bias + np.bincount(row, weights=w[col], minlength=len(rows))
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        bracket = -np.log(1 - s[u] + 1e-12).mean() + prior * np.log(1 - s[p] + 1e-12).mean()
        slope = np.zeros(len(rows))
        slope[u] += s[u] / len(u)
        slope[p] -= prior * s[p] / len(p)
        if bracket < 0:
            slope = -slope
        else:
            slope[p] -= prior * (1 - s[p]) / len(p)
        grad = np.append(np.bincount(col, weights=slope[row], minlength=len(w)) + decay * w, slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(features, w, float(bias))


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000, **how) -> Model:
    """Fit on bounded samples; rows are put in a fixed order first, so equal samples give equal models."""
    sample, prior = training_sample(docs, labels, positives, unlabelled)
    table = sample.toArrow().sort_by([("mark", "ascending"), ("positive", "ascending")])
    flags = [table[c].to_numpy().astype(bool) for c in ("positive", "unlabelled")]
    return fit([x.values.to_numpy().view(np.uint32) for x in table["features"]], *flags, prior, **how)


def score_texts(texts: list[str | None], model: Model, cache: dict[str, tuple]) -> np.ndarray:
    """Scores in 0..1; a null or empty text has the bias alone. ``cache`` keeps the model's features of words."""
    place = {int(f): k for k, f in enumerate(model.features)}
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        hits: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            found = cache.get(word)
            if found is None:
                found = cache[word] = tuple(place[f] for f in word_features(word) if f in place)
            if found:
                hits.update(found)
        out[i] = model.bias + model.weights[sorted(hits)].sum()
    if len(cache) > 400_000:
        cache.clear()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> DataFrame:
    """``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` to ``(doc_id, held_out, score, predicted)``.

    Whole texts are scored, one row for each row; null and empty texts score the bias, about nothing. Rows
    with null ids are never trained on. Labels of an id that repeats count as toxic if one is. Only the
    text is an input of the score.
    """
    bounded_batches(docs.sparkSession)
    model = train(docs, labels, positives, unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                score = score_texts(part.column("text").to_pylist(), model, cache)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
