"""Quality classifier: an interpolated modified Kneser-Ney model over word pairs.

The model is trained on trusted text and grows with it: it holds every pair of words of that text. It is never gathered.
Its counts lie in shards of the key space, one Parquet row for a shard:

1. ``train``: a bounded chunk of trusted texts sends each of its distinct pairs once, with its count, to the pair's
   shard; the shards send what they know of a word (contexts, continuations) to the word's shard.
2. ``perplexities``: a chunk of documents asks the shards for its distinct pairs and words, once each. The shards join
   the questions with their counts. The answers come back beside the scan (``sidecar``), so texts never move.
3. A document's limit is a quantile of held-out trusted documents of its own language: the model has not
   seen them, so their perplexities are those of unseen clean text.

A word is a run of bytes other than white space, A-Z lower-cased, known by 32 bits of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import sidecar
from corpusloom.llm.shingles import shard_bounds
from corpusloom.llm.store import bounded_batches, materialize
from corpusloom.llm.textscan import Scan, mix, pieces, unmix

CHUNK = 3 << 20  # words that a chunk of documents holds in memory
SHARD_BYTES = 32 << 20  # of text, for each shard
ASKED_BITS = 48  # of a pair's key, in questions
BIN = 1000  # bins of log-perplexity per bit, for quantiles
TRAINED, HELD_OUT = 1, 2
_U = np.uint64
_WORD = _U(0xFFFFFFFF)
_POST = "shard long, part int, chunk int, data binary"
_MODEL = "shard long, data binary, c1 long, c2 long, c3 long, c4 long, types long, words long"


def pack(keys: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Ascending keys, as steps, and as many numbers for each as one compressed blob."""
    head = np.array([len(keys), len(numbers), keys[0] if len(keys) else 0], _U)
    planes = [np.ascontiguousarray(x, _U).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (np.diff(keys), *numbers)]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, numbers, first = (int(x) for x in np.frombuffer(raw, _U, 3))
    out, at = [], 24
    for k in range(numbers + 1):
        size = n if k else max(n - 1, 0)
        out.append(np.frombuffer(raw, np.uint8, size * 8, at).reshape(8, size).T.copy().view(_U).ravel())
        at += size * 8
    keys = np.full(n, first, _U)
    keys[1:] += np.cumsum(out[0], dtype=_U)
    return [keys, *out[1:]]


def pair_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code, doc) of every word: the word before in the upper 32 bits, 0 at the text's start, and the word in the lower."""
    scan = Scan(texts)
    word = np.maximum(scan.words(lower=True) >> _U(32), _U(1))
    before = np.zeros(len(word), _U)
    same = scan.doc[1:] == scan.doc[:-1]
    before[1:][same] = word[:-1][same]
    return before << _U(32) | word, scan.doc


def chunks(batches: Iterator[pa.RecordBatch], columns: list[str] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """(codes, rows, words of each of these rows, ``columns`` of the rows that end here) of bounded runs of words.

    Rows are numbered over the partition. A long text is cut between words, so it may lie in several chunks.
    """
    codes, rows, sizes, total, ended, at, before = [], [], [], 0, [], 0, _U(0)

    def joined() -> tuple:
        out = np.concatenate(codes), np.concatenate(rows), np.concatenate(sizes), ended.copy()
        for held in (codes, rows, sizes, ended):
            held.clear()
        return out

    for batch in batches:
        for part, texts, last, opened in pieces(batch, "text"):
            code, doc = pair_codes(texts)
            before = before if opened else _U(0)
            if len(code):
                code[0] |= before << _U(32)
                before = code[-1] & _WORD
            if codes and total + len(code) > CHUNK:
                yield joined()
                total = 0
            codes.append(code)
            rows.append(np.arange(at, at + len(texts)))
            sizes.append(np.bincount(doc, minlength=len(texts)))
            total += len(code)
            if last:
                ended += [part.select(columns)] if columns else []
                at += len(part)
    if codes:
        yield joined()


def _split(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return code >> _U(32), code & _WORD


def _posts(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["shard", "part", "chunk", "data"])


def _classes(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _row(shard: int, data: bytes, classes: list[int], types: int, words: int) -> pa.Table:
    names = ["shard", "data", "c1", "c2", "c3", "c4", "types", "words"]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 6]
    return pa.table([pa.array([x], t) for x, t in zip([shard, data, *classes, types, words], kinds)], names)


def _summed(tables: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Keys of all, and the sums of their numbers."""
    keys, inverse = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
    out = [keys]
    for k in range(1, len(tables[0])):
        out.append(np.bincount(inverse, np.concatenate([t[k] for t in tables]), len(keys)).astype(_U))
    return out


def discounts(c1: int, c2: int, c3: int, c4: int) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    plain = [0.5, 1.0, 1.5]
    if not (c1 and c2 and c3):
        return plain
    y = c1 / (c1 + 2 * c2)
    found = [1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3]
    return [min(max(f, 0.05), k + 0.95) for k, f in enumerate(found)] if min(found) > 0 else plain


@dataclass
class Model:
    """``table(shard, data, ...)``: pair shards, then as many word shards; and the numbers that all probabilities need."""

    table: DataFrame
    shards: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    types: int  # distinct pairs
    rest: float  # probability of a word that no text has: the lowest order's share, spread evenly

    def bits(self, code: np.ndarray, n: np.ndarray, words: np.ndarray, total, ones, twos, more, follows) -> np.ndarray:
        """-log2 of the probability of pairs seen ``n`` times; the rest are counts of the ascending ``words``."""
        before, word = (np.searchsorted(words, x) for x in _split(code))
        d, e = self.pair_discounts, self.word_discounts
        left = d[1] * ones + d[2] * twos + d[3] * more
        gamma = np.where(total > 0, left / np.maximum(total, 1), 1.0)
        lower = np.maximum(follows - e[np.minimum(follows, 3)], 0) / max(self.types, 1) + self.rest
        higher = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total[before], 1)
        return -np.log2(higher + gamma[before] * lower[word])


def _shards(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def train(docs: DataFrame, marks: str | None = None) -> Model:
    """A model of all texts of ``docs(doc_id, text)``, or of those with the mark ``TRAINED``; null texts count as empty."""
    shards = _shards(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = sidecar.partition_of(batches)
        held = sidecar.Marks(marks, part)

        def chosen() -> Iterator[pa.RecordBatch]:
            at = 0
            for batch in batches:
                yield batch if marks is None else batch.filter(pa.array(held.of(batch.column("doc_id"), at) == TRAINED))
                at += len(batch)

        for k, (code, *_) in enumerate(chunks(chosen())):
            code, n = np.unique(code, return_counts=True)
            key = mix(code)
            order = np.argsort(key)
            key, n = key[order], n[order].astype(_U)
            yield _posts((s, part, k, pack(key[a:b], n[a:b])) for s, a, b in shard_bounds(key, 64, shards))

    def pairs(table: pa.Table) -> pa.Table:
        key, n = _summed([unpack(b.as_py()) for b in table["data"]])
        return _row(table["shard"][0].as_py(), pack(key, n), _classes(n), len(key), 0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("data")):
                key, n = unpack(blob.as_py())
                before, word = _split(unmix(key))
                every, at = np.unique(np.concatenate([before, word]), return_inverse=True)
                a, b = at[: len(key)], at[len(key) :]
                sums = lambda x, where: np.bincount(where, x, len(every)).astype(_U)
                numbers = [sums(n, a), *(sums(hit, a) for hit in (n == 1, n == 2, n > 2)), sums(None, b)]
                yield _posts((shards + s, 0, shard, pack(every[x:y], *(v[x:y] for v in numbers))) for s, x, y in shard_bounds(every, 32, shards))

    def merged(table: pa.Table) -> pa.Table:
        found = _summed([unpack(b.as_py()) for b in table["data"]])
        follows = found[-1]
        return _row(table["shard"][0].as_py(), pack(*found), _classes(follows), int(follows.sum()), int((follows > 0).sum()))

    bounded_batches(docs.sparkSession)
    counted = materialize(sidecar.scanned(docs, "doc_id", "text").mapInArrow(count, _POST).groupBy("shard").applyInArrow(pairs, _MODEL), "pairs")
    known = materialize(counted.select("shard", "data").mapInArrow(words, _POST).groupBy("shard").applyInArrow(merged, _MODEL), "words")
    sums = [df.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("c1", "c2", "c3", "c4", "types", "words"))).first() for df in (counted, known)]
    d, e = (np.array([0.0, *discounts(*s[:4])]) for s in sums)
    c1, c2, c3, _, types, size = sums[1]
    left = (e[1] * c1 + e[2] * c2 + e[3] * (size - c1 - c2)) / types if types else 1.0
    return Model(counted.unionByName(known), shards, d, e, types, left / (size + 1))


def perplexities(docs: DataFrame, model: Model, marks: str | None = None) -> DataFrame:
    """``docs`` with ``n_scored`` (words), ``bits`` (per word, null without any), ``mark`` and ``place(part, at)`` instead of ``text``.

    ``docs`` is scanned twice; give it through ``sidecar.repeatable``.
    """
    shards = model.shards

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = sidecar.partition_of(batches)
        for k, (code, *_) in enumerate(chunks(batches)):
            code = np.unique(code)
            key = np.sort(mix(code)) >> _U(64 - ASKED_BITS)
            word = np.unique(np.concatenate(_split(code)))
            yield _posts((s, part, k, pack(key[a:b])) for s, a, b in shard_bounds(key, ASKED_BITS, shards))
            yield _posts((shards + s, part, k, pack(word[a:b])) for s, a, b in shard_bounds(word, 32, shards))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.Table.from_batches([_posts([])])
        shard = asked["shard"][0].as_py()
        keys, *numbers = unpack(known["data"][0].as_py()) if len(known) else [np.zeros(0, _U)] * (2 if shard < shards else 6)
        keys = np.append(keys >> _U(64 - ASKED_BITS) if shard < shards else keys, ~_U(0))

        def found(blob: bytes) -> bytes:
            (wanted,) = unpack(blob)
            at = np.searchsorted(keys, wanted)
            hit = keys[at] == wanted
            return pack(np.zeros(len(wanted), _U), *(np.where(hit, np.append(x, _U(0))[at], _U(0)) for x in numbers))

        return pa.Table.from_batches([_posts(
            (shard, p, c, found(b.as_py())) for p, c, b in zip(asked["part"].to_pylist(), asked["chunk"].to_pylist(), asked["data"])
        )])

    bounded_batches(docs.sparkSession)
    asked = sidecar.scanned(docs, "text").mapInArrow(ask, _POST)
    joined = asked.groupBy("shard").cogroup(model.table.select("shard", "data").groupBy("shard")).applyInArrow(answer, _POST)
    path = sidecar.keep(joined, "chunk", "shard")
    others = [c for c in docs.columns if c != "text"]
    bare = Model(None, shards, model.pair_discounts, model.word_discounts, model.types, model.rest)

    def answers(part: int) -> Iterator[tuple[list, list]]:
        """The pair counts and word counts of one chunk after the other."""
        now, held = 0, ([], [])
        for batch in sidecar.facts_of(path, part, ["chunk", "shard", "data"]):
            for chunk, shard, blob in zip(batch.column("chunk").to_pylist(), batch.column("shard").to_pylist(), batch.column("data")):
                if chunk != now:
                    yield held
                    now, held = chunk, ([], [])
                held[shard >= shards].append(unpack(blob.as_py())[1:])
        yield held

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = sidecar.partition_of(batches)
        first, rest = 0, (0.0, 0)
        replies, held = answers(part), sidecar.Marks(marks, part)
        for code, row, size, ended in chunks(batches, others):
            code, at = np.unique(code, return_inverse=True)
            at = at.astype(np.int32)
            order = np.argsort(mix(code)).astype(np.int32)
            words = np.unique(np.concatenate(_split(code)))
            n, counts = next(replies, ([], []))
            if sum(len(x[0]) for x in n) != len(code) or sum(len(x[0]) for x in counts) != len(words):
                raise RuntimeError("the rows of this partition differ between two scans")
            bits = np.zeros(len(code))
            if len(code):
                seen = np.empty(len(code), np.int64)
                seen[order] = np.concatenate([x[0] for x in n])
                known = [np.concatenate([x[k] for x in counts]).astype(np.int64) for k in range(5)]
                del n, counts, order
                for a in range(0, len(code), 1 << 18):
                    bits[a : a + (1 << 18)] = bare.bits(code[a : a + (1 << 18)], seen[a : a + (1 << 18)], words, *known)
            # the rows of a chunk follow each other; the last may go on in the next one
            cuts = np.concatenate([[0], np.cumsum(size)])
            number = np.bincount(row - first, size, int(row[-1]) - first + 2).astype(np.int64)
            sums = np.bincount(row - first, [bits[at[a:b]].sum() for a, b in zip(cuts, cuts[1:])], len(number))
            sums[0], number[0] = sums[0] + rest[0], number[0] + rest[1]
            k = 0
            for rows in ended:
                b, m, n_rows = sums[k : k + len(rows)], number[k : k + len(rows)], len(rows)
                place = pa.StructArray.from_arrays(
                    [pa.array(np.full(n_rows, part, np.int32)), pa.array(np.arange(first + k, first + k + n_rows))], ["part", "at"]
                )
                mark = held.of(rows.column("doc_id"), first + k) if marks else np.zeros(n_rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in others), pa.array(m), pa.array(b / np.maximum(m, 1), mask=m == 0), pa.array(mark), place],
                    [*others, "n_scored", "bits", "mark", "place"],
                )
                k += n_rows
            first, rest = first + k, (sums[k], int(number[k]))

    kinds = T.StructType([f for f in docs.schema if f.name != "text"]).add("n_scored", "long").add("bits", "double").add("mark", "long")
    kinds.add("place", T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())]))
    return sidecar.scanned(docs, *others, "text").mapInArrow(score, kinds)


def limits(held_out: DataFrame, quantile: float, least: int) -> DataFrame:
    """``(lang, most)`` from ``held_out(lang, bits)``: the quantile of each language's documents.

    Quantiles are taken over bins of 1/1000 bit, so what a task holds and sends is one count per bin. The
    row whose lang is null holds the limit over all languages, for those with under ``least`` documents.
    """
    binned = held_out.where("bits is not null").select("lang", (F.ceil(F.col("bits") * BIN) / BIN).alias("bits"))
    found = F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY bits)").alias("most"), F.count("*").alias("documents")
    overall = binned.agg(*found).select(F.lit(None).cast("string").alias("lang"), "most")
    per_lang = binned.where("lang is not null").groupBy("lang").agg(*found).where(F.col("documents") >= least)
    return per_lang.select("lang", "most").unionByName(overall)


def quality_classifier(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, least: int = 20, folds: int = 5) -> DataFrame:
    """``docs(doc_id, text, lang)`` to ``(doc_id, lang, n_scored, perplexity, most, kept)``.

    ``trusted_ids(doc_id)`` names the trusted documents. One in ``folds`` of them, by a hash of the id, is held out
    of the model. ``most`` is the perplexity limit of the document's language: the ``quantile`` of its held-out
    documents, or of those of all languages where the language is null or has under ``least``. Documents
    with a perplexity of ``most`` or less are kept. Empty and null texts have no perplexity and are not kept; if
    no trusted document is held out every text with words is kept. One row for each row; rows that repeat an id are judged each.
    """
    scored, bound = _judged(docs, trusted_ids, quantile, least, folds)
    return _verdicts(scored, bound).select("doc_id", "lang", "n_scored", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "most").alias("most"), "kept")


def keep_documents(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, least: int = 20, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that ``quality_classifier`` keeps, with all their columns; texts are not scored again."""
    docs = sidecar.repeatable(docs, "docs")
    scored, bound = _judged(docs, trusted_ids, quantile, least, folds)
    kept = _verdicts(scored, bound).where("kept").select("place.*", "doc_id", F.lit(1).cast("long").alias("mark"))
    path = sidecar.keep(kept, "at")
    kinds = T.StructType([T.StructField("row", docs.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, batches = sidecar.partition_of(batches)
        held, at = sidecar.Marks(path, part), 0
        for batch in batches:
            yield batch.select(["row"]).filter(pa.array(held.of(batch.column("doc_id"), at) == 1))
            at += len(batch)

    packed = sidecar.scanned(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return packed.mapInArrow(run, kinds).select("row.*")


def _judged(docs: DataFrame, trusted_ids: DataFrame, quantile: float, least: int, folds: int) -> tuple[DataFrame, DataFrame]:
    docs = sidecar.repeatable(docs, "docs")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    mark = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == 0, HELD_OUT).otherwise(TRAINED).cast("long").alias("mark")
    marks = sidecar.keep(sidecar.numbered(base, "doc_id").join(ids, "doc_id").select("part", "at", "doc_id", mark), "at")
    model = train(base, marks)
    scored = materialize(perplexities(base, model, marks), "bits")
    return scored, materialize(limits(scored.where(F.col("mark") == HELD_OUT), quantile, least), "limits")


def _verdicts(scored: DataFrame, bound: DataFrame) -> DataFrame:
    """``scored`` with ``most`` and ``kept``."""
    overall = bound.where("lang is null").agg(F.max("most")).first()[0]
    judged = scored.join(bound.where("lang is not null"), "lang", "left").withColumn("most", F.coalesce("most", F.lit(overall).cast("double")))
    within = F.col("bits") <= F.coalesce("most", F.lit(float("inf")))
    return judged.withColumn("kept", F.coalesce(within, F.lit(False)))
