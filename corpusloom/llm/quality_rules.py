"""Quality rules: base counts and repetition found with a suffix array.

The suffix array is over word sequences, one array for all documents of a slice:
a document's words are ranked within it, so suffixes of two documents never compare equal. Adjacent
suffixes that share ``min_repeat`` words or more form longest-common-prefix intervals;
every occurrence of such an interval is a maximal repeated substring. The union of their spans
gives the covered words, the greatest prefix the longest repeat.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import bounded_batches
from corpusloom.llm.textscan import SLICE_BYTES, Scan, buffer_of, pieces, repeated, slices, windows

#: Fixed by the contract: the symbols counted, and the base limits.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)
#: A line with a word, whole.
_LINE = rb"[ \t\v\f\r]*[^ \t-\r][^\n]*"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[np.frombuffer(SYMBOLS.encode(), np.uint8)] = True


def suffix_repeats(word: np.ndarray, doc: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(covered, longest) per word: whether it lies in a repeat, and the longest repeat that starts there.

    ``word`` are hashes, ``doc`` ascending document numbers. Prefix doubling
    sorts only the suffixes that are still tied; the rank tables of its levels
    then give the common prefix of neighbours by halving steps. Prefixes under ``min_repeat`` words count as none.
    """
    n = len(word)
    longest = np.zeros(n, np.int64)
    ranks: list[np.ndarray] = []
    # level 0: equal words of one document share a rank; 0 is what lies past the end
    order = np.lexsort((word, doc))
    new = np.ones(n, bool)
    if n:
        new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n + 1, np.int32 if n < 2**31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    rank[n] = 0
    end = np.searchsorted(doc, doc, side="right")
    live = np.flatnonzero(_shared(rank[:n]))
    ranks.append(rank)
    step = 1
    while len(live):
        ahead = np.where(live + step < end[live], live + step, n)
        a, b = rank[live], rank[ahead]
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        new_a = np.ones(len(live), bool)
        new_a[1:] = sa[1:] != sa[:-1]
        new = new_a.copy()
        new[1:] |= sb[1:] != sb[:-1]
        at = np.arange(len(live))
        group = np.maximum.accumulate(np.where(new_a, at, 0))
        # ranks inside a group of equal a keep its base and add the offset: groups hold disjoint ranges
        fresh = sa + np.maximum.accumulate(np.where(new, at, 0)) - group
        rank = rank.copy()
        rank[live[order]] = fresh
        ranks.append(rank)
        step *= 2
        live = live[_shared(rank[live])]
    # suffixes in order; only those tied over at least one word can be neighbours with a common prefix
    final = ranks[-1][:n]
    cand = np.flatnonzero(_shared(ranks[0][:n]))
    if not len(cand):
        return np.zeros(n, bool), longest
    sa = cand[np.argsort(final[cand], kind="stable")]
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (i < n) & (j < n)
        equal = inside & (ranks[k][np.minimum(i, n)] == ranks[k][np.minimum(j, n)])
        width = 1 << k
        lcp += equal * width
        i = np.where(equal, i + width, i)
        j = np.where(equal, j + width, j)
        i, j = np.minimum(i, n), np.minimum(j, n)
    np.maximum.at(longest, sa[:-1], lcp)
    np.maximum.at(longest, sa[1:], lcp)
    longest[longest < min_repeat] = 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(longest)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:n]) > 0, longest


def _shared(rank: np.ndarray) -> np.ndarray:
    _, inverse, count = np.unique(rank, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def _repeats(word: np.ndarray, doc: np.ndarray, docs: int, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of ``SCHEMA`` that depend on which words are equal."""
    window, first = windows(word, doc, 3)
    at = first[repeated(doc[first], window)]
    hit = np.zeros(len(word) + 2, bool)
    for k in range(3):
        hit[at + k] = True
    del window, first, at
    covered, longest = suffix_repeats(word, doc, min_repeat)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, doc, longest)
    return {
        "n_repeat_words": np.bincount(doc[hit[: len(word)]], minlength=docs),
        "covered_words": np.bincount(doc[covered], minlength=docs),
        "longest_repeat": most,
    }


def _long(texts: pa.Array, min_repeat: int, limit: int) -> dict[str, np.ndarray]:
    """``measure`` of one text longer than ``limit`` bytes: scanned in parts, of which the hashes of words and lines stay."""
    words, chars, symbols = [], 0, 0
    for _, part, _, _ in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text", limit):
        scan = Scan(part)
        words.append(scan.words())
        chars += int((((scan.data & 0xC0) != 0x80) & ~scan.space).sum())
        symbols += int(_IS_SYMBOL[scan.data].sum())
    lines = array("Q", (xxhash.xxh3_64_intdigest(x[0]) for x in re.finditer(_LINE, buffer_of(texts)[0].tobytes())))
    word = np.concatenate(words)
    repeats = _repeats(word, np.zeros(len(word), np.int64), 1, min_repeat)
    counts = {"n_words": len(word), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": len(lines) - len(np.unique(np.frombuffer(lines, np.uint64)))}
    return {k: np.array([v], np.int64) for k, v in counts.items()} | repeats


def measure(texts: pa.Array, min_repeat: int, limit: int = SLICE_BYTES) -> dict[str, np.ndarray]:
    """The counts of ``SCHEMA`` for each text of a slice; null counts as empty."""
    if len(texts) == 1 and texts.nbytes > limit:
        return _long(texts, min_repeat, limit)
    scan = Scan(texts)
    points = np.concatenate([[0], np.cumsum((scan.data & 0xC0) != 0x80)])
    marks = np.concatenate([[0], np.cumsum(_IS_SYMBOL[scan.data])])
    starts, ends, line_doc = scan.lines()
    blank = np.concatenate([[0], np.cumsum(~scan.space)])
    full = blank[ends] > blank[starts]
    starts, ends, line_doc = starts[full], ends[full], line_doc[full]
    h = scan.hashes(starts, ends)
    order = np.lexsort((h, line_doc))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    return {
        "n_words": scan.per_doc(scan.doc),
        "word_chars": scan.per_doc(scan.doc, points[scan.ends] - points[scan.starts]),
        "n_symbols": marks[scan.off[1:]] - marks[scan.off[:-1]],
        "n_dup_lines": scan.per_doc(line_doc[order][again]),
    } | _repeats(scan.words(), scan.doc, scan.docs, min_repeat)


def judge(texts: pa.Array, min_repeat: int = 8, max_covered: float = 0.5, max_longest: int = 100) -> dict[str, np.ndarray]:
    """The counts of ``measure`` with ``base_failed`` and ``kept``."""
    found = measure(texts, min_repeat)
    n = found["n_words"]
    failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    good = (found["covered_words"] <= max_covered * n) & (found["longest_repeat"] <= max_longest)
    return found | {"base_failed": failed, "kept": ~failed & good}


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """``docs(doc_id, text)`` to ``SCHEMA``: counts and verdicts of whole texts, with the limits of ``judge``.

    A document is kept if it passes the base limits (50 words; at most half of
    its words in repeated 3-word windows), at most ``max_covered`` of its words lie in repeats of
    ``min_repeat`` words or more, and none of them is longer than ``max_longest`` words. Null and
    empty texts have no words and fail. One row out for each row in, repeated or null ids
    included; other columns are ignored. Whole texts are measured; a slice holds a few MB, or one
    long text, which is scanned in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = judge(part.column("text"), **limits)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; each row is judged by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(judge(part.column("text"), **limits)["kept"]))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
