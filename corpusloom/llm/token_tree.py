"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A leaf holds a run of pre-tokens with their lengths and token counts; inner nodes hold sums of both.
An edit walks down to its place, cuts the text anew from the boundary before it, and stops
at the first boundary behind it that the old text had too: a pre-token depends on what
follows its start only, so from there on nothing changes. Only the pre-tokens between are encoded, and
only the sums above their leaves are updated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.byte_bpe import Bpe
from corpusloom.llm.store import bounded_batches
from corpusloom.llm.textscan import slices

LEAF = 64
LOOKAHEAD = 2  # a match of the public patterns depends on at most two characters behind its end
_COUNTERS: dict[tuple[str, str], Counter] = {}

#: Fixed: what the query's edits replace, e-mail addresses and long numbers, and by what.
REDACTED = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|\+?\d[\d() .-]{5,}\d")
REPLACEMENT = "[redacted]"

Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens of a text and the number of tokens of each, by a rank file of the tiktoken library."""

    def __init__(self, path: str, pattern: str, limit: int = 1_000_000):
        import tiktoken

        self.model, self.limit, self.known = Bpe.load(path, pattern), limit, {}
        self.library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=self.model.ranks, special_tokens={})

    @classmethod
    def load(cls, path: str, pattern: str) -> Counter:
        if (path, pattern) not in _COUNTERS:
            _COUNTERS[path, pattern] = cls(path, pattern)
        return _COUNTERS[path, pattern]

    def pieces(self, text: str) -> list[str]:
        return self.model.pieces(text)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = len(self.library.encode_ordinary(p))
        return list(map(known.__getitem__, pieces))


class TokenTree:
    """The pre-tokens of one text under edits; ``tokens`` is their total."""

    def __init__(self, counter: Counter, pieces: list[str], counts: list[int]):
        self.counter = counter
        self._build([(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)])

    @classmethod
    def of(cls, counter: Counter, text: str) -> TokenTree:
        pieces = counter.pieces(text)
        return cls(counter, pieces, counter.counts(pieces))

    def _build(self, leaves: list[tuple[list[str], list[int]]]) -> None:
        self.leaves = leaves or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (pieces, counts) in enumerate(self.leaves):
            self.chars[self.size + k] = sum(map(len, pieces))
            self.sums[self.size + k] = sum(counts)
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for pieces, _ in self.leaves for p in pieces)

    def tokens_before(self, position: int) -> int:
        """Tokens of the pre-tokens that end at or before a character position."""
        leaf, start = self._find(position)
        k, total = self.size + leaf, 0
        while k > 1:
            if k % 2:
                total += self.sums[k - 1]
            k //= 2
        for p, n in zip(*self.leaves[leaf]) if leaf < len(self.leaves) else ():
            start += len(p)
            if start > position:
                break
            total += n
        return total

    def _find(self, position: int) -> tuple[int, int]:
        """(leaf, its start) of the leaf that holds a character position; the last one for the end."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if start + self.chars[k] <= position and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = pieces, counts
        k = self.size + leaf
        self.chars[k], self.sums[k] = sum(map(len, pieces)), sum(counts)
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters ``start:end``; the number of pre-tokens that were encoded anew."""
        first, at = self._find(max(0, start - LOOKAHEAD))
        head, head_counts = list(self.leaves[first][0]), list(self.leaves[first][1])
        keep, cut = 0, at
        while keep < len(head) and cut + len(head[keep]) + LOOKAHEAD <= start:
            cut += len(head[keep])
            keep += 1
        last, pool, pool_counts = first, head[keep:], head_counts[keep:]
        reach = at + self.chars[self.size + first]
        while True:
            # extend by whole leaves until the old and the new boundaries meet before what is gathered ends
            while reach < end and last + 1 < len(self.leaves):
                last += 1
                pool += self.leaves[last][0]
                pool_counts += self.leaves[last][1]
                reach += self.chars[self.size + last]
            gathered = "".join(pool)
            text = gathered[: start - cut] + new + gathered[end - cut :]
            shift = len(text) - len(gathered)
            fresh = self.counter.pieces(text)
            final = last + 1 >= len(self.leaves)
            taken, met = self._meeting(pool, fresh, cut, end, shift, len(text), final)
            if taken is not None:
                break
            end_of_last = reach
            while last + 1 < len(self.leaves) and reach == end_of_last:
                last += 1
                pool += self.leaves[last][0]
                pool_counts += self.leaves[last][1]
                reach += self.chars[self.size + last]
        made = fresh[:taken]
        pieces = head[:keep] + made + pool[met:]
        counts = head_counts[:keep] + self.counter.counts(made) + pool_counts[met:]
        for leaf in range(first + 1, last + 1):
            self._set(leaf, [], [])
        self._set(first, pieces, counts)
        if len(pieces) > 16 * LEAF:
            whole = [x for leaf in self.leaves for x in zip(*leaf)]
            self._build([tuple(map(list, zip(*whole[i : i + LEAF]))) for i in range(0, len(whole), LEAF)])
        return taken

    @staticmethod
    def _meeting(pool, fresh, cut, end, shift, size, final) -> tuple[int | None, int]:
        """(new pre-tokens, old pre-tokens) up to the first common boundary behind the edit."""
        old, place = {}, cut
        for k, p in enumerate(pool):
            place += len(p)
            if place >= end:
                old[place + shift] = k + 1
        if end <= cut:
            old[cut + shift] = 0
        place = cut
        for k, p in enumerate(["", *fresh]):
            place += len(p)
            # near the end of what is gathered a match may not be what it is in the whole text
            if place >= end + shift and place in old and (final or place + LOOKAHEAD < cut + size):
                return k, old[place]
        return (len(fresh), len(pool)) if final else (None, 0)

    def apply(self, edits: list[Edit]) -> int:
        """Edits of the present text, positions as before the first; where they overlap, the later starts where the earlier ends."""
        clear, past = [], 0
        for a, b, new in sorted(edits, key=lambda e: e[:2]):
            a = min(max(a, past), self.length)
            b = min(max(b, a), self.length)
            clear.append((a, b, new))
            past = b
        return sum(self.edit(a, b, new) for a, b, new in reversed(clear))


def redactions(text: str) -> list[Edit]:
    return [(m.start(), m.end(), REPLACEMENT) for m in REDACTED.finditer(text)]


STATE = "doc_id long, pieces array<string>, counts array<int>"


def build_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` to the leaves of their trees, ``STATE``, to be kept as a table.

    A null text is empty and has no pre-tokens. One row for each row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.load(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                pieces = [counter.pieces(t or "") for t in part.column("text").to_pylist()]
                counts = [counter.counts(p) for p in pieces]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(pieces, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "pieces", "counts"]
                )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STATE)


def apply_edits(trees: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """Kept trees and ``edits(doc_id, start, end, new)`` to the trees after them, ``STATE`` with ``n_reencoded``.

    Documents without edits pass unchanged; edits of unknown or null ids do nothing; edits with a null position do
    nothing; a null ``new`` is empty. Positions count code points of the text before all edits.
    """
    good = edits.where("doc_id is not null and start is not null and end is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("new", F.lit("")).alias("new")).alias("edit"),
    )
    lists = good.groupBy("doc_id").agg(F.sort_array(F.collect_list("edit")).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.load(path, pattern)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tree, n = TokenTree(counter, r["pieces"] or [], r["counts"] or []), 0
                if r["edits"]:
                    n = tree.apply([(e["start"], e["end"], e["new"]) for e in r["edits"]])
                out.append((r["doc_id"], [p for x, _ in tree.leaves for p in x], [c for _, x in tree.leaves for c in x], n))
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "pieces", "counts", "n_reencoded"])

    return trees.select("doc_id", "pieces", "counts").join(lists, "doc_id", "left").mapInArrow(run, STATE + ", n_reencoded long")


COUNTS = "doc_id long, n_pieces long, n_tokens long, n_edits long, n_reencoded long, n_tokens_edited long"


def count_tokens(docs: DataFrame, path: str, pattern: str, edits_of: Callable[[str], list[Edit]] = redactions) -> DataFrame:
    """``docs(doc_id, text)`` to ``COUNTS``: tokens of each whole text, and again after the edits that ``edits_of`` finds in it.

    The second count comes from the tree, of which only what the edits touch is encoded again
    (``n_reencoded`` pre-tokens). Null and empty texts have no tokens and no edits. One row for each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.load(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    tree, edits = TokenTree.of(counter, text or ""), edits_of(text or "")
                    n_pieces, before = sum(len(p) for p, _ in tree.leaves), tree.tokens
                    rows.append((n_pieces, before, len(edits), tree.apply(edits), tree.tokens))
                made = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, made)], [c.split()[0] for c in COUNTS.split(", ")])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)
