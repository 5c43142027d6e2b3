"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one vocabulary token can end its encoding: the
one that is compatible with the last token of the prefix before it. Two tokens are
compatible if merging their joined bytes gives just these two. A ``PrefixTable`` keeps that last token for
each prefix; the encoding of any prefix is read backwards from it. Appending bytes only
adds entries, and an edit recomputes entries from its start on, until the table agrees
with the old one for as long as the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.chunked import ChunkCache
from corpusloom.llm.store import bounded_batches
from corpusloom.llm.textscan import slices

_MODELS: dict[tuple[str, str], Bpe] = {}
_RARE = re.compile("[^\u0000-ԯ]")
#: Letters, digits, spaces and others that stand for characters which the regex library classes by a newer Unicode.
_STAND_IN = {"L": "é", "N": "٣", "s": " ", "o": "¡"}


class Bpe:
    """A vocabulary of byte strings with ranks, merged lowest rank first within each match of ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}  # left * 2**32 + right
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._classes: dict[str, str] = {}
        self.cache: ChunkCache | None = None

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        """The worker's copy of a rank file (base64 token and rank on each line)."""
        if (path, pattern) not in _MODELS:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
            _MODELS[path, pattern] = cls(ranks, pattern)
        return _MODELS[path, pattern]

    def merge(self, data: bytes, until: int = 1) -> list[int]:
        """Plain merging, quadratic, down to ``until`` parts: what defines which pairs are compatible."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; (token, token) for a byte, None if merging does not make it."""
        if token not in self._halves:
            data = self.token[token]
            found = self.merge(data, 2) if len(data) > 1 else [token, token]
            self._halves[token] = tuple(found) if len(found) == 2 else None
        return self._halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives the two; -1 stands for the text's start."""
        key = (left << 32) + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            known = self._pairs[key] = self._meet(left, right)
        return known

    def _meet(self, left: int, right: int) -> bool:
        """Undo the merges next to the border, latest first; no pair met on the way may merge before the merge undone last."""
        if self.halves(right) is None:
            return False
        if left < 0:
            return True
        token, ranks, halves = self.token, self.ranks, self.halves
        least = 1 << 60
        while True:
            across = ranks.get(token[left] + token[right])
            if across is not None and across < least:
                return False
            whole_left, whole_right = len(token[left]) == 1, len(token[right]) == 1
            if whole_left and whole_right:
                return True
            # of equal merges the left one comes first, and a merge across the border comes between them
            if whole_right or (not whole_left and left > right):
                least, left = left, halves(left)[1]
            else:
                least, right = right + 1, halves(right)[0]

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches, as the library that the rank file is for makes them.

        Characters that are unassigned in this Python's Unicode are classed as neither
        letter, digit nor space; the regex library may know them already.
        """
        if _RARE.search(text):
            odd = {c for c in set(text) if unicodedata.category(c) == "Cn"}
            if odd:
                cast = text.translate({ord(c): _STAND_IN[self.unicode_class(c)] for c in odd})
                return [text[m.start() : m.end()] for m in self.pattern.finditer(cast)]
        return self.pattern.findall(text)

    def unicode_class(self, c: str) -> str:
        """L, N, s or o of a character that this Python does not know, by the library's own matching."""
        if c not in self._classes:
            import tiktoken

            letter, digit = b"a" + c.encode(), b"1" + c.encode()
            probe = {bytes([i]): i for i in range(256)} | {letter: 256, digit: 257}
            library = tiktoken.Encoding("probe", pat_str=self.pattern.pattern, mergeable_ranks=probe, special_tokens={})
            kinds = [k for k, x in (("L", letter), ("N", digit)) if len(library.encode_ordinary(x.decode())) == 1]
            self._classes[c] = kinds[0] if kinds else "o"
        return self._classes[c]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            out += self.encode_piece(piece.encode("utf-8", "replace"))
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)  # a piece that is a token is that token, even if merges would not make it
        return [whole] if whole is not None else PrefixTable(self, data).ids()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixTable:
    """``last[i]``: the token that ends the encoding of the first ``i`` bytes."""

    def __init__(self, model: Bpe, data: bytes = b""):
        self.model, self.data = model, b""
        self.last: list[int] = [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data = data = self.data + more
        model, last = self.model, self.last
        ranks, known, compatible, longest = model.ranks.get, model._pairs.get, model.compatible, model.longest
        for i in range(len(last), len(data) + 1):
            for start in range(i - longest if i > longest else 0, i):
                token = ranks(data[start:i])
                if token is not None:
                    before = last[start]
                    fits = known((before << 32) + token)
                    if fits or (fits is None and compatible(before, token)):
                        last.append(token)
                        break
            else:
                raise ValueError(f"byte {data[i - 1]} is in no token")

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace bytes ``start:end``; the number of entries that were computed anew."""
        old, shift = self.last, len(new) - (end - start)
        changed = self.data[:start] + new + self.data[end:]
        self.data, self.last = changed[:start], old[: start + 1]
        agreed = 0
        for i in range(start + 1, len(changed) + 1):
            self.append(changed[i - 1 : i])
            if i - len(new) > start and self.last[i] == old[i - shift]:
                agreed += 1
            else:
                agreed = 0
            if agreed >= self.model.longest:
                self.data = changed
                self.last += old[i - shift + 1 :]
                return i - start
        return len(changed) - start

    def ids(self, size: int | None = None) -> list[int]:
        """The encoding of the first ``size`` bytes (of all)."""
        i, out = len(self.data) if size is None else size, []
        while i:
            out.append(self.last[i])
            i -= len(self.model.token[self.last[i]])
        return out[::-1]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, ids array<int>)``, and the columns that ``keep`` names.

    A null text is empty and has no ids. One row for each row; repeated and null ids stay, other
    columns are ignored. Whole texts are encoded, whatever their length, in linear time.
    """
    return _encoded(docs, path, pattern, "ids array<int>", None, keep)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, digests of the ids and of what they decode to.

    Rows as in ``encode_documents``; an empty text has the digests of the empty string.
    """

    def digests(model: Bpe, ids: list[np.ndarray]) -> list[pa.Array]:
        decoded = [hashlib.sha256(model.decode(x.tolist())).hexdigest() for x in ids]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array(decoded)]

    return _encoded(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _encoded(docs: DataFrame, path: str, pattern: str, columns: str, digests, keep: tuple[str, ...] = ()) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Bpe.load(path, pattern)
        if model.cache is None:
            model.cache = ChunkCache(lambda chunks: map(model.encode, chunks))
        for batch in batches:
            for part in slices(batch, "text"):
                flat, off = model.cache.ids(part.column("text"))
                if digests:
                    arrays = digests(model, [flat[a:b] for a, b in zip(off, off[1:])])
                else:
                    arrays = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays, *(part.column(c) for c in keep)], ["doc_id", *names, *keep])

    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"doc_id long, {columns}{more}")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` to ``(doc_id, data binary)``. Null ids give null; an id outside the vocabulary raises KeyError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Bpe.load(path, pattern)
        for batch in batches:
            data = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
