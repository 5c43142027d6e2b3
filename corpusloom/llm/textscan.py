"""Whole-batch text scanning in numpy: words, lines and their hashes, without a loop over documents.

A ``Scan`` covers the texts of one bounded slice of an Arrow batch as one UTF-8 buffer.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; those bytes are ASCII, so runs
never cut a character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10  # a slice needs about 100 times its bytes while it is scanned
SLICE_ROWS = 1 << 14  # numbers of a slice's rows fit 16 bits, whatever the session's batches

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_LOWER = _BYTE[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))]
_BASE = 0x9E3779B97F4A7C15
_POW = {}


@cache
def _lean() -> None:
    """Once in a worker: give freed arrays of 1 MB and more back to the system at once, where the C library can be told so."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        return
    pa.set_memory_pool(pa.system_memory_pool())


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


_UNMIX = [_U(pow(c, -1, 2**64)) for c in (0xA0761D6478BD642F, 0xD6E8FEB86659FD93)]


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = (h ^ (h >> _U(32))) * _UNMIX[0]
    h = (h ^ (h >> _U(29)) ^ (h >> _U(58))) * _UNMIX[1]
    return h ^ (h >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POW.get("p", ())) < n:
        for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 2**64))):
            x = np.full(max(n, 1 << 16), base, _U)
            x[0] = 1
            _POW[name] = np.cumprod(x)
    return _POW["p"][:n], _POW["q"][:n]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of ``SLICE_ROWS`` rows at most, whose texts hold ``limit`` bytes at most, or one text that is longer."""
    _lean()
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i, n = 0, len(batch)
    while i < n:
        j = min(i + SLICE_ROWS, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right"))))
        yield batch.slice(i, j - i)
        i = j


def pieces(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array, bool, bool]]:
    """(rows, their texts or a part of the one text, whether the rows end here, whether the text began before).

    ``slices``, but a longer text comes in parts of about ``limit`` bytes, cut before white space. A word that
    is longer than that is not cut.
    """
    for rows in slices(batch, column, limit):
        texts = rows.column(column)
        if len(rows) > 1 or texts.nbytes <= limit:
            yield rows, texts, True, False
            continue
        data, _ = buffer_of(texts)
        a = 0
        while a < len(data) or not a:
            b = min(a + limit, len(data))
            while b < len(data) and not _SPACE[data[b]]:
                gap = np.flatnonzero(_SPACE[data[b : b + limit]])
                b = min(b + (int(gap[0]) if len(gap) else limit), len(data))
            yield rows, pa.array([data[a:b].tobytes()], pa.binary()), b >= len(data), a > 0
            if b >= len(data):
                break
            a = b


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


class Scan:
    """Words and lines of some texts: ``starts``, ``ends`` (byte offsets) and ``doc`` (index) of each word."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = buffer_of(texts)
        self.docs = len(self.off) - 1
        n = len(self.data)
        space = _SPACE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.off] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:], after[:-1] = space[:-1], space[1:]
        self.starts = np.flatnonzero(~space & (before | cut[:-1]))
        self.ends = np.flatnonzero(~space & (after | cut[1:])) + 1
        self.doc = np.searchsorted(self.off, self.starts, side="right") - 1
        self.space = space
        self._sums: dict[bool, np.ndarray] = {}

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans, equal for equal bytes (A-Z folded if ``lower``)."""
        p, q = _powers(len(self.data) + 1)
        if lower not in self._sums:
            sums = np.zeros(len(self.data) + 1, _U)
            np.cumsum((_LOWER if lower else _BYTE)[self.data] * p[:-1], out=sums[1:])
            self._sums[lower] = sums
        sums = self._sums[lower]
        return mix((sums[ends] - sums[starts]) * q[starts])

    def words(self, lower: bool = False) -> np.ndarray:
        return self.hashes(self.starts, self.ends, lower)

    def per_doc(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        out = np.bincount(doc, weights=weights, minlength=self.docs)
        return out if weights is None else out.astype(np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, doc) of the ``\\n``-split lines of every text, empty ones included."""
        breaks = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.off, breaks, side="right") - 1
        starts = np.concatenate([self.off[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.off[1:]])
        doc = np.concatenate([np.arange(self.docs), owner])
        order = np.lexsort((starts, doc))
        end_order = np.lexsort((ends, np.concatenate([owner, np.arange(self.docs)])))
        return starts[order], ends[end_order], doc[order]


def word_hashes(texts: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of each word; one text longer than ``limit`` bytes is scanned in parts, cut between words."""
    if len(texts) == 1 and texts.nbytes > limit:
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        word = np.concatenate([Scan(part).words(lower) for _, part, _, _ in pieces(rows, "text", limit)])
        return word, np.zeros(len(word), np.int64)
    scan = Scan(texts)
    return scan.words(lower), scan.doc


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word windows within a document, and the index of each window's first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    total = np.zeros(len(first), _U)
    for k in range(size):
        total = total * _U(0x2545F4914F6CDD1D) + h[first + k]
    return mix(total), first


def repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each (doc, hash), whether it occurs more than once."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    same = np.zeros(len(x), bool)
    if len(x):
        eq = (x[1:] == x[:-1]) & (d[1:] == d[:-1])
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(x), bool)
    out[order] = same
    return out
