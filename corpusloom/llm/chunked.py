"""Encoding texts by cached chunks, in numpy.

All the public patterns cut a text before every run of white space, and what follows a cut
is matched as if the text began there. So a text may be cut before any space that follows something
other than white space; likewise on both sides of a line break between two other characters, and between an
ASCII letter and a stop. Equal chunks have equal ids wherever they stand: each is encoded once per worker,
by whatever encoder is given, and afterwards found by two 64-bit hashes of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from corpusloom.llm.textscan import _BYTE, _powers, buffer_of, mix

_U = np.uint64
_OTHER = np.random.default_rng(77).integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
#: ASCII white space in any library's view.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_PLAIN = ~_WHITE & (np.arange(256) < 128)
_PLAIN[0xC3] = True  # leads the Latin-1 letters
_SECOND = np.zeros(256, bool)
_SECOND[[0x9A, 0xA0, 0x80, 0x81]] = True


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ascending byte offsets where chunks start, ``off[:-1]`` of non-empty texts among them."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n > 1:
        before, here = data[:-1], data[1:]
        white = _WHITE[before]
        # wider white space ends in one of these; others that look alike only make chunks longer
        white[1:] |= (data[:-2] == 0xC2) & ((before[1:] == 0x85) | (before[1:] == 0xA0))
        white[2:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & _SECOND[data[1:-2]]
        start[1:-1] = (here == 0x20) & ~white
        start[1:-1] |= _LETTER[before] & _STOP[here]
        lone = np.flatnonzero((here[:-1] == 0x0A) & ~white[:-1] & _PLAIN[here[1:]]) + 1
        start[lone] = start[lone + 1] = True
    start[off] = True
    return np.flatnonzero(start[:n])


class ChunkCache:
    """``encode(chunks)`` gives a list of ids for each chunk; ``limit`` chunks, and 16 ids for each, are kept at most.

    ``row``, where given, encodes many chunks at once; it gets chunks that start with a
    space, hold no other and do not end in white space, and returns an array of ids for each.
    """

    def __init__(self, encode: Callable, row: Callable | None = None, limit: int = 2_500_000):
        self.encode, self.row, self.limit = encode, row, limit
        self.clear()

    def clear(self) -> None:
        self.first, self.second, self.span = np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; null counts as empty."""
        data, off = buffer_of(texts)
        starts = cuts(data, off)
        ends = np.append(starts[1:], len(data))
        p, q = _powers(len(data) + 1)
        h = []
        for table in (_BYTE, _OTHER):
            sums = np.zeros(len(data) + 1, _U)
            np.cumsum(table[data] * p[:-1], out=sums[1:])
            h.append(mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(_U)))
        unique, at, inverse = np.unique(h[0], return_index=True, return_inverse=True)
        if not np.array_equal(h[1][at][inverse], h[1]):  # two chunks with one hash: encode without the cache
            made = [np.array(x, np.uint32) for x in self.encode([t.as_py() or "" for t in texts])]
            return np.concatenate([np.zeros(0, np.uint32), *made]), np.cumsum([0, *map(len, made)])
        span = self._spans(unique, h[1][at], data, starts[at], ends[at])[inverse]
        begin, size = span >> 31, span & 0x7FFFFFFF
        done = np.cumsum(size)
        total = int(done[-1]) if len(done) else 0
        out = self.flat[np.arange(total) + np.repeat(begin - (done - size), size)]
        bounds = np.concatenate([[0], done])[np.searchsorted(starts, off)]
        if len(self.first) > self.limit or self.used > 16 * self.limit:
            self.clear()
        return out, bounds

    def _spans(self, h: np.ndarray, h2: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the ids of each chunk (by ascending hash) lie in ``flat``: place * 2**31 + length: a text has less than 2**31 bytes, so no chunk has more ids."""
        place = np.searchsorted(self.first, h)
        span = np.full(len(h), -1, np.int64)
        if len(self.first):
            near = np.minimum(place, len(self.first) - 1)
            known = (self.first[near] == h) & (self.second[near] == h2)
            span[known] = self.span[near[known]]
        new = np.flatnonzero(span < 0)
        if len(new):
            raw = data.tobytes()
            chunks = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            made = self._encode(chunks)
            size = np.fromiter(map(len, made), np.int64, len(made))
            total = int(size.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used // 2), np.uint32)])
            self.flat[self.used : self.used + total] = np.concatenate(made)
            span[new] = ((self.used + np.cumsum(size) - size) << 31) + size
            self.used += total
            self.first = np.insert(self.first, place[new], h[new])
            self.second = np.insert(self.second, place[new], h2[new])
            self.span = np.insert(self.span, place[new], span[new])
        return span

    def _encode(self, chunks: list[str]) -> list:
        if self.row is None:
            return [np.array(x, np.uint32) for x in self.encode(chunks)]
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if c[0] == " " and c.rfind(" ") == 0 and not c[-1].isspace() and c[-1] != "᠎"]
        for k in range(0, len(plain), 2048):
            some = plain[k : k + 2048]
            for i, x in zip(some, self.row([chunks[i] for i in some]), strict=True):
                out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.encode([chunks[i] for i in rest])):
            out[i] = np.array(x, np.uint32)
        return out
