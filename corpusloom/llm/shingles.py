"""Sets of word shingles, scanned in numpy, and the sharded exchange that counts them.

A shingle travels as part of a sorted, delta-coded array of hashes, one array for each
(chunk of documents, shard of the hash space). A hash goes out once per chunk, however many of the chunk's
documents hold it, so a shingle of a third of all documents loads no shard more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from corpusloom.llm.textscan import mix, windows, word_hashes

_U = np.uint64
SHARED = 0xFFFF  # stands where a document's number would: several documents of the chunk hold the hash


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, sizes): the distinct ``size``-word shingles of each text, by document and hash.

    Words are lower-cased in A-Z. A text with fewer words has its whole sequence as the one
    shingle; one without words has none.
    """
    word, doc = word_hashes(texts, lower=True)
    count = np.bincount(doc, minlength=len(texts))
    h, first = windows(word, doc, size)
    hashes, docs = [mix(h + _U(size))], [doc[first]]
    for short in range(1, size):
        at = np.flatnonzero(count[doc] == short)
        h, first = windows(word[at], doc[at], short)
        hashes.append(mix(h + _U(short)))
        docs.append(doc[at][first])
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, d, np.bincount(d, minlength=len(texts))


def signatures(h: np.ndarray, d: np.ndarray, docs: int) -> np.ndarray:
    """128 bits for each document's set, as (docs, 2) words: equal sets, equal signatures."""
    off = np.searchsorted(d, np.arange(docs + 1))
    out = np.zeros((docs, 2), _U)
    for k, salt in enumerate((0x1234567, 0xABCDEF01)):
        sums = np.zeros(len(h) + 1, _U)
        np.cumsum(mix(h + _U(salt)), out=sums[1:])
        out[:, k] = mix(sums[off[1:]] - sums[off[:-1]] + (off[1:] - off[:-1]).astype(_U))
    return out


def sig_bytes(sig: np.ndarray) -> pa.Array:
    """Signatures as a binary array of 16 bytes each."""
    off = np.arange(0, 16 * len(sig) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(sig).tobytes())])


def pack(hashes: np.ndarray, numbers: np.ndarray) -> bytes:
    """Ascending 48-bit hashes and 16-bit numbers as one compressed blob."""
    delta = np.diff(hashes, prepend=_U(0))
    wide = len(delta) and delta[1:].max(initial=0) >= 1 << 32
    head = np.array([len(hashes), int(bool(wide)), *(delta[:1] if len(delta) else [0])], np.uint64)
    steps = delta[1:].astype(np.uint64 if wide else np.uint32)
    planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (steps, numbers.astype(np.uint16)) if len(x)]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, wide, first = (int(x) for x in np.frombuffer(raw, _U, 3))
    at, width = 24, 8 if wide else 4
    steps = np.frombuffer(raw, np.uint8, (n - 1) * width, at).reshape(width, n - 1).T.copy().view(f"<u{width}").ravel()
    numbers = np.frombuffer(raw, np.uint8, n * 2, at + (n - 1) * width).reshape(2, n).T.copy().view("<u2").ravel()
    hashes = np.empty(n, _U)
    hashes[0] = first
    np.cumsum(steps, out=hashes[1:], dtype=_U)
    hashes[1:] += _U(first)
    return hashes, numbers


def shard_bounds(hashes: np.ndarray, bits: int, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, start, end) of the non-empty shards of ascending ``bits``-bit hashes."""
    edges = np.array([(k << bits) // shards for k in range(1, shards)], _U)
    cuts = np.concatenate([[0], np.searchsorted(hashes, edges, side="left"), [len(hashes)]])
    for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(s), int(cuts[s]), int(cuts[s + 1])
