"""TIFF media columns: baseline files written, image directories walked, one row per page.

Read: both byte orders; strips and tiles; no compression, PackBits, LZW and deflate; the
horizontal predictor; chunky and planar 8-bit samples. ``store_texts`` keeps any bytes
losslessly as the samples of RGB pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import bounded_batches
from corpusloom.llm.textscan import slices

#: Fixed by the format: tags, the sizes of value types, and codes of compression.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES = 256, 257, 258, 259, 262, 273, 277
ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
_TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}

PIXELS, CHANNELS = 64, 3  # a row of a text's page: 192 bytes
PAGE_ROWS, STRIP_ROWS = 1024, 64

#: How a text's file is written: the crc32 of its payload, modulo their number, picks one.
LAYOUTS = (
    {"compression": "deflate", "predictor": 2, "order": "<"},
    {"compression": "packbits", "predictor": 1, "tile": (PIXELS, 16), "order": ">"},
    {"compression": "deflate", "predictor": 2, "tile": (32, 32), "planar": True, "order": "<"},
    {"compression": "lzw", "predictor": 1, "order": ">"},
)


class Page(NamedTuple):
    width: int
    height: int
    channels: int
    compression: int
    predictor: int
    samples: np.ndarray  # (height, width, channels) uint8


def unpack_bits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out.append(data[i + 1 : i + 2 + c])
            i += c + 2
        else:
            if c > 128:
                out.append(data[i + 1 : i + 2] * (257 - c))
            i += 1 if c == 128 else 2
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, bits, held, last, out = list(base), 9, 0, 0, b"", []
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code is out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    held, bits, out = 0, 0, bytearray()
    table, width = {bytes([i]): i for i in range(256)}, 9
    codes = [(256, 9)]
    run = b""
    for i in range(len(data)):
        more = run + data[i : i + 1]
        if more in table:
            run = more
            continue
        codes.append((table[run], width))
        table[more] = len(table) + 2
        run = data[i : i + 1]
        size = len(table) + 2
        if size == 4094:
            codes.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        elif size >= 1 << width:
            width += 1
    if run:
        codes.append((table[run], width))
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    codes.append((257, width))
    for code, w in codes:
        held, bits = (held << w) | code, bits + w
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1
    return bytes(out) + (bytes([held << (8 - bits) & 255]) if bits else b"")


_DECODE = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}
_ENCODE = {1: bytes, 5: pack_lzw, 8: lambda b: zlib.compress(b, 1), 32773: pack_bits}


def _directories(data: bytes) -> Iterator[dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("the image directories do not end")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = _TYPE_BYTES.get(kind, 0) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            form = {1: "B", 3: "H", 4: "I"}.get(kind)
            if form:
                tags[tag] = struct.unpack_from(f"{order}{count}{form}", data, where)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file in order. Raises ValueError for what is damaged or not covered."""
    try:
        for tags in _directories(data):
            yield _page(data, tags)
    except (struct.error, zlib.error, KeyError, IndexError) as e:
        raise ValueError(f"damaged TIFF: {e!r}") from e


def _page(data: bytes, tags: dict[int, tuple]) -> Page:
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    channels, code = tags.get(SAMPLES, (1,))[0], tags.get(COMPRESSION, (1,))[0]
    predictor, planar = tags.get(PREDICTOR, (1,))[0], tags.get(PLANAR, (1,))[0]
    if set(tags.get(BITS, (1,))) != {8} or code not in _DECODE or predictor not in (1, 2):
        raise ValueError(f"not covered: bits {tags.get(BITS)}, compression {code}, predictor {predictor}")
    tiled = TILES in tags
    w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(tags.get(ROWS_PER_STRIP, (height,))[0], height))
    where, size = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    across, down = -(-width // w), -(-height // h)
    planes, depth = (channels, 1) if planar == 2 else (1, channels)
    out = np.zeros((down * h, across * w, channels), np.uint8)
    for k in range(planes * across * down):
        plane, rest = divmod(k, across * down)
        y, x = divmod(rest, across)
        rows = h if tiled else min(h, height - y * h)
        raw = _DECODE[code](data[where[k] : where[k] + size[k]])
        if len(raw) < rows * w * depth:
            raise ValueError("a strip or tile is too short")
        part = np.frombuffer(raw, np.uint8, rows * w * depth).reshape(rows, w, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        to = slice(None) if planes == 1 else slice(plane, plane + 1)
        out[y * h : y * h + rows, x * w : x * w + w, to] = part
    return Page(width, height, channels, code, predictor, out[:height, :width])


def write(images: list[np.ndarray], compression: str = "deflate", predictor: int = 2, strip_rows: int = STRIP_ROWS,
          tile: tuple[int, int] | None = None, planar: bool = False, order: str = "<") -> bytes:
    """A TIFF file with a page for each (height, width, channels) array of bytes; ``tile`` is (width, height)."""
    code = CODES[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, channels = image.shape
        w, h = tile or (width, strip_rows)
        blocks = []
        for plane in range(channels) if planar else [slice(None)]:
            for y in range(0, height, h):
                for x in range(0, width, w):
                    part = image[y : y + h, x : x + w, plane].reshape(min(h, height - y), min(w, width - x), -1)
                    if tile:
                        part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.diff(part, axis=1, prepend=np.uint8(0))
                    blocks.append(_ENCODE[code](part.tobytes()))
        places = []
        for b in blocks:
            places.append(len(out))
            out += b + b"\0" * (len(b) % 2)
        sizes = [len(b) for b in blocks]
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * channels), (COMPRESSION, 3, [code]),
                (PHOTOMETRIC, 3, [2 if channels == 3 else 1]), (SAMPLES, 3, [channels]), (PLANAR, 3, [2 if planar else 1]), (PREDICTOR, 3, [predictor])]
        if tile:
            tags += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILES, 4, places), (TILE_BYTES, 4, sizes)]
        else:
            tags += [(STRIPS, 4, places), (ROWS_PER_STRIP, 4, [h]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at + b"\0" * (len(at) % 2)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def payload_of(text: bytes) -> bytes:
    """The text with spaces after it, up to a positive multiple of a row."""
    row = PIXELS * CHANNELS
    return text + b" " * (max(row, -(-len(text) // row) * row) - len(text))


def from_payload(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PIXELS, CHANNELS)
    return write([rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)], **LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)])


def store_texts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_bytes, media binary)``: each whole text as a TIFF file.

    A null text is empty. One row for each row, null and repeated ids included; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = pa.array([from_payload(payload_of(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGES = {
    "page": "int", "width": "int", "height": "int", "channels": "int", "compression": "int", "predictor": "int", "samples": "binary",
    "media_bytes": "long", "media_sha256": "string", "error": "string",
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
ROWS_BYTES = 4 << 20  # of samples, in one batch of page rows


def page_rows(media: DataFrame) -> DataFrame:
    """``media(doc_id, media, ...)`` to one row per page: all columns but ``media``, and ``PAGES``.

    The pages of a file follow each other, numbered from 0, with the file's size and digest. A file that cannot be read
    gives the pages before the damage and a row with the error. Null media give no rows. A column whose name is
    one of ``PAGES`` gives way to it.
    """
    others = [c for c in media.columns if c != "media" and c not in PAGES]

    def rows_of(data: bytes) -> Iterator[tuple]:
        whole, k = (len(data), hashlib.sha256(data).hexdigest()), 0
        try:
            for p in pages(data):
                yield (k, *p[:5], p.samples.tobytes(), *whole, None)
                k += 1
        except ValueError as e:
            yield (k, *[None] * 6, *whole, str(e))

    def batch_of(batch: pa.RecordBatch, files: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kept = [batch.column(c).take(pa.array(files, pa.int64())) for c in others]
        made = [pa.array([r[k] for r in rows], _ARROW[kind]) for k, kind in enumerate(PAGES.values())]
        return pa.RecordBatch.from_arrays([*kept, *made], [*others, *PAGES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rows, size = [], [], 0
            for i, data in enumerate(batch.column("media")):
                for row in rows_of(data.as_py()) if data.is_valid else ():
                    files.append(i)
                    rows.append(row)
                    size += len(row[6] or b"")
                    if size > ROWS_BYTES:
                        yield batch_of(batch, files, rows)
                        files, rows, size = [], [], 0
            if rows:
                yield batch_of(batch, files, rows)

    kinds = ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in others), *(f"{c} {kind}" for c, kind in PAGES.items())])
    return media.select(*(f"`{c}`" for c in others), "media").mapInArrow(run, kinds)


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def media_digests(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` of ``store_texts`` to ``DIGESTS``, all from the rows of the pages read back.

    ``feature`` is pages, rows and the sums of the red, green and blue samples. A file that
    cannot be read raises ValueError.
    """
    names, kinds = zip(*(c.split() for c in DIGESTS.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def ended() -> tuple:
            head, sha, tail, size, n_pages, n_rows, sums, whole = now
            feature = f"pages={n_pages} rows={n_rows} rgb={','.join(map(str, sums.tolist()))}"
            return *head, size, sha.hexdigest(), zlib.crc32(tail), *whole, feature

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], _ARROW[kind]) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "samples"}
            for i, samples in enumerate(batch.column("samples")):
                if column["error"][i] is not None:
                    raise ValueError(column["error"][i])
                if column["page"][i] == 0:
                    if now:
                        done.append(ended())
                    head = (column["doc_id"][i], column["n_bytes"][i])
                    now = [head, hashlib.sha256(), b"", 0, 0, 0, np.zeros(CHANNELS, np.int64), (column["media_bytes"][i], column["media_sha256"][i])]
                part = memoryview(samples.as_buffer())
                now[1].update(part)
                now[2] = (now[2] + bytes(part[-16:]))[-16:]
                now[3:6] = now[3] + len(part), now[4] + 1, now[5] + column["height"][i]
                now[6] += np.frombuffer(part, np.uint8).reshape(-1, CHANNELS).sum(axis=0, dtype=np.int64)
            if done:
                yield flushed()
                done = []
        if now:
            done.append(ended())
            yield flushed()

    return page_rows(media.select("doc_id", "n_bytes", "media")).mapInArrow(run, DIGESTS)
