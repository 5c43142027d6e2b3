"""Token ids in length-delimited binary records, with an offset index beside them.

A record is an 8-byte length, the masked CRC-32C of those bytes, the serialized sequence and
the masked CRC-32C of it (all little-endian). A sequence is the doc_id (8 bytes), flags
(4 bytes: bytes per id, and 256 if the doc_id is null) and the ids. Files hold ascending doc_ids, one
file for each range. An attempt writes a file of its own name; the index, a
Parquet table of (part, file, doc_id, offset, length, n_tokens), names the files that count,
so what a lost or repeated attempt leaves is never read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.chunked import ChunkCache
from corpusloom.llm.crc import crc32c, masked
from corpusloom.llm.sidecar import filesystem
from corpusloom.llm.store import bounded_batches, new_path
from corpusloom.llm.textscan import slices

FILE_BYTES = 32 << 20  # of text, for each file
INDEX = "part int, file string, doc_id long, offset long, length long, n_tokens long"
_ENCODERS: dict[str, ChunkCache] = {}


def _encoder(path: str) -> ChunkCache:
    """The worker's encoder of a ``tokenizers`` file."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        opens = np.zeros(tokenizer.get_vocab_size(), bool)
        opens[[i for token, i in tokenizer.get_vocab().items() if token[0] == "Ġ"]] = True  # the token starts with a space

        def encode(chunks: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

        def row(chunks: list[str]) -> list[np.ndarray]:
            ids = np.array(tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(opens[ids]).tolist()
            return [ids[x:y] for x, y in zip(starts, [*starts[1:], len(ids)])]

        _ENCODERS[path] = ChunkCache(encode, row)
    return _ENCODERS[path]


def serialize(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    flags = width | (256 if doc_id is None else 0)
    return struct.pack("<qI", doc_id or 0, flags) + ids.astype(f"<u{width}").tobytes()


def deserialize(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qI", data)
    return None if flags & 256 else doc_id, np.frombuffer(data, f"<u{flags & 255}", offset=12).astype(np.uint32)


def frames(parts: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in parts]
    a, b = masked(crc32c(lengths)), masked(crc32c(parts))
    return [n + struct.pack("<I", int(x)) + p + struct.pack("<I", int(y)) for n, p, x, y in zip(lengths, parts, a, b)]


def read_frames(stream) -> Iterator[list[bytes]]:
    """Lists of serialized sequences, a few MB at a time; raises ValueError where a length or a checksum is wrong."""
    held: list[tuple[bytes, bytes]] = []
    size, wrong = 0, ""
    while head := stream.read(12):
        n = struct.unpack("<Q", head[:8])[0] if len(head) == 12 else -1
        body = stream.read(n + 4) if 0 <= n < 1 << 40 else b""
        if n < 0 or len(body) != n + 4:
            wrong = "a record is cut short or its length damaged"
            break
        held.append((head, body))
        size += n
        if size > 4 << 20:
            yield _checked(held)
            held, size = [], 0
    if held:
        yield _checked(held)
    if wrong:
        raise ValueError(wrong)


def _checked(held: list[tuple[bytes, bytes]]) -> list[bytes]:
    heads, parts = [h[:8] for h, _ in held], [b[:-4] for _, b in held]
    for what, data, ends in (("length", heads, [h[8:] for h, _ in held]), ("data", parts, [b[-4:] for _, b in held])):
        if masked(crc32c(data)).tolist() != np.frombuffer(b"".join(ends), "<u4").tolist():
            raise ValueError(f"a record's {what} is damaged")
    return parts


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int | None, folder: str, width: int = 2) -> DataFrame:
    """Encode ``docs(doc_id, text)``, write record files and the index into ``folder``; the index, reread.

    Rows are ordered by doc_id (nulls first), then by a hash of the text. A null text is empty
    and, as every text, ends in ``end_id`` if one is given. ``width`` bytes hold an id; an id that they can't hold
    raises OverflowError.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES))
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cache, offset = TaskContext.get().partitionId(), _encoder(tokenizer_path), 0
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.records"
        out_fs, out_path = filesystem(name)
        stream = None
        for batch in batches:
            for piece in slices(batch, "text"):
                stream = stream or out_fs.open_output_stream(out_path)
                flat, off = cache.ids(piece.column("text"))
                if max(int(flat.max(initial=0)), *tail) >= 1 << (8 * width):
                    raise OverflowError(f"an id needs more than {width} bytes")
                ids = [np.append(flat[a:b], tail) for a, b in zip(off, off[1:])]
                doc_ids = piece.column("doc_id").to_pylist()
                framed = frames([serialize(d, x, width) for d, x in zip(doc_ids, ids)])
                stream.write(b"".join(framed))
                size = np.array([len(f) for f in framed], np.int64)
                starts = offset + np.cumsum(size) - size
                offset += int(size.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array([name] * len(ids)), piece.column("doc_id"), pa.array(starts),
                     pa.array(size), pa.array([len(x) for x in ids], pa.int64())],
                    ["part", "file", "doc_id", "offset", "length", "n_tokens"],
                )
        if stream is not None:
            stream.close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = kept.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame) -> DataFrame:
    """``(part, position, doc_id, start, n_tokens, ids_crc32)`` of every record in the index's files, read from the files.

    ``start`` counts the ids of all records before: a file's first from the index's totals, the rest from the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name, start in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "base"))):
                fs, path = filesystem(name)
                position = 0
                with fs.open_input_stream(path) as stream:
                    for parts in read_frames(stream):
                        rows = [deserialize(p) for p in parts]
                        n = np.array([len(x) for _, x in rows], np.int64)
                        begin = start + np.cumsum(n) - n
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part] * len(rows), pa.int32()), pa.array(np.arange(position, position + len(rows))),
                             pa.array([d for d, _ in rows], pa.int64()), pa.array(begin), pa.array(n),
                             pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in rows], pa.int64())],
                            ["part", "position", "doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        position += len(rows)
                        start += int(n.sum())

    # every row of a part that was committed names the same file
    files = index.groupBy("part").agg(F.min("file").alias("file"), F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # over a row for each file
    # a number of its own: without one the tiny list of files would go to one task
    placed = files.select("part", "file", before.alias("base")).repartition(max(1, files.count()), "part")
    return placed.mapInArrow(run, "part int, position long, doc_id long, start long, n_tokens long, ids_crc32 long")


def read_sequence(file: str, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one index entry, for reads in shuffled order."""
    fs, path = filesystem(file)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return deserialize(next(read_frames(pa.BufferReader(f.read(length))))[0])


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, start, n_tokens, ids_crc32)``, as read back from the record files.

    ``start`` is the number of ids of all records before it. One row for each row, null and repeated
    ids included; an empty table gives none. Other columns are ignored.
    """
    index = write_records(docs, tokenizer_path, end_id, folder or new_path(docs.sparkSession, "records"))
    return read_records(index).select("doc_id", "start", "n_tokens", "ids_crc32")
