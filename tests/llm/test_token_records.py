import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import token_records as R
from corpusloom.llm.crc import crc32c, masked

PATH = P.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def hard_texts():
    rng = random.Random(2)
    out = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n a", "don't we'll 've", "x　 y", "᠎ a", "<|endoftext|> b", "é è  ñ",
           "a  b", "1 2  3", "😀 😀😀  x", "\x1c a", "a\x1f b", "퟿ z"]
    alphabet = [" ", " ", " ", "\n", "\t", "a", "b", "é", "1", "!", "'", "s", "中", "　", " ", "\x1d", "͸", "ᲊ", "😀"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def test_chunked_encoding_equals_the_library():
    t, texts = library(), hard_texts()
    for _ in range(2):  # with an empty and with a filled cache
        ids, off = R._encoder(PATH).ids(pa.array(texts))
        for k, x in enumerate(texts):
            assert ids[off[k] : off[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_real_documents_encode_the_same():
    t = library()
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    ids, off = R._encoder(PATH).ids(texts)
    want = t.encode_batch(texts.to_pylist(), add_special_tokens=False)
    assert ids.tolist() == [i for e in want for i in e.ids] and np.diff(off).tolist() == [len(e.ids) for e in want]


def test_crc32c_known_values():
    parts = [b"", b"a", b"123456789", bytes(32), b"\xff" * 32, bytes(range(32)), b"x" * 5000]
    got = crc32c(parts).tolist()
    assert got[:6] == [0, 0xC1D04330, 0xE3069283, 0x8A9136AA, 0x62A8AB43, 0x46DD794E]
    state = 0xFFFFFFFF
    for b in parts[6]:
        state ^= b
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    assert got[6] == state ^ 0xFFFFFFFF


def test_damage_is_found():
    good = b"".join(R.frames([R.serialize(7, np.arange(50), 2), R.serialize(None, np.arange(0), 4)]))
    rows = [R.deserialize(p) for ps in R.read_frames(io.BytesIO(good)) for p in ps]
    assert rows[0][0] == 7 and rows[0][1].tolist() == list(range(50)) and rows[1][0] is None
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(R.read_frames(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(R.read_frames(io.BytesIO(good[:-1])))


ROWS = [(5, "five words are in here", "x"), (2, None, "y"), (9, "", None), (5, "again", "z"), (None, "no id", "w"), (1, "long " * 30000, "v")]


def test_operator_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, part string")
    t = library()
    want, start = [], 0
    for d, x, _ in sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0], 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(R.token_records(df, PATH, 2, str(tmp_path / "r")).collect(), key=lambda r: r.start)
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    assert [r.doc_id for r in got] == [None, 1, 2, 5, 5, 9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    index = spark.read.parquet(str(tmp_path / "r/index")).where("doc_id = 9").first()
    doc, ids = R.read_sequence(index.file, index.offset, index.length)
    assert doc == 9 and ids.tolist() == [2]
    assert R.token_records(df.limit(0), PATH, 2).collect() == []


def test_masked_is_invertible():
    c = np.array([0, 1, 0xFFFFFFFF, 12345], np.uint32)
    m = masked(c) - np.uint32(0xA282EAD8)
    assert np.array_equal((m >> np.uint32(17)) | (m << np.uint32(15)), c)


def test_files_are_read_in_as_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FILE_BYTES", 2000)
    docs = spark.createDataFrame([(i, f"some text {i} " * 20) for i in range(200)], "doc_id long, text string")
    index = R.write_records(docs, P.path("byte_bpe_50k.json"), 2, str(tmp_path / "r"))
    files = index.select("part").distinct().count()
    read = R.read_records(index)
    assert files > 10 and read.rdd.getNumPartitions() == files
    assert read.select("part", F.spark_partition_id().alias("task")).distinct().groupBy().agg(F.countDistinct("task")).first()[0] > files // 2
