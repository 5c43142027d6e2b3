import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from test_token_records import hard_texts

from corpusloom.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    return B.Bpe.load(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def test_same_ids_as_the_library(model, library):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() + hard_texts()
    for t in texts:
        assert model.encode(t) == library.encode_ordinary(t), repr(t[:80])
    ids, off = B.ChunkCache(lambda chunks: map(model.encode, chunks)).ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [library.encode_ordinary(t) for t in texts]


def test_other_vocabulary(library):
    other = B.Bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("b", pat_str=P.PATTERN, mergeable_ranks=other.ranks, special_tokens={})
    for t in hard_texts() + ["=" * 3000, "a" * 777, "ab" * 500]:
        assert other.encode(t) == lib.encode_ordinary(t)


def test_unknown_characters_are_classed_as_the_library_does(model, library):
    import unicodedata

    odd = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and B.regex.match(r"[\p{L}\p{N}\s]", chr(c))]
    for c in odd[:: max(1, len(odd) // 60)]:
        for t in (f"a{c}1 {c}b!{c}", f"{c}{c} {c}'s"):
            assert model.encode(t) == library.encode_ordinary(t), hex(ord(c))


def test_every_prefix_and_edits(model):
    rng = random.Random(4)
    for _ in range(150):
        data = bytes(rng.choice(b"thenatio \xc3\xa9er") for _ in range(rng.randint(0, 60)))
        table = B.PrefixTable(model, data[:10])
        table.append(data[10:])
        assert all(table.ids(i) == model.merge(data[:i]) for i in range(len(data) + 1))
        for _ in range(5):
            a = rng.randint(0, len(table.data))
            b = rng.randint(a, min(len(table.data), a + 8))
            table.edit(a, b, bytes(rng.choice(b"then") for _ in range(rng.randint(0, 6))))
            assert table.ids() == model.merge(table.data) and len(table.last) == len(table.data) + 1


def test_an_edit_recomputes_its_surroundings_only(model):
    table = B.PrefixTable(model, b"thenation" * 2000)
    assert table.edit(50, 53, b"xyz") < 300
    assert table.ids() == B.PrefixTable(model, table.data).ids()


def test_operator(spark, library):
    rows = [(1, "Hello wörld", "x"), (1, "Hello wörld", "y"), (None, "don't", None), (2, None, "z"), (3, "", "z"), (4, "ab é" * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, B.encode_digests(df, PATH, P.PATTERN).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = B.encode_documents(df, PATH, P.PATTERN)
    back = B.decode_documents(encoded, PATH, P.PATTERN).collect()
    assert sorted(str(r.data.decode()) for r in back) == sorted(t or "" for _, t, _ in rows)
    assert B.encode_digests(df.limit(0), PATH, P.PATTERN).collect() == []


def test_a_chunk_of_very_many_ids():
    import numpy as np
    import pyarrow as pa

    from corpusloom.llm.chunked import ChunkCache

    n = (1 << 24) + 5
    cache = ChunkCache(lambda chunks: [np.arange(len(c), dtype=np.uint32) for c in chunks])
    for _ in range(2):
        ids, off = cache.ids(pa.array(["a b", "x" * n, None]))
        assert off.tolist() == [0, 3, 3 + n, 3 + n] and ids[3:].tolist()[-1] == n - 1
