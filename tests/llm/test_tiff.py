import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import tiff as T


def image(seed, height, width, channels):
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 4, (height, width, channels)) * rng.integers(1, 60)).astype(np.uint8)


@pytest.mark.parametrize("compression", T.CODES)
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("order", "<>")
def test_round_trip(compression, predictor, tile, planar, order):
    images = [image(1, 37, 41, 3), image(2, 1, 1, 1), image(3, 70, 16, 4)]
    data = T.write(images, compression, predictor, 8, tile, planar, order)
    back = list(T.pages(data))
    assert [p[:3] for p in back] == [(41, 37, 3), (1, 1, 1), (16, 70, 4)]
    assert all(np.array_equal(p.samples, i) for p, i in zip(back, images))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 40))
def test_codecs(data, times):
    assert T.unpack_bits(T.pack_bits(data * times)) == data * times
    assert T.unpack_lzw(T.pack_lzw(data * times)) == data * times


def test_known_code_streams():
    assert T.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert T.unpack_lzw(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_long_lzw_and_damage():
    data = np.random.default_rng(1).integers(0, 256, 60000, dtype=np.uint8).tobytes()
    assert T.unpack_lzw(T.pack_lzw(data)) == data
    good = T.write([image(1, 30, 30, 3)])
    for bad in (b"", b"II", b"XX*\0" + good[4:], good[:40], good[:-3]):
        with pytest.raises(ValueError):
            list(T.pages(bad))
    loop = bytearray(T.write([image(1, 2, 2, 1)], "none", 1))
    loop[-4:] = loop[4:8]
    with pytest.raises(ValueError, match="do not end"):
        list(T.pages(bytes(loop)))


def test_operator(spark):
    rows = [(1, "a" * 191), (2, "a" * 192), (3, "é" * 97), (4, ""), (5, None), (None, "x"), (6, "long text " * 30000), (7, "a" * 191), (7, "a" * 191)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, media string")
    media = T.store_texts(df).cache()
    got = sorted((tuple(r)[:5] for r in T.media_digests(media).collect()), key=str)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        want.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want, key=str)
    shas = {r.media_sha256 for r in T.media_digests(media).where("doc_id in (1, 7)").collect()}
    assert len(shas) == 1
    rows = T.page_rows(media.where("doc_id = 6")).orderBy("page").collect()
    assert [r.page for r in rows] == [0, 1] and b"".join(bytes(r.samples) for r in rows).rstrip() == b"long text " * 29999 + b"long text"
    bad = spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.page, r.error) for r in T.page_rows(bad).collect()] == [(1, 0, "not a TIFF file")]
    assert T.media_digests(T.store_texts(df.limit(0))).collect() == []


def test_every_layout_is_on_the_path_of_the_texts(spark):
    rows = [(i, f"text {i} " * (i % 40)) for i in range(120)] + [(200, "w x " * 120_000), (201, "w y " * 120_000), (202, "w z " * 120_000), (203, "w u " * 120_000)]
    media = T.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    pages = T.page_rows(media).select("doc_id", "n_bytes", "page", "compression", "media_bytes").collect()
    assert {r.compression for r in pages} == {T.CODES[x["compression"]] for x in T.LAYOUTS} == {5, 8, 32773}
    assert max(r.page for r in pages) == 2 and all(r.media_bytes > 0 for r in pages)
    for r in T.media_digests(media).collect():
        text = dict(rows)[r.doc_id].encode()
        assert r.payload_sha256 == hashlib.sha256(T.payload_of(text)).hexdigest() and r.n_bytes == len(text)
    broken = media.limit(1).selectExpr("doc_id", "n_bytes", "substring(media, 1, 20) AS media")
    with pytest.raises(Exception, match="ValueError"):
        T.media_digests(broken).collect()
