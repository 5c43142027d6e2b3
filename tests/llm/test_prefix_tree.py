import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import shingles as S
from corpusloom.llm.prefix_tree import Union, link_sets


def components(n, pairs):
    u = Union(n)
    for a, b in pairs:
        u.join(a, b)
    return [u.find(i) for i in range(n)]


def brute(sets, sizes, percent):
    out = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(set(sets[i]) & set(sets[j]))
            if both and 100 * both >= percent * (sizes[i] + sizes[j] - both):
                out.append((i, j))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(2, 30))
def test_same_components_as_all_pairs(seed, n, vocabulary):
    rng = random.Random(seed)
    base = [sorted(rng.sample(range(vocabulary), rng.randint(1, vocabulary))) for _ in range(max(1, n // 4))]
    sets = []
    for _ in range(n):
        s = {x for x in rng.choice(base) if rng.random() < 0.92} | {rng.randrange(vocabulary)}
        sets.append(np.array(sorted(s)))
    sizes = [len(s) + rng.randint(0, 2) for s in sets]
    got = components(n, link_sets(sets, sizes, vocabulary, 75))
    assert got == components(n, brute(sets, sizes, 75))
    q = [i for i in range(n) if rng.random() < 0.3]
    links = link_sets(sets, sizes, vocabulary, 75, None, q)
    want = [(a, b) for a, b in brute(sets, sizes, 75) if (a in q) != (b in q)]
    assert components(n, links) == components(n, want)


def test_many_alike_sets():
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(100), 92))) for _ in range(700)]
    got = components(700, link_sets(sets, [92] * 700, 100, 75))
    assert got == [0] * 700


def test_blobs_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 2, 1000):
        h = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        o = rng.integers(0, 65536, len(h)).astype(np.uint16)
        a, b = S.unpack(S.pack(h, o))
        assert np.array_equal(a, h) and np.array_equal(b, o)
        parts = list(S.shard_bounds(h, 48, 7))
        assert sum(e - s for _, s, e in parts) == len(h)
        assert all(int(x) * 7 >> 48 in (k - 1, k) for k, s, e in parts for x in h[s:e])


def test_shingles_of_short_and_repeated_texts():
    t = ["", None, "a", "A", "a b c d", "a b c d e", "a b c d e f", "A B c d E  F", "x x x x x x x", "a\tb c d"]
    h, d, n = S.shingle_sets(pa.array(t, pa.string()), 5)
    assert n.tolist() == [0, 0, 1, 1, 1, 1, 2, 2, 1, 1]
    sets = [set(h[d == i].tolist()) for i in range(len(t))]
    assert sets[2] == sets[3] and sets[6] == sets[7] and sets[5] < sets[6] and sets[4] == sets[9] and not sets[4] & sets[5]
    sig = S.signatures(h, d, len(t))
    assert np.array_equal(sig[6], sig[7]) and not np.array_equal(sig[5], sig[6])
    assert S.sig_bytes(sig)[6].as_py() == sig[6].tobytes()
