import random
import re

from corpusloom.llm import ngram_join as J
from corpusloom.llm.prefix_tree import Union

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    u = Union(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                u.join(i, j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        r = u.find(i)
        ids[r] = min((x for x in (d, ids.get(r)) if x is not None), default=None)
    return sorted(((d, len(sets[i]), ids[u.find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.randint(5, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.3:
            t += passage[: rng.randint(0, 60)]
        if rng.random() < 0.1:
            t = t[: rng.randint(0, 6)]
        rows.append((i * 3 % 401, rng.choice([" ", "\n", "  "]).join(t).upper() if rng.random() < 0.2 else " ".join(t)))
    return rows + [(None, rows[0][1]), (7000, None), (7001, ""), (7002, "  \n"), (rows[1][0], rows[1][1]), (rows[2][0], "other words")]


def got(df, **more):
    return sorted((tuple(r) for r in J.ngram_join(df, **more).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, sig string, n long")


def test_same_as_all_pairs(spark):
    rows = corpus(1)
    assert got(frame(spark, rows)) == brute(rows)


def test_groups_larger_than_a_block(spark):
    rows = corpus(2, 260)
    assert got(frame(spark, rows), block=10, anchors=2) == brute(rows)


def test_empty_and_single(spark):
    df = frame(spark, [(1, "a b c d e f")])
    assert got(df) == [(1, 2, 1)]
    assert got(df.limit(0)) == []


def test_long_text_and_its_copy(spark):
    t = " ".join(f"w{i}" for i in range(30000))
    assert got(frame(spark, [(5, t), (3, t + " tail"), (4, "x" * 100000)])) == [(3, 29997, 3), (4, 1, 4), (5, 29996, 3)]


def test_slices_bound_their_rows():
    import pyarrow as pa

    from corpusloom.llm import textscan

    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 100_000)], ["text"])
    sizes = [len(x) for x in textscan.slices(batch, "text")]
    assert sum(sizes) == 100_000 and max(sizes) <= textscan.SLICE_ROWS < 65_535


def test_shingles_of_a_long_text_in_parts():
    import pyarrow as pa

    from corpusloom.llm.textscan import word_hashes

    for text in ("", "Ab", "a b  c\n" * 40, "é" * 90 + " x", " " * 99, "One two\tTHREE four five six " * 9):
        one = pa.array([text])
        whole, parts = word_hashes(one, True), word_hashes(one, True, 16)
        assert (whole[0] == parts[0]).all() and len(whole[0]) == len(parts[0]) == len(text.split()) and not parts[1].any()
