import random
from collections import Counter, defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import mixing as M


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(0.001, 1), min_size=1, max_size=20), st.integers(20, 200))
def test_period_deviates_by_less_than_a_block(weights, period):
    parts = M.parts_of({f"s{i}": w for i, w in enumerate(weights)}, period)
    assert sum(parts.values()) == period and min(parts.values()) >= 1
    slots = M.one_period(parts, period)
    assert sorted(t for x in slots.values() for t in x) == list(range(period))
    for s, x in slots.items():
        due = Fraction(parts[s], period)
        for k, t in enumerate(x):
            assert abs(k - t * due) < 1 and abs(k + 1 - (t + 1) * due) < 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=8), st.integers(0, 10**6))
def test_phases_place_every_block_once(sizes, seed):
    rng = random.Random(seed)
    blocks = {f"s{i}": n for i, n in enumerate(sizes)}
    weights = {s: rng.random() + 0.01 for s in blocks}
    plan = M.phases(blocks, weights, 64)
    taken = set()
    for p, ph in enumerate(plan):
        for s in ph["parts"]:
            past = plan[p + 1]["used"].get(s, blocks[s]) if p + 1 < len(plan) else blocks[s]
            for b in range(ph["used"][s], past):
                k = b - ph["used"][s]
                taken.add(ph["start"] + k // ph["parts"][s] * 64 + ph["slots"][s][k % ph["parts"][s]])
    assert taken == set(range(sum(sizes)))


def rows(seed=1, n=3000):
    rng = random.Random(seed)
    out = [(i, "x" * rng.choice([0, 5, 50, 300, 3000]), rng.choice(["a"] * 5 + ["b", "c", None, ""]), 1) for i in range(n)]
    return out + [(70005, "again", "a", 1), (70005, "again", "a", 1), (None, None, "b", 1), (9001, "é" * 40000, "c", 1)]


def mixed(spark, data, **how):
    df = spark.createDataFrame(data, "doc_id long, text string, source string, slot int")
    return M.mix_sources(df, block_bytes=2000, period=100, **how).collect()


def test_every_row_has_a_place_and_weights_hold(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 200)
    data = rows()
    got = mixed(spark, data, weights={"a": 2, "b": 1, "c": 1})
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, _, s, _ in data)
    size = {(d, s): max(1, len((t or "").encode())) for d, t, s, _ in data}
    by = defaultdict(list)
    for r in got:
        by[r.source or ""].append(r)
    blocks, at = {}, {}
    for s, x in by.items():
        x.sort(key=lambda r: (r.slot, r.offset))
        byte = 0
        for r in x:
            assert (r.block, r.offset) == divmod(byte, 2000)
            at[s, r.block] = r.slot
            byte += size[r.doc_id, r.source]
        blocks[s] = -(-byte // 2000)
    plan = M.phases(blocks, {"a": 2, "b": 1, "c": 1, "": 4 / 3}, 100)
    taken = {}
    for p, ph in enumerate(plan):
        for s in ph["parts"]:
            past = plan[p + 1]["used"].get(s, blocks[s]) if p + 1 < len(plan) else blocks[s]
            for b in range(ph["used"][s], past):
                k = b - ph["used"][s]
                taken[s, b] = ph["start"] + k // ph["parts"][s] * 100 + ph["slots"][s][k % ph["parts"][s]]
    assert all(taken[k] == slot for k, slot in at.items())
    first = plan[0]["start"], plan[1]["start"]
    for s, part in plan[0]["parts"].items():
        mine = sorted(t for (x, _), t in taken.items() if x == s and t < first[1])
        assert all(abs(k + 1 - (t + 1) * part / 100) < 1 for k, t in enumerate(mine))


def test_defaults_and_empty(spark):
    data = rows(2, 200)
    got = mixed(spark, data)
    assert len(got) == len(data) and {r.phase for r in got} == set(range(max(r.phase for r in got) + 1))
    assert mixed(spark, data[:1])[0].slot == 0
    df = spark.createDataFrame(data, "doc_id long, text string, source string, slot int").limit(0)
    assert M.mix_sources(df).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.floats(0.001, 1)), min_size=1, max_size=20))
def test_exact_weights_hold_in_every_phase(sources):
    blocks = {f"s{i}": n for i, (n, _) in enumerate(sources)}
    weights = {f"s{i}": w for i, (_, w) in enumerate(sources)}
    slots, starts = M.exact_slots(blocks, weights)
    assert sorted(t for x in slots.values() for t in x) == list(range(sum(blocks.values())))
    ends = [*starts[1:], sum(blocks.values())]
    for start, end in zip(starts, ends):
        before = [s for s in slots if slots[s][-1] >= start]
        whole = sum(Fraction(weights[s]) for s in before)
        for s in before:
            w = Fraction(weights[s]) / whole
            mine = [int(t) - start for t in slots[s] if start <= t < end]
            for k, t in enumerate(mine):
                assert abs(k - t * w) < 1 and abs(k + 1 - (t + 1) * w) < 1
            assert abs(len(mine) - (end - start) * w) < 1


def test_equal_weights_do_not_drift(spark):
    data = [(i, "x" * 100, f"s{i % 20}", 1) for i in range(30_000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, slot int")
    by = defaultdict(list)
    for r in M.mix_sources(df, block_bytes=100).collect():
        by[r.source].append(r.slot)
    for x in by.values():
        assert all(abs(k + 1 - (t + 1) / 20) < 1 for k, t in enumerate(sorted(x)))


def test_more_sources_than_256_keep_their_weights(spark):
    data = [(i, "x" * 100, f"s{i % 300:03}", 1) for i in range(9_000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, slot int")
    weights = {f"s{i:03}": 1 if i < 299 else 30 for i in range(300)}
    for how in ({"weights": weights}, {"temperature": 0.0}):
        goal = weights if "weights" in how else dict.fromkeys(weights, 1)
        total = sum(goal.values())
        by = defaultdict(list)
        for r in M.mix_sources(df, block_bytes=100, **how).collect():
            if r.phase == 0:
                by[r.source].append(r.slot)
        for s, x in by.items():
            w = Fraction(goal[s], total)
            assert all(abs(k + 1 - (t + 1) * w) < 1 for k, t in enumerate(sorted(x)))
        assert set(by) == set(goal)
