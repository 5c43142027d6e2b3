"""Mixing sources to target weights by Pfair scheduling.

Each source's texts, in a shuffled but fixed order, are cut into blocks of equal size. Block k (from 0)
of a source of weight w is released at slot floor(k / w) and due at ceil((k + 1) / w);
the earliest deadline goes first among released blocks. With weights that sum to one every
block meets its deadline, so at each slot a source has had its share within less than one block.

Weights are exact, in integers, and the driver simulates every slot: 8 bytes for each block. When a source
runs out a new phase starts with the others' weights, until all rows have a place: nothing is dropped or
repeated. Where a ``period`` is given, weights are rounded to parts of it instead and its schedule repeats:
the deviation from the weights as given then grows with the input.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.store import materialize

RANGE_ROWS = 5_000


def parts_of(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole parts of ``period`` by largest remainder, one at least for each source."""
    if len(weights) > period:
        raise ValueError("more sources than slots in a period")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (parts[s] - exact[s], s))
    k = 0
    while sum(parts.values()) != period:
        step = 1 if sum(parts.values()) < period else -1
        s = by_rest[k % len(by_rest)] if step > 0 else max(parts, key=lambda s: (parts[s] - exact[s] if parts[s] > 1 else -1e9, s))
        parts[s] += step
        k += 1
    return parts


def one_period(parts: dict[str, int], period: int) -> dict[str, list[int]]:
    """The slots of each source's blocks in a period, by earliest deadline among released blocks."""
    slots: dict[str, list[int]] = {s: [] for s in parts}
    waiting = [(0, s) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            k = len(slots[s])
            heapq.heappush(ready, (-(-(k + 1) * period // parts[s]), s))
        due, s = heapq.heappop(ready)
        if due < t + 1:
            raise AssertionError("a deadline is missed")
        slots[s].append(t)
        k = len(slots[s])
        if k < parts[s]:
            heapq.heappush(waiting, (k * period // parts[s], s))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[dict]:
    """Phases of the schedule: ``start`` slot, ``parts``, ``slots``, and ``used``: blocks of each source before it."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used, start, out = dict.fromkeys(left, 0), 0, []
    while left:
        parts = parts_of({s: weights[s] for s in left}, period)
        slots = one_period(parts, period)
        last = lambda s, n: (n - 1) // parts[s] * period + slots[s][(n - 1) % parts[s]]
        end = min(last(s, n) for s, n in left.items()) + 1
        out.append({"start": start, "parts": parts, "slots": slots, "used": {s: used[s] for s in left}})
        whole, rest = divmod(end, period)
        for s in list(left):
            ran = whole * parts[s] + sum(x < rest for x in slots[s])
            used[s] += ran
            left[s] -= ran
            if left[s] <= 0:
                del left[s]
        start += end
    return out


def exact_slots(blocks: dict[str, int], weights: dict[str, float]) -> tuple[dict[str, np.ndarray], list[int]]:
    """(slots, starts): the slot of every block of every source, and each phase's first slot."""
    left = {s: blocks[s] for s in sorted(blocks) if blocks[s] > 0}
    exact = {s: Fraction(weights[s]) for s in left}
    scale = lcm(*(w.denominator for w in exact.values()))
    share = {s: int(w * scale) for s, w in exact.items()}
    slots = {s: np.zeros(n, np.int64) for s, n in left.items()}
    place, starts, t = dict.fromkeys(left, 0), [], 0
    whole = sum(share.values())
    while left:
        start, ran = t, dict.fromkeys(left, 0)
        starts.append(start)
        waiting: list[tuple[int, str]] = []
        ready = [(-(-whole // share[s]), s) for s in left]
        heapq.heapify(ready)
        while True:
            while waiting and waiting[0][0] <= t - start:
                _, s = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(ran[s] + 1) * whole // share[s]), s))
            due, s = heapq.heappop(ready)
            if due < t - start + 1:
                raise AssertionError("a deadline is missed")
            slots[s][place[s]] = t
            t += 1
            place[s] += 1
            ran[s] += 1
            if place[s] == left[s]:
                del left[s]
                whole -= share[s]
                break
            heapq.heappush(waiting, (ran[s] * whole // share[s], s))
    return slots, starts


def repeated_slots(blocks: dict[str, int], weights: dict[str, float], period: int) -> tuple[dict[str, np.ndarray], list[int]]:
    """As ``exact_slots``, of the schedule that repeats ``period`` slots."""
    plan = phases(blocks, weights, period)
    slots = {s: np.zeros(n, np.int64) for s, n in blocks.items() if n > 0}
    for p, ph in enumerate(plan):
        for s, part in ph["parts"].items():
            past = plan[p + 1]["used"].get(s, blocks[s]) if p + 1 < len(plan) else blocks[s]
            k = np.arange(past - ph["used"][s])
            slots[s][ph["used"][s] : past] = ph["start"] + k // part * period + np.array(ph["slots"][s], np.int64)[k % part]
    return slots, [ph["start"] for ph in plan]


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_bytes: int = 65536,
    period: int | None = None, seed: int = 17,
) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``(doc_id, source, block, phase, slot, offset, mark)``.

    Rows in order of (slot, offset) are the mix; ``offset`` is the byte of the block at which a row starts,
    ``mark`` a hash of id and text.
    ``weights`` gives target weights by source, 0 < w, in any scale; without it they follow the sources' bytes to
    the power ``temperature``. Every source has a weight of its own, however many there are; null and empty sources
    are one source. Where ``weights`` are given, sources without one have no target and share the mean of the
    others as the pool ''. With ``period`` weights are rounded to parts of so many slots. A text longer than a block
    takes the next blocks of its source, too. Null and empty texts count one byte. Every row gets one place; rows
    that repeat are rows of their own. An empty table gives none.
    """
    spark = docs.sparkSession
    source = F.col("source").cast("string")
    pool = F.coalesce(source, F.lit(""))
    if weights is not None:
        known = spark.createDataFrame([(s,) for s in weights if s], "pool string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), pool.alias("pool"),
        F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("at"),
    )
    if weights is not None:
        known = known.withColumn("named", F.lit(True))
        base = base.join(F.broadcast(known), "pool", "left").withColumn("pool", F.when(F.col("named"), F.col("pool")).otherwise("")).drop("named")
    base = materialize(base, "sizes")
    # one row for each source
    sizes = base.groupBy("pool").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    found = {r.pool: r for r in sizes.collect()}
    goal = {s: weights[s] if weights is not None else float(r.bytes) ** temperature for s, r in found.items() if s or weights is None}
    if "" in found and weights is not None:
        goal[""] = sum(goal.values()) / len(goal) if goal else 1.0

    # a source's order is that of the hash; ranges of the hash hold about as many rows in every source, so none is one task's
    wide = spark.createDataFrame([(s, -(-r.rows // RANGE_ROWS)) for s, r in found.items()], "pool string, wide long")
    spread = base.join(F.broadcast(wide), "pool").withColumn("range", F.floor((F.col("at").cast("double") / 2.0**64 + 0.5) * F.col("wide")).cast("int")).drop("wide")
    blocks = {s: -(-r.bytes // block_bytes) for s, r in found.items()}
    slots, first = exact_slots(blocks, goal) if period is None else repeated_slots(blocks, goal, period)
    # one row for each range: the byte where it starts, its first block, and the slots of its blocks
    at, rows = dict.fromkeys(found, 0), []
    held = spread.groupBy("pool", "range").agg(F.sum("size").alias("bytes"))
    for r in sorted(held.collect(), key=lambda r: (r.pool, r.range)):
        k = at[r.pool] // block_bytes
        part = slots[r.pool][k : (at[r.pool] + r.bytes - 1) // block_bytes + 1]
        rows.append((r.pool, r.range, at[r.pool], k, part, np.searchsorted(first, part, "right") - 1))
        at[r.pool] += r.bytes
    kinds = {"pool": pa.string(), "range": pa.int32(), "before": pa.int64(), "first": pa.int64(), "slots": pa.list_(pa.int64()), "phases": pa.list_(pa.int32())}
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], names=list(kinds))
    starts = spark.createDataFrame(table, "pool string, range int, before long, first long, slots array<long>, phases array<int>")
    inside = F.sum("size").over(Window.partitionBy("pool", "range").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        spread.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["pool", "range"])
        .withColumn("byte", F.col("before") + F.col("inside"))
        .withColumn("block", F.floor(F.col("byte") / block_bytes).cast("long"))
        .withColumn("offset", F.col("byte") % block_bytes)
    )
    k = (F.col("block") - F.col("first") + 1).cast("int")
    return placed.select(
        "doc_id", "source", "block", F.element_at("phases", k).alias("phase"), F.element_at("slots", k).alias("slot"), "offset", F.col("at").alias("mark")
    )


def mixed_documents(docs: DataFrame, files: int, seed: int = 17, **how) -> DataFrame:
    """All rows of ``docs``, with all their columns, in ``files`` partitions that follow the mix and are sorted by it.

    Rows with equal id and text stand at the first of their places.
    """
    places = mix_sources(docs, seed=seed, **how).groupBy("mark").agg(F.min(F.struct("slot", "offset")).alias("place"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    marked = docs.select(row, F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("mark"))
    placed = marked.join(places.hint("merge"), "mark")
    return placed.repartitionByRange(files, "place", "mark").sortWithinPartitions("place", "mark").select("row.*")
