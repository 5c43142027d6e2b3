"""Exact n-gram Jaccard join: candidates by rarity-ordered prefixes, links by prefix trees.

1. Every text becomes the set of its word shingles; equal sets are one node, known by a 128-bit signature.
2. A node can only be linked if at least ``percent`` of its shingles occur in another node
   as well. The shards of the hash space count that for all texts (``shingles``); few nodes remain.
3. Of those, the exact document frequency of each shingle gives the global order,
   rare ones first. Two linked sets share a shingle among the first (100 - percent)% of each; the components of that
   relation are the candidate groups.
4. Each group is linked with a prefix tree. Groups larger than ``block`` are dealt into
   blocks that also hold the group's anchors; what is not connected to the group's largest part
   after that is queried against every block of the group. No pair list of a group is ever made.
5. Components of the links, and the smallest doc_id of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import shingles as S
from corpusloom.llm.components import connected_components
from corpusloom.llm.prefix_tree import link_sets
from corpusloom.llm.store import bounded_batches, materialize
from corpusloom.llm.textscan import slices

CHUNK = 1 << 20  # shingles that a chunk of documents holds in memory
_BITS = 48
_U = np.uint64


def signed_documents(docs: DataFrame, size: int) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, sig)``, a row for each; sig is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_signed(part.column("text"), size)], ["doc_id", "n_shingles", "sig"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(run, "doc_id long, n_shingles long, sig binary")


def _signed(texts: pa.Array, size: int) -> tuple[pa.Array, pa.Array]:
    h, d, n = S.shingle_sets(texts, size)
    sig = S.sig_bytes(S.signatures(h, d, len(texts)))
    return pa.array(n, pa.int64()), pc.if_else(pa.array(n > 0), sig, pa.scalar(None, pa.binary()))


def _chunks(batches: Iterator[pa.RecordBatch], size: int):
    """(hash, doc, sizes, signatures) of bounded runs of documents; a signature comes once in a run."""
    held, total, seen, docs = [], 0, set(), 0
    for batch in batches:
        for part in slices(batch, "text"):
            h, d, n = S.shingle_sets(part.column("text"), size)
            sig = S.signatures(h, d, len(part))
            if docs + len(part) >= S.SHARED or total + len(h) > CHUNK:
                if held:
                    yield _joined(held)
                held, total, seen, docs = [], 0, set(), 0
            fresh = np.zeros(len(part), bool)
            for i in np.flatnonzero(n):
                key = sig[i].tobytes()
                if key not in seen:
                    seen.add(key)
                    fresh[i] = True
            keep, number = fresh[d], np.cumsum(fresh) - 1
            held.append((h[keep], number[d[keep]] + docs, n[fresh], sig[fresh]))
            docs += int(fresh.sum())
            total += int(keep.sum())
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([x[k] for x in held]) for k in range(4))


def _rows(rows: list[tuple], names: str = "shard chunk data") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        names.split(),
    )


def possible_nodes(docs: DataFrame, size: int, percent: int, shards: int) -> DataFrame:
    """``(sig, n, p1, p2)`` of the sets of which at least ``percent`` is held by other sets too.

    A superset: truncated hashes may collide, and copies in different chunks count as different sets.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, (h, d, n, sig) in enumerate(_chunks(batches, size)):
            chunk = (part << 24) + k
            h = h >> _U(64 - _BITS)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(new)
            several = np.diff(np.append(at, len(h))) > 1
            group = np.cumsum(new) - 1
            local = np.bincount(d[several[group]], minlength=len(n))
            number = np.where(several, S.SHARED, d[at])
            own = np.column_stack([sig, n.astype(_U), local.astype(_U)])
            yield _rows([(shards + chunk, chunk, own.tobytes())])
            yield _rows([(s, chunk, S.pack(h[at][a:b], number[a:b])) for s, a, b in S.shard_bounds(h[at], _BITS, shards)])

    def count(table: pa.Table) -> pa.Table:
        shard, chunks, blobs = table["shard"][0].as_py(), table["chunk"].to_numpy(), table["data"]
        if shard >= shards:
            return table.select(["shard", "chunk", "data"])
        parts = [S.unpack(b.as_py()) for b in blobs]
        h = np.concatenate([p[0] for p in parts])
        number = np.concatenate([p[1] for p in parts])
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(h, kind="stable")
        h = h[order]
        equal = np.zeros(len(h) + 1, bool)
        equal[1:-1] = h[1:] == h[:-1]
        hit = order[(equal[1:] | equal[:-1]) & (number[order] != S.SHARED)]
        key, times = np.unique(owner[hit] * 65536 + number[hit].astype(np.int64), return_counts=True)
        cuts = np.searchsorted(key, np.arange(len(parts) + 1) * 65536)
        out = []
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            a, b = cuts[k], cuts[k + 1]
            out.append((shard, int(chunks[k]), np.column_stack([key[a:b] % 65536, times[a:b]]).astype(np.uint32).tobytes()))
        return pa.Table.from_batches([_rows(out)])

    def judge(table: pa.Table) -> pa.Table:
        shard, blobs = table["shard"].to_numpy(), table["data"]
        own = np.frombuffer(blobs[int(np.flatnonzero(shard >= shards)[0])].as_py(), _U).reshape(-1, 4)
        shared = own[:, 3].astype(np.int64)
        for k in np.flatnonzero(shard < shards):
            pairs = np.frombuffer(blobs[int(k)].as_py(), np.uint32).reshape(-1, 2)
            shared[pairs[:, 0]] += pairs[:, 1]
        n = own[:, 2].astype(np.int64)
        sig = own[100 * shared >= percent * n][:, :2]
        return pa.table({
            "sig": S.sig_bytes(sig), "n": pa.array(n[100 * shared >= percent * n]),
            "p1": pa.array((sig[:, 0] >> _U(64 - BLOOM_BITS)).astype(np.int64)),
            "p2": pa.array((sig[:, 1] >> _U(64 - BLOOM_BITS)).astype(np.int64)),
        })

    triple = "shard long, chunk long, data binary"
    posted = docs.select("text").mapInArrow(post, triple)
    counted = posted.groupBy("shard").applyInArrow(count, triple)
    return counted.groupBy("chunk").applyInArrow(judge, "sig binary, n long, p1 long, p2 long")


BLOOM_BITS = 26  # the filter over possible nodes has 2**26 bits, 8 MB, whatever the input


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``(sig, n, h)``: the sets of ``nodes``, once each, read again from the texts.

    A filter of fixed size keeps the other texts from being shuffled; the join drops what it lets through.
    """
    spark = docs.sparkSession
    words = (
        nodes.select(F.explode(F.array("p1", "p2")).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits.view(_U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for h, d, n, sig in _chunks(batches, size):
            hit = np.ones(len(n), bool)
            for k in range(2):
                p = sig[:, k] >> _U(64 - BLOOM_BITS)
                hit &= (table[(p >> _U(6)).astype(np.int64)] >> (p & _U(63))) & _U(1) == 1
            if hit.any():
                off = np.zeros(int(hit.sum()) + 1, np.int32)
                np.cumsum(n[hit], out=off[1:])
                values = pa.array(h[hit[d]].view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [S.sig_bytes(sig[hit]), pa.array(n[hit], pa.int64()), pa.ListArray.from_arrays(pa.array(off), values)], ["sig", "n", "h"]
                )

    found = docs.select("text").mapInArrow(run, "sig binary, n long, h array<long>")
    return found.join(nodes.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"])


def ordered_sets(sets: DataFrame, percent: int, shards: int) -> DataFrame:
    """``(sig, n, items, dfs, prefix)``: each set's shared shingles in ascending (frequency, hash).

    ``prefix`` is how many of them lie in the set's prefix. Sets that too little of is shared are gone.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            h = batch.column("h").flatten().to_numpy().view(_U)
            own = np.column_stack([
                np.frombuffer(b"".join(batch.column("sig").to_pylist()), _U).reshape(-1, 2), batch.column("n").to_numpy().astype(_U),
            ])
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + k], pa.int64()), pa.array([own.tobytes()]), pa.array([h.tobytes()])], ["chunk", "own", "h"]
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("h")):
                h, count = np.unique(np.frombuffer(blob.as_py(), _U), return_counts=True)
                yield _rows([(s, chunk, h[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes()) for s, a, b in S.shard_bounds(h, 64, shards)])

    def answer(table: pa.Table) -> pa.Table:
        parts = [(len(b.as_py()) // 12, b.as_py()) for b in table["data"]]
        h = np.concatenate([np.frombuffer(b, _U, m) for m, b in parts])
        count = np.concatenate([np.frombuffer(b, np.uint32, m, 8 * m) for m, b in parts])
        _, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, weights=count).astype(np.uint32)[inverse]
        cuts = np.cumsum([0, *(m for m, _ in parts)])
        shard = table["shard"][0].as_py()
        return pa.Table.from_batches([
            _rows([(shard, c, total[a:b].tobytes()) for c, a, b in zip(table["chunk"].to_pylist(), cuts[:-1], cuts[1:])])
        ])

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.argsort(right["shard"].to_numpy())
        total = np.concatenate([np.frombuffer(right["data"][int(k)].as_py(), np.uint32) for k in at])
        h = np.frombuffer(left["h"][0].as_py(), _U)
        own = np.frombuffer(left["own"][0].as_py(), _U).reshape(-1, 3)
        n = own[:, 2].astype(np.int64)
        df = total[np.searchsorted(np.unique(h), h)].astype(np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        keep = df > 1
        shared = np.bincount(doc[keep], minlength=len(n))
        alive = 100 * shared >= percent * n
        keep &= alive[doc]
        h, df, doc = h[keep], df[keep], doc[keep]
        rank = np.lexsort((h, df, doc))
        off = np.concatenate([[0], np.cumsum(shared[alive])]).astype(np.int32)
        prefix = n - (percent * n + 99) // 100 + 1 - (n - shared)
        lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x[rank].view(np.int64))) for x in (h, df)]
        return pa.table([S.sig_bytes(own[alive][:, :2]), pa.array(n[alive]), *lists, pa.array(np.maximum(prefix, 0)[alive])],
                        ["sig", "n", "items", "dfs", "prefix"])

    chunks = materialize(sets.mapInArrow(gather, "chunk long, own binary, h binary"), "sets")
    triple = "shard long, chunk long, data binary"
    replies = chunks.select("chunk", "h").mapInArrow(ask, triple).groupBy("shard").applyInArrow(answer, triple)
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        order, "sig binary, n long, items array<long>, dfs array<long>, prefix long"
    )


def _group_links(table: pa.Table, percent: int) -> pa.Table:
    """Links within one group: rows (sig, n, items, dfs), and where given a label and whether the row is a query."""
    flat = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in table["items"].chunks)]).view(_U)
    freq = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in table["dfs"].chunks)])
    seen, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(seen), np.int64)
    rank[np.lexsort((seen, -freq[first]))] = np.arange(len(seen))
    cuts = np.cumsum([0, *(len(x) for x in table["items"])])
    ranks = rank[inverse]
    sig = table["sig"].to_pylist()
    place = {s: i for i, s in reversed(list(enumerate(sig)))}
    # a set may be there twice, as an anchor or as a query; its first place stands for it unless it is a query
    query = table["query"].to_pylist()
    rows = [i for i, s in enumerate(sig) if query[i] or place[s] == i or query[place[s]]]
    label: dict = {}
    labels = [label.setdefault(x, k) if x is not None else k for k, x in enumerate(table["label"][i].as_py() for i in rows)]
    links = link_sets(
        [np.sort(ranks[cuts[i] : cuts[i + 1]]) for i in rows], [table["n"][i].as_py() for i in rows], len(seen), percent,
        labels, [k for k, i in enumerate(rows) if query[i]] if any(query) else None,
    )
    return pa.table({
        "src": pa.array([sig[rows[a]] for a, _ in links], pa.binary()), "dst": pa.array([sig[rows[b]] for _, b in links], pa.binary()),
    })


def _links(groups: DataFrame, keys: list[str], percent: int) -> DataFrame:
    return groups.groupBy(*keys).applyInArrow(lambda t: _group_links(t, percent), "src binary, dst binary")


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """``(node, component)`` over the sets that share a shingle of their prefixes."""
    posted = nodes.where("prefix > 0").select("sig", F.explode(F.slice("items", F.lit(1), F.col("prefix").cast("int"))).alias("item"))
    least = posted.groupBy("item").agg(F.min("sig").alias("least"))
    return connected_components(
        posted.join(least, "item").where(F.col("sig") != F.col("least")).select(F.col("sig").alias("src"), F.col("least").alias("dst")).distinct()
    )


def link_groups(nodes: DataFrame, groups: DataFrame, percent: int, block: int, anchors: int) -> DataFrame:
    """``(src, dst)`` links that connect each group's sets as the threshold does."""
    size = groups.groupBy("component").agg(F.count("*").alias("members"))
    members = (
        nodes.select("sig", "n", "items", "dfs", "prefix")
        .join(groups.withColumnRenamed("node", "sig"), "sig").join(size, "component")
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("at", F.xxhash64("sig"))
        .withColumn("block", F.pmod("at", "blocks").cast("int"))
    )
    members = materialize(members, "members")
    none = F.lit(None).cast("binary")
    plain = members.select("component", "block", "sig", "n", "items", "dfs", none.alias("label"), F.lit(False).alias("query"))
    every = F.greatest(F.lit(1), F.ceil(F.col("members") / anchors))
    anchored = (
        members.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("sig", F.lit(7)), every) == 0))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(plain.columns[:6] + [none.alias("label"), F.lit(False).alias("query")])
    )
    links = materialize(_links(plain.unionByName(anchored), ["component", "block"], percent), "links")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return links
    found = connected_components(links).select(F.col("node").alias("sig"), F.col("component").alias("label"))
    large = large.join(found, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    sizes = large.groupBy("component", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("component").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    large = materialize(large.join(main, "component"), "large")
    apart = large.where(F.col("label") != F.col("main"))
    if apart.isEmpty():
        return links
    parts = apart.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    columns = ["component", "part", "block", "sig", "n", "items", "dfs", "label"]
    # linked sets share a shingle of their prefixes: a set is asked of the blocks that hold one of its own
    prefixes = lambda df, *of: df.where("prefix > 0").select("component", *of, F.explode(F.slice("items", F.lit(1), F.col("prefix").cast("int"))).alias("item"))
    wanted = prefixes(apart, "sig").join(prefixes(large, "block").distinct(), ["component", "item"]).select("component", "sig", "block").distinct()
    asked = (
        apart.drop("block").join(parts, "component").withColumn("part", F.pmod(F.xxhash64("sig", F.lit(11)), "parts").cast("int"))
        .join(wanted, ["component", "sig"]).select(*columns, F.lit(True).alias("query"))
    )
    asked = materialize(asked, "asked")
    where = asked.select("component", "part", "block").distinct()
    against = large.join(where, ["component", "block"]).select(*columns, F.lit(False).alias("query"))
    return links.unionByName(_links(asked.unionByName(against), ["component", "part", "block"], percent))


def ngram_join(
    docs: DataFrame, size: int = 5, percent: int = 75, block: int = 1024, anchors: int = 32
) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_shingles, component_id)``, one row for each row.

    Two rows link where 100 * intersection >= ``percent`` * union of their sets of
    ``size``-word shingles; ``component_id`` is the smallest doc_id reachable by links. Null and empty
    texts, and texts of white space, have the empty set and are linked with nothing. Rows that repeat an id are
    rows of their own; null ids never are the smallest, so a component of null ids alone has a
    null id. Other columns are ignored.
    """
    rooted, least = _rooted(docs, size, percent, block, anchors)
    return rooted.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 75, block: int = 1024, anchors: int = 32) -> DataFrame:
    """One row of ``docs``, with all its columns, of each component of ``ngram_join``: a row with the smallest id.

    Of rows with that id one stays. Texts without words are components of their own, so all of them stay.
    """
    _, least = _rooted(docs, size, percent, block, anchors)
    kinds = T.StructType([T.StructField("row", docs.schema), T.StructField("doc_id", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), _signed(part.column("text"), size)[1]], ["row", "doc_id", "sig"])

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = packed.mapInArrow(run, kinds)
    first = least.select(F.col("first.sig").alias("first_sig"), F.col("first.doc_id").alias("first_id"))
    # joined by id as well: a signature that a third of all rows has loads no task
    same = (F.col("sig") == F.col("first_sig")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    one = rows.join(first.hint("merge"), same).groupBy("sig", "doc_id").agg(F.first("row").alias("row")).select("row.*")
    return one.unionByName(rows.where("sig is null").select("row.*"))


def _rooted(docs: DataFrame, size: int, percent: int, block: int, anchors: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their signature and root, ``(root, first)``: the smallest (doc_id, sig) of each root, null ids last)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    signed = materialize(signed_documents(docs, size), "signed")
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / CHUNK))
    possible = materialize(possible_nodes(docs, size, percent, shards), "possible")
    nodes = materialize(ordered_sets(sets_of(docs, possible, size), percent, shards), "nodes")
    links = link_groups(nodes, candidate_groups(nodes), percent, block, anchors)
    root = connected_components(links).select(F.col("node").alias("sig"), F.col("component").alias("root"))
    rooted = signed.join(root, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig"))
    least = materialize(rooted.where("root is not null").groupBy("root").agg(first.alias("first")), "least")
    return rooted, least
