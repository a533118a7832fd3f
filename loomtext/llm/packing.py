"""Packing of related documents into windows of equal length.

Documents get a sketch of ``BINS`` minima of 3-word shingle hashes, 4 bits of
each kept; equal sketches are one node. Each whole minimum is a key, and nodes
that agree in any of them are candidates of each other: at a resemblance of 0.05
with probability 0.96, at 0.02 with 0.73. Nodes that are no candidates agree in
no minimum at all. The share of equal bins ranks candidates, and the nearest
``NEIGHBOURS`` of a node are its neighbours in the graph, however far they are.

Every node is compared with every other one that has one of its keys, however
many those are. Where more than ``DENSE`` nodes have a key, they are cut in
chunks of about that size and each pair of chunks is compared by itself, so a
common key asks for more tasks and not for more memory.

Labels that spread to the least neighbour for ``ROUNDS`` rounds make clusters,
and clusters make parts of about ``PART`` nodes. Each part of the graph is
walked in greedy paths that start at the unvisited node of lowest degree and go
on to the nearest unvisited neighbour. Documents then lie in the order of the
paths and fill windows of ``WINDOW`` characters one after the other; one that
reaches over the end of a window continues in the next, so no text is lost and
windows hold no padding but the last of each shard. A shard is a set of whole
parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import kernel as K
from loomtext.llm.common import batch, column, keyed, mapped, text_column, whole_groups
from loomtext.runtime import drop, written

BINS, NEIGHBOURS = 64, 4
DENSE, PART, ROUNDS = 8192, 16_384, 3
WINDOW, SHARD = 16_384, 1 << 28
#: Groups of up to FEW nodes are compared together, larger ones in blocks of about BLOCK pairs.
FEW, BLOCK = 32, 1 << 16
U64 = np.uint64


def minima(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint64 [texts, BINS]: the least shingle hash in each of 64 ranges of
    hashes, an empty range borrowing from the next; and the number of words.
    Texts of one or two words count as one shingle."""
    out, words = [], []
    for lo, hi in K.slices(texts):
        w = K.words(texts.slice(lo, hi - lo))
        n = np.diff(w.first)
        g = K.grams(w, 3)
        for k in (1, 2):
            few = np.flatnonzero(n == k)
            g[w.first[few]] = K.grams(w, k)[w.first[few]]
        ok = g != K.MAX
        doc = w.doc_of()[ok]
        g = K.mix(g[ok])
        m = np.full(w.docs * BINS, K.MAX, dtype=U64)
        at = doc * BINS + (g >> U64(58)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at, g = at[order], g[order]
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        if len(at):
            m[at[begin]] = np.minimum.reduceat(g, begin)
        m = m.reshape(w.docs, BINS)
        empty = m == K.MAX
        have = ~empty.all(1)
        for step in range(1, BINS):
            if not empty[have].any():
                break
            fill = empty & (np.roll(~empty, -step, axis=1))
            borrowed = K.mix(np.roll(m, -step, axis=1) + U64(step))
            # only values that are a range's own are lent
            m = np.where(fill & (m == K.MAX), borrowed, m)
            if (m[have] != K.MAX).all():
                break
        out.append(m)
        words.append(n)
    return (np.concatenate(out), np.concatenate(words)) if out else (np.zeros((0, BINS), U64), np.zeros(0, np.int64))


def packed(m: np.ndarray) -> np.ndarray:
    """uint64 [rows, 4]: 4 bits of each minimum."""
    nibble = (K.mix(m ^ U64(0x5851F42D4C957F2D)) & U64(15)).reshape(len(m), 4, 16)
    return (nibble << (np.arange(16, dtype=U64) * U64(4))).sum(axis=2, dtype=U64)


def equal_bins(s: np.ndarray, i, j) -> np.ndarray:
    """How many of the 64 bins of sketches s[:, i] and s[:, j] agree."""
    total = np.int16(BINS)
    for k in range(4):
        x = s[k][i] ^ s[k][j]
        x = x | (x >> U64(2))
        x = (x | (x >> U64(1))) & U64(0x1111111111111111)
        total = total - np.bitwise_count(x).astype(np.int16)
    return total


def planes(s: np.ndarray) -> np.ndarray:
    """uint64 [4, rows]: plane p holds bit p of all 64 bins of sketches s[:, row],
    so that the bins which differ are the union of four xors."""
    low = U64(0x1111111111111111)
    return np.stack([sum(((s[k] >> U64(p)) & low) << U64(k) for k in range(4)) for p in range(4)])


def _nearest_of(p: np.ndarray, rows: np.ndarray, others: np.ndarray, k: int, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, other, agreeing bins) for each of ``rows`` its k nearest ``others``
    but itself; the first of ``others`` wins a tie. A block of rows at a time."""
    height = max(1, BLOCK // len(others))
    at = p[:, others]
    for lo in range(0, len(rows), height):
        i = rows[lo : lo + height]
        differ = p[0][i][:, None] ^ at[0]
        x = np.empty_like(differ)
        for q in range(1, 4):
            differ |= np.bitwise_xor(p[q][i][:, None], at[q], out=x)
        e = np.int8(BINS) - np.bitwise_count(differ).view(np.int8)
        e[i[:, None] == others] = -1
        each = np.arange(len(i))
        for _ in range(min(k, len(others))):
            j = e.argmax(axis=1)
            best = e[each, j]
            ok = best >= max(least, 0)
            yield i[ok], others[j[ok]], best[ok].astype(np.int16)
            e[each, j] = -1


def nearest_in(key: np.ndarray, s: np.ndarray, nid: np.ndarray, k: int, least: int = 0, side: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each row its k nearest of those with the same key (rows sorted by
    key) and at least ``least`` agreeing bins: (row, other, agreeing bins). All
    pairs are compared; only the nearest are held. Rows of one ``side`` (0 or 1)
    pair only with the other; those of side -1 with each other."""
    n = len(key)
    side = np.full(n, -1, dtype=np.int32) if side is None else side
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, n])
    out: list[tuple[np.ndarray, ...]] = []
    end = np.repeat(np.where(size <= FEW, start + size, 0), size)
    at, step = np.arange(n), 1
    while len(at := at[at + step < end[at]]):
        e = equal_bins(s, at, at + step)
        ok = (e >= least) & ((side[at] < 0) | (side[at] != side[at + step]))
        out += [(at[ok], at[ok] + step, e[ok]), (at[ok] + step, at[ok], e[ok])]
        step += 1
    p = planes(s)
    for a, m in zip(start[size > FEW], size[size > FEW]):
        rows = a + np.argsort(nid[a : a + m])
        for own, other in ((-1, -1), (0, 1), (1, 0)):
            i, j = rows[side[rows] == own], rows[side[rows] == other]
            if len(i) and len(j):
                out += _nearest_of(p, i, j, k, least)
    if not out:
        return (np.zeros(0, np.int64),) * 3
    i, j, e = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((nid[j], -e, i))
    i, j, e = i[order], j[order], e[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep], e[keep]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, rid, length, nid, s0..s3, m (the keys) of rows with a text."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_column(b)
            m, words = minima(texts)
            s = packed(m)
            keys = K.mix(m + np.arange(BINS, dtype=U64) * U64(0x9E3779B97F4A7C15))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * BINS), pa.array(K.signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.utf8_length(texts).cast(pa.int64()), pa.array(words), *(pa.array(K.signed(np.ascontiguousarray(s[:, k]))) for k in range(4)), lists], names=["doc_id", "rid", "length", "words", "s0", "s1", "s2", "s3", "m"])

    x = mapped(keyed(docs), f, "doc_id long, rid long, length long, words long, s0 long, s1 long, s2 long, s3 long, m array<long>").where("length > 0")
    return x.withColumn("nid", F.when(F.col("words") > 0, F.xxhash64("s0", "s1", "s2", "s3")).otherwise(F.xxhash64("rid", F.lit("wordless"))))


def candidates(nodes: DataFrame) -> DataFrame:
    """key, nid, n: the keys of nodes (nid, m) that n > 1 nodes have. By a count
    and a join, which splits a hot key as a window could not."""
    rows = nodes.select(F.explode("m").alias("key"), "nid")
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def chunked(rows: DataFrame, dense: int = DENSE) -> DataFrame:
    """``rows`` (key, nid, n and others) with ``side``: the groups to compare
    them in. A key that more than ``dense`` have is cut in chunks, and each pair
    of its chunks becomes a key with the chunks as sides 0 and 1, or -1 for a
    chunk with itself: all pairs of a key meet in just one group."""
    one = F.col("n") <= dense
    rows = rows.withColumn("chunks", F.ceil(F.col("n") / F.lit(dense)).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("side", F.when(F.col("chunk") == F.col("other"), -1).otherwise((F.col("chunk") > F.col("other")).cast("int")))
    rows = rows.withColumn("key", F.when(one, F.col("key")).otherwise(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))))
    return rows.drop("n", "chunks", "chunk", "other")


def neighbours(nodes: DataFrame, k: int = NEIGHBOURS, dense: int = DENSE) -> DataFrame:
    """a, b, equal: for each node (nid, s0..s3, m) its k nearest candidates."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            s = np.stack([column(t, f"s{i}").view(U64) for i in range(4)])
            nid = column(t, "nid")
            i, j, e = nearest_in(column(t, "key"), s, nid, k, side=column(t, "side"))
            yield batch(a=pa.array(nid[i]), b=pa.array(nid[j]), equal=pa.array(e.astype(np.int32)))

    # chunks are made of joined rows, so only the last shuffle has their copies
    rows = candidates(nodes).join(nodes.select("nid", "s0", "s1", "s2", "s3"), "nid")
    rows = chunked(rows, dense).select("key", "side", "nid", "s0", "s1", "s2", "s3")
    found = mapped(rows.repartition("key").sortWithinPartitions("key"), f, "a long, b long, equal int").distinct()
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("equal"), "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def clusters(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[str]]:
    """nid, label: the least hash that reaches a node within ``rounds`` steps;
    and the paths it reads."""
    both, p0 = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pack-both")
    label = both.groupBy(F.col("a").alias("nid")).agg(F.least(F.xxhash64("nid"), F.min(F.xxhash64("b"))).alias("label")) if rounds else both.select(F.col("a").alias("nid"), F.xxhash64("a").alias("label")).distinct()
    paths_ = [p0]
    for _ in range(rounds - 1):
        label, p = written(label, "pack-labels")
        paths_.append(p)
        near = both.join(label.select(F.col("nid").alias("b"), "label"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("near"))
        label = label.join(near, "nid").select("nid", F.least("label", "near").alias("label"))
    return label, paths_


def walk(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """The nodes of one part of the graph in the order of greedy paths. Edges
    count in both directions; ties go to the lower degree, then the lower id."""
    nodes = np.unique(np.r_[a, b])
    i, j = np.searchsorted(nodes, np.r_[a, b]), np.searchsorted(nodes, np.r_[b, a])
    edge = np.unique(np.stack([i, j, np.r_[equal, equal]]), axis=1)
    i, j, e = edge
    degree = np.bincount(i, minlength=len(nodes))
    order = np.lexsort((j, degree[j], -e, i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(len(nodes) + 1))
    seen = np.zeros(len(nodes), dtype=bool)
    out = []
    for at in np.lexsort((np.arange(len(nodes)), degree)):
        while not seen[at]:
            seen[at] = True
            out.append(at)
            onward = j[first[at] : first[at + 1]]
            onward = onward[~seen[onward]]
            if len(onward):
                at = onward[0]
    return nodes[out]


def paths(edges: DataFrame, part: DataFrame) -> DataFrame:
    """nid, place: each node's place in the walk of its part (columns nid and
    part), edges between parts left out."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "part"):
            of = column(t, "part")
            cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for lo, hi in zip(cut, np.r_[cut[1:], len(of)]):
                nodes = walk(*(column(t, c)[lo:hi] for c in ("a", "b", "equal")))
                yield batch(nid=pa.array(nodes), place=pa.array(np.arange(len(nodes))))

    rows = edges.join(part.select(F.col("nid").alias("a"), "part"), "a").join(part.select(F.col("nid").alias("b"), F.col("part").alias("other")), "b")
    rows = rows.where("part = other").select("part", "a", "b", "equal").repartition("part").sortWithinPartitions("part")
    return mapped(rows, f, "nid long, place long")


def filled(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """window_id, slot, doc_id, start_char, end_char: pieces of rows (shard,
    doc_id, length), which come sorted with each shard in one partition."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, slot = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            shard, length = column(b, "shard"), column(b, "length")
            new = np.r_[shard[0] != now, shard[1:] != shard[:-1]]
            end = np.cumsum(length)
            begin = end - length
            # characters of the shard before each row
            group = np.cumsum(new)
            base = np.r_[-used, begin[new]]
            before = begin - base[group]
            first = before // window
            last = (before + length - 1) // window
            pieces = last - first + 1
            row = np.repeat(np.arange(len(length)), pieces)
            w = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            a = np.maximum(w * window, before[row])
            e = np.minimum((w + 1) * window, before[row] + length[row])
            key = np.stack([shard[row], w])
            same = np.r_[False, (key[:, 1:] == key[:, :-1]).all(0)]
            if now == shard[0] and used and (used - 1) // window == w[0]:
                same[0] = True
            at = np.arange(len(row))
            opened = np.maximum.accumulate(np.where(same, -1, at))
            place = np.where(opened < 0, at + slot, at - np.maximum(opened, 0))
            slot = int(place[-1]) + 1
            now, used = int(shard[-1]), int(before[-1] + length[-1])
            yield pa.RecordBatch.from_arrays([pa.array((shard[row] << 32) | w), pa.array(place), b.column(b.schema.get_field_index("doc_id")).take(pa.array(row)), pa.array(a - before[row]), pa.array(e - before[row])], names=["window_id", "slot", "doc_id", "start_char", "end_char"])

    return mapped(rows, f, "window_id long, slot long, doc_id long, start_char long, end_char long")


def packs(docs: DataFrame, window: int = WINDOW, shard_chars: int = SHARD, part_nodes: int = PART, dense: int = DENSE) -> DataFrame:
    """window_id, slot, doc_id, start_char, end_char: which characters of which
    documents make up each window, in the order of ``slot``.

    Every character of every non-empty text is in exactly one window, each
    window but the last of a shard is full. Null and empty texts have no
    piece. Texts without a word are related to nothing. Repeated rows and equal
    texts lie side by side, by doc_id, nulls last. A very long text runs over
    as many windows as it needs. Other columns are ignored; an empty table has
    no windows.
    """
    spark = docs.sparkSession
    sk, _ = written(sketches(docs), "pack-sketches")
    nodes = sk.where("words > 0").groupBy("nid", "s0", "s1", "s2", "s3").agg(F.min("m").alias("m"))
    edges, p1 = written(neighbours(nodes, dense=dense), "pack-edges")
    label, old = clusters(edges)
    total, rows = sk.agg(F.sum("length"), F.approx_count_distinct("nid")).first()
    shards = max(1, -(-(total or 0) // shard_chars))
    # as many parts as nodes ask for; each lies in one shard
    parts = max(shards, -(-(rows or 0) // part_nodes))
    part, p2 = written(label.select("nid", F.pmod("label", F.lit(parts)).alias("part")), "pack-parts")
    place, p3 = written(paths(edges, part), "pack-paths")
    of = part.join(place, "nid", "left")
    rows = sk.select("doc_id", "rid", "length", "nid").join(of, "nid", "left").withColumn("part", F.coalesce("part", F.pmod(F.xxhash64("nid"), F.lit(parts))))
    rows = rows.withColumn("shard", F.pmod("part", F.lit(shards)))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "part", F.asc_nulls_last("place"), "nid", F.asc_nulls_last("doc_id"), "rid")
    for p in (p1, *old):
        drop(spark, p)
    return filled(rows.select("shard", "doc_id", "length"), window)
