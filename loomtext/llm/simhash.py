"""Near-duplicate groups by an LSH forest over 128-bit SimHashes.

Every document gets two SimHashes: of its set of words, which the forest
indexes, and of its set of 3-word shingles, which verifies. Equal signatures
are one node.

A tree of the forest is a trie over the 128 bits in a random order. Two
signatures at distance d share a prefix of b bits with probability
C(128-d, b) / C(128, b), so a longer prefix needs more trees for the same
recall. The tries are read at the depths of ``LEVELS``, each with as many trees
as reach ``RECALL`` at the outermost distance. A node looks at the shortest
prefixes first. In a bucket of up to ``DENSE`` nodes it is compared with every
other one. Where the bucket holds more, its nodes go down to the longer
prefixes of the next level, and to that level's trees: prefixes thus are as
long as the density at that place asks for, and nowhere so long that the trees
at hand would miss the target. What is too dense even at the last level is
compared whole, in chunks that go to different tasks. Nothing depends on the
size of the table, and no bucket is capped.

A pair is near when the words' hashes differ in at most ``RADIUS`` bits and
the shingles' in at most ``VERIFY``. Each pair is counted in the first bucket
that both its nodes share, so the number of links is exact without a list of
all pairs; a bucket gives the edges of a spanning forest only. Groups are the
connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import kernel as K
from loomtext.llm.common import batch, column, keyed, mapped, text_column, whole_groups
from loomtext.llm.components import components
from loomtext.runtime import drop, written

BITS, RADIUS, VERIFY, RECALL, DENSE, CHUNK = 128, 20, 40, 0.97, 4096, 2048
LEVELS = (14, 24)
U64 = np.uint64
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U64).ravel()


def _sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document the number of hashes with each of 128 bits set.

    Bits are spread to bytes of 64-bit lanes and added 255 rows at a time."""
    lanes = np.empty((len(h), 2), dtype=U64)
    lanes[:, 0], lanes[:, 1] = h, K.mix(h ^ U64(0xA0761D6478BD642F))
    lanes = _SPREAD[lanes.view(np.uint8)]
    sizes = np.diff(first)
    parts = (sizes + 254) // 255
    doc = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    rows = np.add.reduceat(lanes, first[:-1][doc] + nth * 255, axis=0) if len(doc) else np.zeros((0, 16), U64)
    out = np.zeros((len(sizes), BITS), dtype=np.int64)
    some = parts > 0
    if some.any():
        at = (np.cumsum(parts) - parts)[some]
        out[some] = np.add.reduceat(rows.view(np.uint8), at, axis=0, dtype=np.int64)
    return out


def _sets(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document and where each one's begin."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(docs + 1))


def simhashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint64 [texts, 4]: word and shingle SimHash; and the number of words."""
    out, words = [], []
    for a, b in K.slices(texts):
        w = K.words(texts.slice(a, b - a))
        doc = w.doc_of()
        h, first = _sets(w.hash, doc, w.docs)
        s1 = np.packbits(2 * _sums(h, first) > np.diff(first)[:, None], axis=1).view(U64)
        g = K.grams(w, 3)
        ok = g != K.MAX
        h, first = _sets(g[ok], doc[ok], w.docs)
        s3 = np.packbits(2 * _sums(h, first) > np.diff(first)[:, None], axis=1).view(U64)
        short = np.diff(w.first) < 3
        s3[short] = s1[short]
        out.append(np.concatenate([s1, s3], axis=1))
        words.append(np.diff(w.first))
    return (np.concatenate(out), np.concatenate(words)) if out else (np.zeros((0, 4), U64), np.zeros(0, np.int64))


def _again(text: str) -> Column:
    """With rid, which hashes text and doc_id, 128 bits that identify a row."""
    return F.xxhash64(F.lit("again"), F.col(text))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, rid, rid2, nid and the signature s0..s3 of rows with a word."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n = simhashes(text_column(b))
            keep = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(K.signed(np.ascontiguousarray(s[:, i]))) for i in range(4))], names=["doc_id", "rid", "rid2", "s0", "s1", "s2", "s3"]).filter(keep)

    d = keyed(docs).select("doc_id", "rid", _again("text").alias("rid2"), "text")
    sig = mapped(d, f, "doc_id long, rid long, rid2 long, s0 long, s1 long, s2 long, s3 long")
    return sig.withColumn("nid", F.xxhash64("s0", "s1", "s2", "s3"))


def share(d: int, depth: int) -> float:
    """Probability that a random prefix of ``depth`` bits misses d differing bits."""
    return math.exp(math.lgamma(BITS - d + 1) - math.lgamma(BITS - d - depth + 1) - math.lgamma(BITS + 1) + math.lgamma(BITS - depth + 1))


def trees(depth: int, radius: int = RADIUS, recall: float = RECALL) -> int:
    """How many trees of this depth find a pair at ``radius`` with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - share(radius, depth)))


@dataclass(frozen=True)
class Level:
    """Prefixes of one depth in all trees of a level."""

    depth: int
    bits: np.ndarray  # [trees, depth], places among the 128
    masks: np.ndarray  # uint64 [trees, 2]

    def prefixes(self, s: np.ndarray, t: int) -> np.ndarray:
        """The prefix of each signature (uint64 [rows, 2]) in tree t."""
        out = np.zeros(len(s), dtype=np.int64)
        for p in self.bits[t]:
            out = (out << 1) | ((s[:, p // 64] >> U64(p % 64)) & U64(1)).astype(np.int64)
        return out


def level(number: int, radius: int = RADIUS, recall: float = RECALL, depth: int | None = None, seed: int = 7) -> Level:
    depth = depth or LEVELS[number]
    n = trees(depth, radius, recall)
    bits = np.array([np.random.default_rng((seed, number, t)).permutation(BITS)[:depth] for t in range(n)])
    masks = np.zeros((n, 2), dtype=U64)
    for t in range(n):
        for p in bits[t]:
            masks[t, p // 64] |= U64(1) << U64(p % 64)
    return Level(depth, bits, masks)


def _near(s: np.ndarray, i, j, radius: int, verify: int) -> np.ndarray:
    c = np.bitwise_count
    return (c(s[0][i] ^ s[0][j]).astype(np.int16) + c(s[1][i] ^ s[1][j]) <= radius) & (c(s[2][i] ^ s[2][j]).astype(np.int16) + c(s[3][i] ^ s[3][j]) <= verify)


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make the labels of i and j equal: the least of what they reach."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _shares_earlier(s: np.ndarray, i: np.ndarray, j: np.ndarray, masks: np.ndarray, dense: np.ndarray | None) -> np.ndarray:
    """Pairs that one of the trees ``masks`` has in one bucket; ``dense`` has a
    bit for each tree whose bucket of the row was not compared."""
    out = np.zeros(len(i), dtype=bool)
    x, y = s[0][i] ^ s[0][j], s[1][i] ^ s[1][j]
    for t, m in enumerate(masks):
        same = ((x & m[0]) | (y & m[1])) == 0
        if dense is not None:
            same &= (dense[t >> 6][i] >> U64(t & 63)) & U64(1) == 0
        out |= same
    return out


def pairs_in(key: np.ndarray, s: np.ndarray, side: np.ndarray, radius: int, verify: int, *, fold: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of the near pairs among rows of equal key (rows sorted by key).

    Rows of one ``side`` (0 or 1) pair only with the other; those of side -1
    with each other."""
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    end = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, at, step = 0, np.arange(n), 1
    while len(at := at[at + step < end[at]]):
        hit = at[((side[at] < 0) | (side[at] != side[at + step])) & _near(s, at, at + step, radius, verify)]
        if len(hit):
            held.append((hit, hit + step))
            count += len(hit)
            if count >= fold:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, count = [], 0
        step += 1
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


ROWS = "key long, side int, tree int, nid long, n long, s0 long, s1 long, s2 long, s3 long"


def compared(rows: DataFrame, levels: list[Level], radius: int, verify: int) -> DataFrame:
    """a, b, links: for each bucket the edges of a spanning forest of its near
    nodes (links null), and for each node its links not counted elsewhere (b null)."""
    at_level = len(levels) - 1

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            key, tree, nid, n = (column(t, c) for c in ("key", "tree", "nid", "n"))
            s = np.stack([column(t, f"s{i}").view(U64) for i in range(4)])
            dense = [column(t, f"d{k}").view(U64) for k in range(-(-len(levels[0].masks) // 64))]
            label, links = np.arange(len(key)), np.zeros(len(key), dtype=np.int64)
            for i, j in pairs_in(key, s, column(t, "side"), radius, verify):
                _merge(label, i, j)
                new = np.ones(len(i), dtype=bool)
                if at_level:
                    new &= ~_shares_earlier(s, i, j, levels[0].masks, dense)
                for k in np.unique(tree[i]):
                    own = np.flatnonzero(new & (tree[i] == k))
                    new[own[_shares_earlier(s, i[own], j[own], levels[at_level].masks[:k], None if at_level else dense)]] = False
                np.add.at(links, i[new], n[j[new]])
                np.add.at(links, j[new], n[i[new]])
            edge, some = np.flatnonzero(label != np.arange(len(key))), np.flatnonzero(links)
            none = pa.nulls(len(edge), pa.int64())
            a, b = nid[edge], nid[label[edge]]
            yield batch(a=pa.array(np.maximum(a, b)), b=pa.array(np.minimum(a, b)), links=none)
            yield batch(a=pa.array(nid[some]), b=pa.nulls(len(some), pa.int64()), links=pa.array(links[some]))

    return mapped(rows.repartition("key").sortWithinPartitions("key"), f, "a long, b long, links long")


def forest(nodes: DataFrame, radius: int = RADIUS, verify: int = VERIFY, recall: float = RECALL, dense: int = DENSE, levels: list[Level] | None = None) -> DataFrame:
    """``compared`` for all levels of the forest over nodes (nid, n, s0..s3).

    The buckets of level 0 are counted; those that are too dense, of which
    there can be no more than trees times 2^depth, go to every task as bits."""
    first, last = levels or [level(i, radius, recall) for i in range(2)]
    base = "nid long, n long, s0 long, s1 long, s2 long, s3 long"
    nodes = nodes.select("nid", "n", "s0", "s1", "s2", "s3")
    places = len(first.masks) << first.depth
    words = -(-len(first.masks) // 64)

    def signature(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([column(b, f"s{i}").view(U64) for i in range(2)], axis=1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places, dtype=np.int64)
        for b in batches:
            s = signature(b)
            for t in range(len(first.masks)):
                total[t << first.depth : (t + 1) << first.depth] += np.bincount(first.prefixes(s, t), minlength=1 << first.depth)
        at = np.flatnonzero(total)
        yield batch(key=pa.array(at), size=pa.array(total[at]))

    sizes = mapped(nodes, counted, "key long, size long").groupBy("key").agg(F.sum("size").alias("size"))
    full_keys = sizes.where(F.col("size") > dense).select("key").toArrow().column("key").to_numpy()
    state = np.zeros(places, dtype=bool)
    state[full_keys] = True
    state = np.packbits(state, bitorder="little")  # a bit for each bucket, 86 kB for all

    def is_full(key: np.ndarray) -> np.ndarray:
        return (state[key >> 3] >> (key & 7).astype(np.uint8)) & 1 == 1

    def marked(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        """The batch with a bit for each full bucket, the keys, and the bits."""
        s = signature(b)
        keys = np.stack([first.prefixes(s, t) + (t << first.depth) for t in range(len(first.masks))])
        full = is_full(keys)
        bits = np.zeros((words, len(s)), dtype=U64)
        for t, x in enumerate(full):
            bits[t >> 6] |= x.astype(U64) << U64(t & 63)
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.array(K.signed(x)) for x in bits)], names=[*b.schema.names, *(f"d{k}" for k in range(words))]), keys, full

    def shallow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b, keys, full = marked(b)
            for t, (key, off) in enumerate(zip(keys, full)):
                on = ~off
                k = int(on.sum())
                x = b.filter(pa.array(on)) if k < len(on) else b
                yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(np.full(k, -1, np.int32)), pa.array(np.full(k, t, np.int32)), *x.columns], names=["key", "side", "tree", *x.schema.names])

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b, _, full = marked(b)
            yield b.filter(pa.array(full.any(0)))

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = signature(b)
            for t in range(len(last.masks)):
                key = last.prefixes(s, t) | (t << last.depth)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(s), t, np.int32)), *b.columns], names=["key", "tree", *b.schema.names])

    full = ", ".join(f"d{k} long" for k in range(words))
    found = compared(mapped(nodes, shallow, f"{ROWS}, {full}"), [first], radius, verify)
    if not len(full_keys):
        return found
    crowd, _ = written(mapped(nodes, crowded, f"{base}, {full}"), "simhash-crowd")
    rows = mapped(crowd, deep, f"key long, tree int, {base}, {full}")
    # what is too dense here as well is cut in chunks, each pair of which is a bucket
    over = mapped(crowd, deep, f"key long, tree int, {base}, {full}").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > dense)
    rows = rows.join(over, "key", "left").withColumn("chunks", F.ceil(F.coalesce("size", F.lit(1)) / F.lit(dense if dense < CHUNK else CHUNK)).cast("int"))
    rows = rows.withColumn("chunk", F.when(F.col("size").isNull(), 0).otherwise(F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int")))
    rows = rows.withColumn("other", F.explode(F.when(F.col("size").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    rows = rows.withColumn("side", F.when(F.col("chunk") == F.col("other"), -1).otherwise((F.col("chunk") > F.col("other")).cast("int")))
    rows = rows.withColumn("key", F.when(F.col("size").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))))
    rows = rows.select(*(c.split()[0] for c in ROWS.split(", ")), *(f"d{k}" for k in range(words)))
    return found.unionByName(compared(rows, [first, last], radius, verify))


def members(docs: DataFrame, radius: int = RADIUS, verify: int = VERIFY, recall: float = RECALL) -> tuple[DataFrame, list[str]]:
    """doc_id, rid, rid2, first (struct of these of the group's first), n, links:
    the rows of groups of two or more; and the paths it reads."""
    sig, p1 = written(signatures(docs), "simhash")
    nodes, p2 = written(sig.groupBy("nid", "s0", "s1", "s2", "s3").agg(F.count("*").alias("n")), "simhash-nodes")
    found, p3 = written(forest(nodes, radius, verify, recall), "simhash-found")
    comp, p = components(found.where("b is not null").select("a", "b"), name="simhash-components")
    near = found.where("b is null").groupBy(F.col("a").alias("nid")).agg(F.sum("links").alias("links"))
    # exact copies share a node: a node without edges is a group if it has several rows
    label = nodes.select("nid", "n").join(comp.select(F.col("node").alias("nid"), "component"), "nid", "left").where("n > 1 or component is not null").join(near, "nid", "left")
    label, p4 = written(label.select("nid", F.coalesce("component", "nid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "simhash-labels")
    rows, p5 = written(sig.select("doc_id", "rid", "rid2", "nid").join(label, "nid").select("doc_id", "rid", "rid2", "component", "links"), "simhash-rows")
    # null ids come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rid2")).alias("first")
    groups = rows.groupBy("component").agg(first, F.count("*").alias("n"))
    for old in (p1, p2, p3, p4, *p):
        drop(docs.sparkSession, old)
    return rows.join(groups.where("n > 1"), "component"), [p5]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, verify: int = VERIFY, recall: float = RECALL) -> DataFrame:
    """doc_id, group_id, group_size, n_links: each document of a group of near copies.

    ``group_id`` is the least doc_id of the group, which a deduplication keeps;
    ``n_links`` the number of other documents that are near this very one.
    Texts are compared whole. Rows without a word (null, empty, punctuation)
    are in no group. Rows that repeat, with the same doc_id or another, are
    copies of each other and each has its row here. A null doc_id is the last
    in order. Other columns are ignored. An empty table gives no rows.
    """
    rows, _ = members(docs, radius, verify, recall)
    return rows.select("doc_id", F.col("first.doc_id").alias("group_id"), F.col("n").alias("group_size"), F.col("links").alias("n_links"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns kept.

    The row with the least doc_id stays; rows equal in doc_id and text stay
    once. Rows without a word stay. An empty table stays empty. Very long
    texts are compared whole.
    """
    rows, _ = members(docs)
    extra = rows.where((F.col("rid") != F.col("first.rid")) | (F.col("rid2") != F.col("first.rid2"))).select(F.col("rid").alias("__rid"), F.col("rid2").alias("__rid2")).distinct()
    # one shuffle of the texts serves the join and the rows that repeat
    have = docs.withColumns({"__rid": F.xxhash64(F.col("doc_id").cast("long"), F.col("text")), "__rid2": _again("text")}).repartition("__rid", "__rid2")
    return have.join(extra, ["__rid", "__rid2"], "left_anti").dropDuplicates(["__rid", "__rid2"]).select(*docs.columns)
