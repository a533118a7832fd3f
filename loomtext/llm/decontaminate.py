"""Benchmark decontamination by winnowed fingerprints.

Of every window of ``WINDOW`` consecutive ``K``-word hashes the least is kept.
A span of WINDOW + K - 1 words that a document shares with a benchmark item
has the same windows in both, hence a common fingerprint; hits are extended
word by word to the whole shared span. So each shared span of that length is
found, whatever its place.

The fingerprints of documents and benchmark are joined by hash. A benchmark of
up to ``PART_BYTES`` of text, as measured, goes to the executors whole, so that
the join and the extension take one scan of the documents. A larger one is
joined by a shuffle on the hash; the documents and items that meet are then
brought together for the extension. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import kernel as K
from loomtext.llm.common import column, mapped, rid, text_column

GRAM, WINDOW, PART_BYTES = 8, 6, 32 << 20
SCHEMA = "doc_id long, item_id long, start_char long, end_char long, n_words long, item_words long"


@dataclass
class Index:
    """Words and sorted fingerprints of benchmark items."""

    item: pa.Array
    words: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    at: np.ndarray
    item_of: np.ndarray


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()


def small(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Index | None:
    """The whole benchmark as an index, if its texts are within ``part_bytes``."""
    items = _items(benchmark)
    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    # ids and places count as well
    if (size or 0) + 64 * n > part_bytes:
        return None
    t = items.orderBy("item_id", "text").toArrow().combine_chunks()
    ids, texts = (t.column(k).combine_chunks() if t.num_rows else pa.array([], k_) for k, k_ in ((0, pa.int64()), (1, pa.string())))
    return index(ids, texts)


def index(ids: pa.Array, texts: pa.Array, gram: int = GRAM, window: int = WINDOW) -> Index:
    w = K.words(texts)
    at, h = K.winnow(w, gram, window)
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    return Index(ids, w.hash, w.first, h, at, w.doc_of()[at] if len(at) else at)


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How many words x and y share from their start on."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def spans(texts: pa.Array, ix: Index, gram: int = GRAM, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, first character, end, words, item's words) of maximal shared spans."""
    for a, b in K.slices(texts):
        w = K.words(texts.slice(a, b - a))
        at, h = K.winnow(w, gram, window)
        lo, hi = np.searchsorted(ix.hash, h, "left"), np.searchsorted(ix.hash, h, "right")
        some = np.flatnonzero(hi > lo)
        if not len(some):
            continue
        docs = np.searchsorted(w.first, at[some], side="right") - 1
        chars = K.char_starts(w.data)
        found: dict[tuple[int, int, int], int] = {}
        for n, d in zip(some, docs):
            p, left, right = int(at[n]), int(w.first[d]), int(w.first[d + 1])
            for m in range(int(lo[n]), int(hi[n])):
                q, item = int(ix.at[m]), int(ix.item_of[m])
                i0, i1 = int(ix.first[item]), int(ix.first[item + 1])
                back = _reach(w.hash[max(left, p - (q - i0)) : p][::-1], ix.words[max(i0, q - (p - left)) : q][::-1])
                length = back + _reach(w.hash[p:right], ix.words[q:i1])
                if length >= gram + window - 1:
                    key = (int(d), item, p - back)
                    found[key] = max(found.get(key, 0), length)
        for (d, item, s), length in sorted(found.items()):
            o = chars[w.offsets[d]]
            yield a + d, item, int(chars[w.start[s]] - o), int(chars[w.end[s + length - 1]] - o), length, int(ix.first[item + 1] - ix.first[item])


def _rows(found: list[tuple], doc_id: pa.Array, item: pa.Array) -> pa.RecordBatch:
    c = list(zip(*found)) if found else [[]] * 6
    take = lambda ids, at: pc.take(ids, pa.array(at, pa.int64())).cast(pa.int64())
    return pa.RecordBatch.from_arrays([take(doc_id, c[0]), take(item, c[1]), *(pa.array(x, pa.int64()) for x in c[2:])], names=["doc_id", "item_id", "start_char", "end_char", "n_words", "item_words"])


def fingerprints(texts: DataFrame, name: str) -> DataFrame:
    """key, and the id ``name`` of each text (columns id and text) that keeps it."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, ids = text_column(b), column(b, name)
            for lo, hi in K.slices(t):
                w = K.words(t.slice(lo, hi - lo))
                at, h = K.winnow(w, GRAM, WINDOW)
                doc = np.searchsorted(w.first, at, side="right") - 1
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(h[new])), pa.array(ids[lo + doc[new]])], names=["key", name])

    return mapped(texts.select(name, "text"), f, f"key long, {name} long")


def joined(d: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contaminated`` by a join of fingerprints; ``d`` has rid, doc_id and text."""
    items = _items(benchmark).withColumn("iid", F.xxhash64("item_id", "text"))
    once = d.groupBy("rid", "doc_id", "text").agg(F.count("*").alias("times"))
    met = fingerprints(once, "rid").join(fingerprints(items, "iid"), "key").select("rid", "iid").distinct()
    pairs = met.join(items.select("iid", "item_id", F.col("text").alias("item")), "iid").join(once, "rid")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, times = column(b, "rid"), column(b, "times")
            cut = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1]]) if len(rid) else np.zeros(0, np.int64)
            for lo, hi in zip(cut, np.r_[cut[1:], len(rid)]):
                ids = b.column(b.schema.get_field_index("item_id")).slice(lo, hi - lo)
                found = list(spans(text_column(b).slice(lo, 1), index(ids, text_column(b, "item").slice(lo, hi - lo))))
                yield _rows(found * int(times[lo]), text_column(b, "doc_id").slice(lo, 1), ids)

    return mapped(pairs.select("rid", "doc_id", "text", "times", "item_id", "item").sortWithinPartitions("rid"), f, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, item_id, start_char, end_char, n_words, item_words: every
    maximal span of 13 words or more that a document shares with an item.

    Words are compared lower-cased and without punctuation, texts whole. Null
    or empty texts, and items under 13 words, share nothing. Null ids are
    passed on. A document row that repeats has its rows each time; an item that
    repeats whole counts once. Several items with the same span each give a
    row. Other columns are ignored; empty tables give no rows.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    ix = small(benchmark, part_bytes)
    if ix is None:
        return joined(d.withColumn("rid", rid()), benchmark)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(list(spans(text_column(b), ix)), b.column(0), ix.item)

    return mapped(d, f, SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` without the rows that share a span with the benchmark.

    Null and empty texts stay, rows that repeat stay or go together, all
    columns are kept. An empty table stays empty, an empty benchmark leaves
    all rows.
    """
    ix = small(benchmark, part_bytes)
    if ix is None:
        # ids of the texts themselves: 128 bits tell them apart
        have = docs.withColumns({"__a": F.xxhash64(F.col("text").cast("string")), "__b": F.xxhash64(F.lit("again"), F.col("text").cast("string"))})
        texts = have.where("text is not null").select(F.col("__a").alias("doc_id"), F.col("__b").alias("rid"), F.col("text").cast("string").alias("text")).distinct()
        bad = joined(texts, benchmark).select(F.col("doc_id").alias("__a")).distinct()
        bad = texts.select(F.col("doc_id").alias("__a"), F.col("rid").alias("__b")).join(bad, "__a")
        return have.join(bad, ["__a", "__b"], "left_anti").select(*docs.columns)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            keep[[r[0] for r in spans(text_column(b), ix)]] = False
            yield b.filter(pa.array(keep))

    return mapped(docs, f, docs.schema)
