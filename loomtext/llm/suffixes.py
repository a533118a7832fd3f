"""Repeated passages by a logarithmic family of suffix arrays.

The arrays are sparse: of all word suffixes they hold those that start at a
winnowed position, which a repeated passage has at the same place in each of
its copies, so every passage of ``SPAN`` words keeps at least one suffix. Words
rank by their hashes, and a suffix's leading ``SEED`` words are one 64-bit key.
Suffixes that agree in the key agree in SEED words or more; how far they agree
beyond, on both sides, the extension below finds from the texts, for the few
that are tied. No prefix lengths are stored.

``SuffixFamily`` takes batches. A batch's array is merge-scanned against every
level at hand: suffixes that share their leading words are long matches, and
each occurrence is written down once its key has a partner. Levels of equal
rank then merge with the batch into the next one, as in a binary counter, so
each suffix is rewritten a logarithmic number of times. Arrays are Parquet
tables bucketed and sorted by key: scans and merges need no shuffle. A key that
already has two occurrences stays as one entry, so that a passage of a million
copies costs the levels one row.

A family lives in a folder, with a manifest of its levels and of the batches'
documents and matches: a later session opens it, ``append``s further batches
and asks for ``passages``.

Matches are then extended in both directions. Every window of SPAN words
belongs to its least seed; windows of matched seeds are compared by their
hashes within the seed, and the equal ones are joined to maximal passages.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm import kernel as K
from loomtext.llm.common import column, keyed, mapped, text_column, union
from loomtext.runtime import drop, names, read_text, scratch, write_text, written

SPAN, SEED, BATCHES = 50, 25, 4
PASSAGES = "doc_id long, start_char long, end_char long, start_word long, n_words long"


def seeds(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """key, rid, pos: the sampled suffixes of keyed documents."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = text_column(b), column(b, "rid")
            for lo, hi in K.slices(texts):
                w = K.words(texts.slice(lo, hi - lo))
                at, h = K.winnow(w, seed, span - seed + 1)
                doc = np.searchsorted(w.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(h)), pa.array(ids[lo + doc]), pa.array((at - w.first[doc]).astype(np.int32))], names=["key", "rid", "pos"])

    return mapped(docs.select("rid", "text"), f, "key long, rid long, pos int")


class SuffixFamily:
    """Levels of suffix arrays; ``add`` returns the matches a batch brings.

    Without a folder the family is of this session and goes with ``close``.
    With one, which all executors have to reach, ``append`` keeps documents,
    matches and a manifest there, and ``close`` leaves them.
    """

    def __init__(self, spark: SparkSession, span: int = SPAN, seed: int = SEED, folder: str | None = None):
        self.spark, self.span, self.seed, self.folder = spark, span, seed, folder
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str, str]] = []  # rank, table, path; by falling rank
        self.batches: list[str] = []
        self.root = folder or scratch(spark)
        # a manifest for each state, the newest counts
        known = names(spark, f"{folder}/manifests", ".json") if folder else []
        if known:
            m = json.loads(read_text(spark, f"{folder}/manifests/{known[-1]}") or "")
            if (m["span"], m["seed"]) != (span, seed):
                raise ValueError(f"{folder} has spans of {m['span']} words and seeds of {m['seed']}")
            self.buckets, self.batches = m["buckets"], m["batches"]
            self.levels = [(rank, self._opened(path), f"{folder}/{path}") for rank, path in m["levels"]]

    def _opened(self, name: str) -> str:
        """A level written by another session, as a table of this one."""
        own = f"{name}_{uuid.uuid4().hex[:6]}"
        self.spark.sql(f"CREATE TABLE {own} (key BIGINT, rid BIGINT, pos INT, n INT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")
        return own

    def _store(self, df: DataFrame, kind: str) -> tuple[str, str]:
        name = f"suffix_{kind}_{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{name}"
        try:
            df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        except BaseException:
            self._drop(name, path)
            raise
        return name, path

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(self.spark, path)

    def append(self, docs: DataFrame) -> None:
        """Add a batch (doc_id, text) to a family with a folder. Documents that
        it has already, by id and text, are left out. Should this fail, the
        family in the folder stays what it was."""
        if not self.folder:
            raise ValueError("a family without a folder keeps no batches")
        docs = keyed(docs).dropDuplicates(["rid"])
        if self.batches:
            docs = docs.join(self._kept("docs").select("rid"), "rid", "left_anti").select(docs.columns)
        name = f"batch-{uuid.uuid4().hex[:12]}"
        docs.write.option("compression", "zstd").parquet(f"{self.folder}/{name}/docs")
        gone: list[tuple[str, str]] = []
        hits, path = self.add(self.spark.read.parquet(f"{self.folder}/{name}/docs"), gone=gone)
        hits.write.option("compression", "zstd").parquet(f"{self.folder}/{name}/hits")
        drop(self.spark, path)
        self.batches.append(name)
        levels = [(rank, path.rsplit("/", 1)[1]) for rank, _, path in self.levels]
        write_text(self.spark, f"{self.folder}/manifests/{len(self.batches):08d}.json", json.dumps({"span": self.span, "seed": self.seed, "buckets": self.buckets, "batches": self.batches, "levels": levels}))
        # only now does nothing name them any more
        for table, path in gone:
            self._drop(table, path)

    def _kept(self, what: str) -> DataFrame:
        return union([self.spark.read.parquet(f"{self.folder}/{b}/{what}") for b in self.batches])

    def passages(self) -> DataFrame:
        """As ``repeated_passages``, over all batches so far."""
        if not self.batches:
            return self.spark.createDataFrame([], PASSAGES)
        return _extended(self._kept("docs"), self._kept("hits"), self.span, self.seed)

    def add(self, docs: DataFrame, *, last: bool = False, gone: list[tuple[str, str]] | None = None) -> tuple[DataFrame, str]:
        """rid, pos of the occurrences that now have a partner: those of the
        batch and the single ones of the levels that the batch meets. ``docs``
        has rid and text; ``last`` leaves the levels as they are. Merged levels
        are dropped, or with ``gone`` put there for the caller to drop."""
        array = seeds(docs, self.span, self.seed).repartition(self.buckets, "key").distinct()
        # each scan and merge is a join of two bucketed tables, which needs no
        # shuffle (a union of them would either, or be wrong: see the README)
        name, path = self._store(array, "batch")
        new = self.spark.table(name)
        found = new.withColumn("n", F.count("*").over(Window.partitionBy("key")))
        met = []
        for _, t, _ in self.levels:
            level = self.spark.table(t)
            found = found.join(level.select("key", F.lit(2).alias("old")), "key", "left").withColumn("n", F.coalesce("old", "n")).drop("old")
            met.append(level.where("n = 1").join(new.select("key"), "key", "left_semi").select("rid", "pos"))
        hits = written(union([found.where("n > 1").select("rid", "pos"), *met]), "suffix-hits")
        if not last:
            level = new.groupBy("key").agg(F.min(F.struct("rid", "pos")).alias("o"), F.least(F.count("*"), F.lit(2)).cast("int").alias("n"))
            carry = (0, *self._store(level.select("key", "o.rid", "o.pos", "n"), "level"))
            while self.levels and self.levels[-1][0] == carry[0]:
                old = self.levels.pop()
                merged = self._merged(old, carry)
                for _, t, p in (old, carry):
                    self._drop(t, p) if gone is None else gone.append((t, p))
                carry = merged
            self.levels.append(carry)
        self._drop(name, path)
        return hits

    def _merged(self, x: tuple[int, str, str], y: tuple[int, str, str]) -> tuple[int, str, str]:
        """One level of the next rank from two of the same."""
        a, b = self.spark.table(x[1]).alias("a"), self.spark.table(y[1]).alias("b")
        both = F.col("a.n").isNotNull() & F.col("b.n").isNotNull()
        n = F.when(both, 2).otherwise(F.coalesce("a.n", "b.n")).alias("n")
        m = a.join(b, F.col("a.key") == F.col("b.key"), "full").select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("key", "rid", "pos")), n)
        return (x[0] + 1, *self._store(m, "level"))

    def close(self) -> None:
        """Forget the tables; without a folder the levels go as well."""
        for _, t, p in self.levels:
            if self.folder:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            else:
                self._drop(t, p)
        self.levels = []


def _owners(w: K.Words, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``span`` words: where each starts, its least seed (the
    leftmost of equals) and the seed's hash."""
    h = K.grams(w, seed)
    start = np.flatnonzero(w.left() >= span)
    if not len(start):
        return start, start, np.zeros(0, K.U64)
    least = K.slide(h, span - seed + 1, np.minimum)[start]
    at, _ = K.winnow(w, seed, span - seed + 1)
    i = np.searchsorted(at, start)
    while len(wrong := np.flatnonzero(h[at[i]] != least)):
        i[wrong] += 1
    return start, at[i], least


def windows(matched: DataFrame, span: int, seed: int) -> DataFrame:
    """key, rid, start, wins: for each matched seed the hashes of its windows,
    the first at word ``start``. ``matched`` has rid, text and the seeds' pos."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = text_column(b), column(b, "rid")
            pos = b.column(b.schema.get_field_index("pos"))
            for lo, hi in K.slices(texts):
                w = K.words(texts.slice(lo, hi - lo))
                hit = np.zeros(len(w.hash) + 1, dtype=bool)
                p = pos.slice(lo, hi - lo)
                hit[p.flatten().to_numpy() + np.repeat(w.first[:-1], p.value_lengths().to_numpy())] = True
                start, owner, key = _owners(w, span, seed)
                keep = hit[owner]
                start, owner, key = start[keep], owner[keep], key[keep]
                if not len(start):
                    continue
                begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                doc = np.searchsorted(w.first, start[begin], side="right") - 1
                wins = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(start)].astype(np.int32)), pa.array(K.signed(K.grams(w, span, start))))
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(key[begin])), pa.array(ids[lo + doc]), pa.array((start[begin] - w.first[doc]).astype(np.int32)), wins], names=["key", "rid", "start", "wins"])

    return mapped(matched.select("rid", "text", "pos"), f, "key long, rid long, start int, wins array<long>")


def passages(matched: DataFrame, runs: DataFrame, span: int) -> DataFrame:
    """The maximal passages, in words and characters."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = text_column(b), []
            runs = b.column(b.schema.get_field_index("runs"))
            for lo, hi in K.slices(texts):
                w = K.words(texts.slice(lo, hi - lo))
                chars = K.char_starts(w.data)
                for d in range(hi - lo):
                    r = runs.slice(lo + d, 1).flatten()
                    first, bits = r.field("start").to_numpy(), r.field("bits").to_numpy()
                    s = first[:, None] + np.arange(64)
                    s = np.sort(s[(bits[:, None] >> np.arange(64)) & 1 == 1])
                    cut = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + span])
                    a, e = s[cut], s[np.r_[cut[1:] - 1, len(s) - 1]] + span
                    o = chars[w.offsets[d]]
                    base = w.first[d]
                    out.append((np.full(len(a), lo + d), chars[w.start[base + a]] - o, chars[w.end[base + e - 1]] - o, a, e - a))
            c = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0])), *(pa.array(x.astype(np.int64)) for x in c[1:])], names=["doc_id", "start_char", "end_char", "start_word", "n_words"])

    joined = matched.select("doc_id", "rid", "text").join(runs, "rid").select("doc_id", "text", "runs")
    return mapped(joined, f, PASSAGES)


def repeated_passages(docs: DataFrame, span: int = SPAN, seed: int = SEED, batches: int = BATCHES) -> DataFrame:
    """doc_id, start_char, end_char, start_word, n_words: the maximal passages
    of which each run of ``span`` words occurs more than once in the corpus,
    in another document or again in the same one.

    Words are compared lower-cased, without punctuation. Null and empty texts
    and texts under ``span`` words have no passage. Rows equal in doc_id and
    text are one document; equal texts under different ids (or none) repeat
    each other whole; very long texts are read whole. Other columns are ignored;
    an empty table gives no rows.
    A window of ``span`` words holds at most 63 seeds' places: span - seed < 63.
    """
    if not 0 < span - seed < 63:
        raise ValueError("0 < span - seed < 63")
    spark = docs.sparkSession
    docs = keyed(docs)
    family = SuffixFamily(spark, span, seed)
    try:
        hits = [family.add(docs.where(F.pmod("rid", F.lit(batches)) == i), last=i == batches - 1) for i in range(batches)]
    finally:
        family.close()
    return _extended(docs, union([h for h, _ in hits]), span, seed, [p for _, p in hits])


def _extended(docs: DataFrame, hits: DataFrame, span: int, seed: int, done: list[str] | None = None) -> DataFrame:
    """The passages of keyed documents around the matched seeds (rid, pos)."""
    by_doc = hits.groupBy("rid").agg(F.collect_set("pos").alias("pos"))
    matched, _ = written(docs.join(by_doc, "rid").dropDuplicates(["rid", "doc_id", "text"]), "suffix-matched")
    for p in done or []:
        drop(docs.sparkSession, p)
    each = windows(matched, span, seed).repartition("key").select("key", "rid", "start", F.posexplode("wins").alias("i", "win"))
    same = each.withColumn("n", F.count("*").over(Window.partitionBy("key", "win"))).where("n > 1")
    run = same.groupBy("key", "rid", "start").agg(F.expr("bit_or(shiftleft(1L, i))").alias("bits"))
    runs = run.groupBy("rid").agg(F.collect_list(F.struct("start", "bits")).alias("runs"))
    return passages(matched, runs, span)
