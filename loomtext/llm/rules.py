"""Quality rules: a decision list learned from labelled documents.

Sequential covering: a rule is a conjunction of thresholds on text features,
grown condition by condition by information gain over the growing part of the
labelled rows, pruned on the other part, and kept if it is precise there; the
rows it covers leave, and the next rule is learned from the rest. The list is
a chain of Spark conditional expressions over feature columns.

One feature counts words that the labels themselves single out: words found in
many toxic and hardly any other labelled documents.

About ``TRAIN_ROWS`` labelled rows are used, drawn by a hash of doc_id: each by
itself, so their number varies by some square root of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import kernel as K
from loomtext.llm.common import column, mapped, text_column

TRAIN_ROWS, CUTS, MAX_CONDITIONS, MAX_RULES, MIN_COVER, MIN_PRECISION = 12_000, 24, 4, 24, 8, 0.8
FEATURES = ["n_words", "word_chars", "upper_share", "digit_share", "symbol_share", "distinct_share", "top_word_share", "repeated_line_share", "marked_words"]


def features(texts: pa.Array, marked: np.ndarray) -> np.ndarray:
    """float64 [texts, FEATURES]; ``marked`` are sorted word hashes."""
    out = []
    for lo, hi in K.slices(texts):
        part = texts.slice(lo, hi - lo)
        w = K.words(part)
        raw, o = K.buffers(part)
        n, docs = np.diff(w.first), w.docs
        share = lambda mask: np.add.reduceat(np.r_[mask, False].astype(np.int64), o[:-1]) * (np.diff(o) > 0) / np.maximum(np.diff(o), 1)
        doc = w.doc_of()
        word_bytes = np.bincount(doc, weights=w.end - w.start, minlength=docs)
        order = np.lexsort((w.hash, doc))
        h, d = w.hash[order], doc[order]
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.r_[new, len(h)])
        distinct = np.bincount(d[new], minlength=docs)
        top = np.zeros(docs)
        np.maximum.at(top, d[new], times)
        known = np.isin(h[new], marked)
        hits = np.bincount(d[new][known], weights=times[known], minlength=docs)
        upper = (raw >= ord("A")) & (raw <= ord("Z"))
        digit = (raw >= ord("0")) & (raw <= ord("9"))
        symbol = (raw > 0x20) & (raw < 0x7F) & ~np.isin(raw, np.frombuffer(b".,;:'\"-()?", np.uint8)) & ~digit & ~upper & ~((raw >= ord("a")) & (raw <= ord("z")))
        many = np.maximum(n, 1)
        out.append(np.stack([n, word_bytes / many, share(upper), share(digit), share(symbol), distinct / many, top / many, _repeated_lines(part), hits], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _repeated_lines(texts: pa.Array) -> np.ndarray:
    """Share of a text's lines that it had before."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = lines.value_lengths().to_numpy()
    doc = np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(np.unique(doc * (flat.max() + 1 if len(flat) else 1) + flat) // (flat.max() + 1 if len(flat) else 1), minlength=len(n))
    return 1 - distinct / np.maximum(n, 1)


def with_features(docs: DataFrame, marked: np.ndarray, extra: str = "") -> DataFrame:
    """doc_id and the features of each row (and the int columns named)."""
    names = extra.split()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(text_column(b), marked)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", *names)), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", *names, *FEATURES])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *names)
    return mapped(d, f, ", ".join(["doc_id long", *(f"{n} int" for n in names), *(f"{n} double" for n in FEATURES)]))


@dataclass(frozen=True)
class Rule:
    """All of (feature, is_at_least, threshold) hold."""

    conditions: tuple[tuple[int, bool, float], ...]
    bad_share: float
    covered: int

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), dtype=bool)
        for f, at_least, c in self.conditions:
            ok &= x[:, f] >= c if at_least else x[:, f] < c
        return ok

    def expression(self) -> Column:
        out = F.lit(True)
        for f, at_least, c in self.conditions:
            out = out & (F.col(FEATURES[f]) >= c if at_least else F.col(FEATURES[f]) < c)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'>=' if at_least else '<'} {c:.6g}" for f, at_least, c in self.conditions)


def _grow(x: np.ndarray, y: np.ndarray, conditions: list[tuple[int, bool, float]]) -> list[tuple[int, bool, float]]:
    tests = np.stack([x[:, f] >= c if g else x[:, f] < c for f, g, c in conditions], axis=1)
    on, chosen = np.ones(len(x), dtype=bool), []
    while len(chosen) < MAX_CONDITIONS and not y[on].all():
        p0, n0 = y[on].sum(), (~y[on]).sum()
        p, n = tests[on & y].sum(0), tests[on & ~y].sum(0)
        gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
        gain[p < MIN_COVER] = -1
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            break
        chosen.append(conditions[best])
        on &= tests[:, best]
    return chosen


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """The decision list for features x; what no rule covers is good."""
    bad = bad.astype(bool)
    prune = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    while len(rules) < MAX_RULES and bad[left].sum() >= MIN_COVER and not bad[left].all():
        grow, check = left & ~prune, left & prune
        if bad[grow].sum() < MIN_COVER:
            break
        conditions = []
        for f in range(x.shape[1]):
            # cuts at quantiles of both classes, so that a rare class has its own
            q = np.linspace(0, 1, CUTS + 1)
            v = np.unique(np.r_[np.quantile(x[left & bad, f], q), np.quantile(x[left & ~bad, f], q), 1.0 if FEATURES[f] == "marked_words" else np.nan])
            conditions += [(f, g, float(c)) for c in v[~np.isnan(v)] for g in (True, False)]
        chosen = _grow(x[grow], bad[grow], conditions)
        best: tuple[float, Rule | None] = (-1.0, None)
        for k in range(len(chosen), 0, -1):
            r = Rule(tuple(chosen[:k]), 0.0, 0)
            on = r.holds(x) & check
            p, n = int(bad[on].sum()), int((~bad[on]).sum())
            worth = (p - n) / (p + n) if p + n else -1.0
            if worth > best[0]:
                best = (worth, r)
        if best[1] is None or best[0] < 2 * MIN_PRECISION - 1:
            break
        on = best[1].holds(x) & left
        rules.append(Rule(best[1].conditions, float((bad[on].sum() + 1) / (on.sum() + 2)), int(on.sum())))
        left &= ~on
    return rules


def marked_words(sample: DataFrame, least: int = 5, share: float = 0.9) -> np.ndarray:
    """Sorted hashes of words that single out toxic rows of the sample.

    ``sample`` has text and toxic; a word counts once for each row. It has to be in
    ``least`` toxic rows that make up ``share`` of all rows with it. All such words
    count; the sample bounds how many there can be."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = column(b, "toxic").astype(bool)
            for lo, hi in K.slices(text_column(b)):
                w = K.words(text_column(b).slice(lo, hi - lo))
                doc = w.doc_of()
                order = np.lexsort((w.hash, doc))
                h, d = w.hash[order], doc[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
                word, at = np.unique(h[new], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(word)), pa.array(np.bincount(at, minlength=len(word))), pa.array(np.bincount(at[toxic[lo + d[new]]], minlength=len(word)))], names=["word", "n", "toxic"])

    rows = mapped(sample.select("text", "toxic"), f, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    got = rows.where((F.col("toxic") >= least) & (F.col("toxic") >= share * F.col("n"))).select("word").toArrow()
    return np.sort(got.column("word").to_numpy().view(np.uint64))


@dataclass
class RuleList:
    rules: list[Rule]
    marked: np.ndarray

    def number(self) -> Column:
        """Number of the first rule that holds: 1, 2, ..; 0 for none; -1 without a word."""
        out = F.when(F.col("n_words") == 0, -1)
        for i, r in enumerate(self.rules, 1):
            out = out.when(r.expression(), i)
        return out.otherwise(0)

    def names(self) -> dict[int, str]:
        return {-1: "no words", 0: "default", **{i: str(r) for i, r in enumerate(self.rules, 1)}}


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleList:
    """Learn from rows whose label says quality 0 or toxic 1 against the rest.

    Conflicting or null labels of a doc_id are left out."""
    sure = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("q"), F.max("toxic").cast("int").alias("toxic"), F.min("toxic").alias("t")).where("quality = q and toxic = t").select("doc_id", "quality", "toxic")
    n = sure.count()
    part = int(min(1.0, train_rows / max(n, 1)) * (1 << 30))
    drawn = sure.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part)
    # the draw is of train_rows rows at most, give or take chance: safe to broadcast
    sample = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), "doc_id")
    marked = marked_words(sample)
    t = with_features(sample, marked, "quality toxic").toArrow()
    x = np.stack([t.column(c).to_numpy() for c in FEATURES], axis=1) if t.num_rows else np.zeros((0, len(FEATURES)))
    bad = (t.column("quality").to_numpy() == 0) | (t.column("toxic").to_numpy() == 1)
    # rows in an order of their own, so that the same sample gives the same list
    order = np.lexsort((*x.T, t.column("doc_id").to_numpy())) if t.num_rows else np.zeros(0, np.int64)
    return RuleList(learn(x[order], bad[order]), marked)


def judged(docs: DataFrame, labels: DataFrame, model: RuleList | None = None) -> DataFrame:
    """doc_id, keep, rule, reason, p_bad: the verdict on each row of ``docs``.

    Rules come in order; the first that holds rejects the document, ``rule`` is
    its number and ``p_bad`` its share of bad labelled rows. Documents that no
    rule covers stay (rule 0, p_bad null). Texts without a word, null and empty
    ones among them, are rejected with rule -1. Without labels of both kinds
    the list is empty. Rows that repeat each have their verdict; other columns
    are ignored.
    """
    model = model or train(docs, labels)
    x = with_features(docs, model.marked).withColumn("rule", model.number())
    pick = lambda values, kind: F.element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), F.col("rule")).cast(kind)
    shares = {-1: 1.0, 0: None, **{i: r.bad_share for i, r in enumerate(model.rules, 1)}}
    return x.select("doc_id", (F.col("rule") == 0).alias("keep"), "rule", pick(model.names(), "string").alias("reason"), pick(shares, "double").alias("p_bad"))
