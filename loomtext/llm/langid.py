"""Languages of documents and of the spans within them.

Script ranges come first: the script of a word, by its first letter, narrows
the languages it may be of to those that training saw in this script. Runs of
words of one script go to a Viterbi search over their candidates. A word's
score in a language is the sum of the log probabilities of its byte trigrams,
word ends included, relative to a uniform guess; changing the language between
two words costs ``SWITCH``. In a script that no trained language uses, words
get the language that the script stands for in ``SCRIPTS`` (kana make the Han
around it Japanese); letters of any other script have none, and are "und".

All sequences are cut in blocks of up to ``BLOCK`` words, which advance
together, word by word, from each possible state before the block; the blocks
of a sequence are then joined exactly, and each goes once more from the state
that came out. A long text thus takes as many numpy steps as a short one.

The trigram model is trained on about ``TRAIN_DOCS`` labelled documents of
each language, drawn by a hash of their identity from the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import kernel as K
from loomtext.llm.common import mapped, rid, text_column

TRAIN_DOCS, SWITCH, BLOCK, SLICE = 400, 12.0, 256, 1 << 20
BUCKETS = 1 << 16
#: a language writes in a script that this share of its training words has
USES = 0.05
#: script ranges and the one language that a script stands for if none is trained
RANGES = [
    ("", "41-5A 61-7A AA BA C0-2AF 1E00-1EFF 2C60-2C7F A720-A7FF FB00-FB06 FF21-FF3A FF41-FF5A"), ("el", "370-3FF 1F00-1FFF"), ("ru", "400-52F 1C80-1C8F 2DE0-2DFF A640-A69F"), ("hy", "530-58F FB13-FB17"),
    ("he", "590-5FF FB1D-FB4F"), ("ar", "600-6FF 750-77F 870-8FF FB50-FDFF FE70-FEFE"), ("hi", "900-97F A8E0-A8FF"), ("bn", "980-9FF"), ("pa", "A00-A7F"), ("gu", "A80-AFF"), ("or", "B00-B7F"), ("ta", "B80-BFF"),
    ("te", "C00-C7F"), ("kn", "C80-CFF"), ("ml", "D00-D7F"), ("si", "D80-DFF"), ("th", "E00-E7F"), ("lo", "E80-EFF"), ("bo", "F00-FFF"), ("my", "1000-109F"), ("ka", "10A0-10FF 1C90-1CBF"), ("am", "1200-139F"), ("km", "1780-17FF"),
    ("ja", "3040-30FF 31F0-31FF FF66-FF9F"), ("zh", "3400-4DBF 4E00-9FFF F900-FAFF 20000-3FFFF"), ("ko", "1100-11FF 3130-318F A960-A97F AC00-D7FF"),
]
SCRIPTS = [x for x, _ in RANGES]
_LATIN, _JA, _ZH, _OTHER, _NONE = 0, SCRIPTS.index("ja"), SCRIPTS.index("zh"), len(SCRIPTS), len(SCRIPTS) + 1
_SPANS = sorted((int(a, 16), int(z or a, 16), k) for k, (_, r) in enumerate(RANGES) for a, _, z in (x.partition("-") for x in r.split()))
_FROM, _TO, _OF = (np.array(x) for x in zip(*_SPANS))


@dataclass
class Model:
    """``score`` is float32 [BUCKETS, languages]; ``uses`` tells which script
    (in the order of SCRIPTS, then any other) which language writes in."""

    langs: list[str]
    score: np.ndarray
    uses: np.ndarray

    def names(self) -> list[str]:
        return [*self.langs, *(x for x in SCRIPTS if x and x not in self.langs)]


def _trigrams(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of the trigram around each byte of ``data``; what is no
    word counts as one kind of byte. And the bytes within words."""
    n = len(w.data)
    step = np.zeros(n + 1, dtype=np.int32)
    step[w.start] += 1
    np.subtract.at(step, w.end, 1)
    inside = np.cumsum(step[:n]) > 0
    x = np.zeros(n + 2, dtype=np.uint32)
    x[1:-1] = np.where(inside, w.data, 0)
    key = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    return (key >> np.uint32(16)).astype(np.int32), inside


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Trigram probabilities from labelled rows (columns text and lang)."""
    rows = docs.where("lang is not null and lang <> '' and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"), F.pmod(rid(), F.lit(1 << 30)).alias("__draw"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    drawn = [(F.col("lang") == x) & (F.col("__draw") < int(min(1.0, train_docs / counts[x]) * (1 << 30))) for x in langs]
    which = drawn[0]
    for d in drawn[1:]:
        which = which | d

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        used = np.zeros((len(langs), _NONE + 1), dtype=np.int64)
        for b in batches:
            lang, texts = b.column(0).to_pylist(), text_column(b)
            for lo, hi in K.slices(texts):
                w = K.words(texts.slice(lo, hi - lo))
                key, inside = _trigrams(w)
                which = np.array([langs.index(x) for x in lang[lo:hi]])
                of = np.repeat(which, np.diff(w.offsets))
                used += np.bincount(which[w.doc_of()] * (_NONE + 1) + scripts(w), minlength=used.size).reshape(used.shape)
                total += np.bincount(of[inside] * BUCKETS + key[inside], minlength=total.size).reshape(total.shape)
        total = np.r_[total.ravel(), used.ravel()]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    # the buckets bound the result: as many rows as languages times 65,536 at most
    sums = mapped(rows.where(which).select("lang", "text"), f, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(langs) * (BUCKETS + _NONE + 1))
    total[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    used = total[len(langs) * BUCKETS :].reshape(len(langs), -1)[:, :_NONE].T
    total = total[: len(langs) * BUCKETS].reshape(len(langs), BUCKETS) + 0.05
    score = np.log(total / total.sum(1, keepdims=True)) + math.log(BUCKETS)
    # a trigram that tells nothing about other text costs at most this much
    return Model(langs, np.ascontiguousarray(np.maximum(score, -4.0).T.astype(np.float32)), used >= np.maximum(USES * used.sum(0), 1))


def scripts(w: K.Words) -> np.ndarray:
    """The script of each word by its first letter; ``_NONE`` for digits."""
    if not len(w.start):
        return np.zeros(0, np.int8)
    at = np.minimum(w.start[:, None] + np.arange(4), len(w.data) - 1)
    c = w.data[at].astype(np.int32)
    lead, rest = c[:, 0], c & 0x3F
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 0x1F) << 6 | rest[:, 1], np.where(lead < 0xF0, (lead & 0xF) << 12 | rest[:, 1] << 6 | rest[:, 2], (lead & 7) << 18 | rest[:, 1] << 12 | rest[:, 2] << 6 | rest[:, 3])))
    k = np.maximum(np.searchsorted(_FROM, point, side="right") - 1, 0)
    out = np.where((_FROM[k] <= point) & (point <= _TO[k]), _OF[k], _OTHER).astype(np.int8)
    out[(lead >= ord("0")) & (lead <= ord("9"))] = _NONE
    return out


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH, block: int = BLOCK, cells: int = 1 << 22) -> np.ndarray:
    """Best state of each row of ``score`` [words, states]; sequence i has the
    rows first[i]:first[i + 1], none of which is empty. So many blocks advance
    at once as hold ``cells`` values."""
    states = score.shape[1]
    size = np.diff(first)
    parts = -(-size // block)
    seq = np.repeat(np.arange(len(size)), parts)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = first[:-1][seq] + nth * block
    length = np.minimum(first[1:][seq] - at, block)
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    some = max(1, cells // max(1, states * states))
    chunks = [slice(k, k + some) for k in range(0, len(at), some)]

    def living(c: slice) -> np.ndarray:
        """How many blocks of the chunk are longer than t, for each t."""
        return np.searchsorted(-length[c], -np.arange(int(length[c][0])), side="left")

    # through[b, i, s]: best score of block b that starts after state i and ends in s
    through = np.full((len(at), states, states), -1e18)
    through[:, np.arange(states), np.arange(states)] = 0.0
    for c in chunks:
        v = through[c]
        for t, n in enumerate(living(c)):
            x = v[:n]
            v[:n] = np.maximum(x, x.max(2, keepdims=True) - switch) + score[at[c][:n] + t][:, None, :]
    # join the blocks of each sequence
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    begin = np.cumsum(parts) - parts
    total = np.zeros((len(size), states))
    came = np.zeros((len(seq), states), dtype=np.int16)
    for k in range(int(parts.max()) if len(parts) else 0):
        on = np.flatnonzero(parts > k)
        b = place[begin[on] + k]
        x = total[on][:, :, None] + through[b]
        came[b] = x.argmax(1)
        total[on] = x.max(1)
    end = np.zeros(len(seq), dtype=np.int64)
    before = np.zeros(len(seq), dtype=np.int64)
    state = total.argmax(1) if len(size) else np.zeros(0, np.int64)
    for k in reversed(range(int(parts.max()) if len(parts) else 0)):
        on = np.flatnonzero(parts > k)
        b = place[begin[on] + k]
        end[b] = state[on]
        before[b] = came[b, state[on]]
        state[on] = before[b]
    out = np.zeros(len(score), dtype=np.int64)
    own = np.arange(states, dtype=np.int16)
    for c in chunks:
        live, here = living(c), at[c]
        v = np.full((len(here), states), -1e18)
        v[np.arange(len(here)), before[c]] = 0.0
        back = []
        for t, n in enumerate(live):
            x = v[:n]
            best = x.argmax(1)
            top = x[np.arange(n), best][:, None] - switch
            hop = top > x
            back.append(np.where(hop, best[:, None].astype(np.int16), own))
            v[:n] = np.where(hop, top, x) + score[here[:n] + t]
        now = end[c].copy()
        for t in reversed(range(len(live))):
            n = live[t]
            out[here[:n] + t] = now[:n]
            now[:n] = back[t][np.arange(n), now[:n]]
    return out


def labels(w: K.Words, model: Model, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Language (its place in the list, -1 for none) and score of each word."""
    names = model.names()
    n, states = len(w.start), len(model.langs)
    script = scripts(w)
    # where no trained language uses the script, the one that it stands for
    stands = np.array([names.index(x) if x else -1 for x in SCRIPTS] + [-1, -1])
    trained = np.r_[model.uses.any(1) if states else np.zeros(_OTHER + 1, bool), False]
    trained[_OTHER] = False
    lang = np.where(trained[script], -1, stands[script]).astype(np.int64)
    gain = np.where(lang >= 0, 1.0, 0.0)
    doc = w.doc_of()
    # digits go with what stands before them; kana make the Han around it Japanese
    flow = np.where(script == _NONE, -1, script)
    last = np.maximum.accumulate(np.where(flow >= 0, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    follows = (last >= 0) & (doc[np.maximum(last, 0)] == doc) if n else np.zeros(0, bool)
    carried = np.where(follows, flow[np.maximum(last, 0)], _LATIN) if n else flow
    kind = np.where(carried == _JA, _ZH, carried)
    run = np.cumsum(np.r_[True, (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])]) - 1 if n else np.zeros(0, np.int64)
    searched = trained[kind] | (kind == _ZH) & trained[_JA]
    if n:
        kana = (np.bincount(run, weights=script == _JA) > 0)[run]
        ours = (kind == _ZH) & kana & ~trained[_JA]
        lang[ours & (script != _NONE)] = names.index("ja")
        gain[ours & (script != _NONE)] = 1.0
        searched &= ~ours & ~((kind == _ZH) & ~kana & ~trained[_ZH])
    at = np.flatnonzero(searched)
    if len(at):
        key, inside = _trigrams(w)
        score = np.empty((len(at), states), dtype=np.float64)
        for s in range(states):
            # float64 sums: differences of a long running sum must stay exact enough
            total = np.r_[0.0, np.cumsum(np.where(inside, model.score[key, s], 0.0))]
            score[:, s] = total[w.end[at]] - total[w.start[at]]
        digit = script[at] == _NONE
        score[digit] = 0.0
        # a Han word beside kana may be of a language that uses only these
        uses = np.r_[model.uses, np.ones((1, states), bool)]
        uses[_ZH] |= uses[_JA]
        score[~uses[np.where(digit, kind[at], script[at])]] -= 1e6
        first = np.flatnonzero(np.r_[True, run[at][1:] != run[at][:-1]])
        best = viterbi(score, np.r_[first, len(at)], switch)
        lang[at] = best
        gain[at] = score[np.arange(len(at)), best]
    # a run of digits alone has no language
    lang[(script == _NONE) & ~follows] = -1
    other = (script == _NONE) & ~searched
    lang[other] = np.where(last[other] >= 0, lang[np.maximum(last[other], 0)], -1)
    lang[(script == _NONE) & ~follows] = -1
    gain[lang < 0] = 0.0
    return lang, gain, names


SCHEMA = "doc_id long, lang string, share double, keep boolean, spans array<struct<lang: string, start_char: long, end_char: long, n_words: long>>"


def _judge(texts: pa.Array, model: Model, switch: float) -> Iterator[tuple[list, ...]]:
    """lang, share, keep and spans of the texts, a slice at a time."""
    for lo, hi in K.slices(texts, SLICE):
        part = texts.slice(lo, hi - lo)
        w = K.words(part)
        lang, gain, names = labels(w, model, switch)
        doc = w.doc_of()
        docs, k = w.docs, len(names)
        per = np.bincount(doc * (k + 1) + lang + 1, minlength=docs * (k + 1)).reshape(docs, k + 1)[:, 1:] if len(doc) else np.zeros((docs, k), np.int64)
        worth = np.bincount(doc, weights=gain, minlength=docs)
        main, top = per.argmax(1), per.max(1)
        n = np.diff(w.first)
        keep = (top > 0) & (worth > 0)
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])]) if len(doc) else np.zeros(0, np.int64)
        stop = np.r_[cut[1:], len(doc)]
        known = lang[cut] >= 0 if len(cut) else np.zeros(0, bool)
        cut, stop = cut[known], stop[known[: len(stop)]] if len(known) else stop[:0]
        chars = K.char_starts(w.data)
        origin = chars[w.offsets[doc[cut]]]
        spans = pa.StructArray.from_arrays([pa.array(names).take(pa.array(lang[cut])), pa.array(chars[w.start[cut]] - origin), pa.array(chars[w.end[stop - 1]] - origin), pa.array(stop - cut)], names=["lang", "start_char", "end_char", "n_words"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[cut], np.arange(docs + 1)).astype(np.int32)), spans)
        yield lo, hi, [names[m] if t else "und" for m, t in zip(main, top)], top / np.maximum(n, 1), keep, lists


def languages(docs: DataFrame, model: Model | None = None, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang, share, keep, spans: one row for each row of ``docs``.

    ``lang`` has the most words (in a tie the one first in the alphabet of
    trained languages), ``share`` of them all. ``spans`` are the maximal runs of
    words of one language in order. Without a word in a known script, as with
    null and empty texts, lang is "und", share 0 and spans empty. ``keep`` is
    false for "und" and where the text's trigrams are, in its own best
    language, less likely than a uniform guess. Labels come from column lang,
    if there is no model; without any labelled row only scripts are told apart.
    Rows that repeat each have their row; other columns are ignored.
    """
    model = model or train(docs)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, lang, share, keep, spans in _judge(text_column(b), model, switch):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang), pa.array(share), pa.array(keep), spans], names=["doc_id", "lang", "share", "keep", "spans"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), f, SCHEMA)


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows whose language can't be told, as ``languages``
    has it in ``keep``: null and empty texts and texts without a word go, rows
    that repeat stay or go together, very long texts are read whole. All
    columns are kept; an empty table stays empty.
    """
    model = model or train(docs)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [k for _, _, _, _, k, _ in _judge(text_column(b), model, SWITCH)]
            yield b.filter(pa.array(np.concatenate(keep))) if keep else b

    return mapped(docs, f, docs.schema)
