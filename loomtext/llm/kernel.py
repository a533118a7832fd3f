"""Vectorised text kernels over Arrow string columns.

Texts are processed as whole byte buffers: words, their 64-bit hashes, word
n-gram hashes and winnowed positions come from a fixed number of passes in
numpy, with no Python loop over documents or words.

A word is a maximal run of ASCII letters and digits and of non-ASCII
characters, except that general punctuation and symbols (U+0080-U+00BF,
U+2000-U+2FFF, U+3000-U+303F) separate words and each Han or kana character is its own word.
Hashes are taken over the lower-cased text and are equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MAX = U64(0xFFFFFFFFFFFFFFFF)
SLICE_BYTES = 1 << 20
_BASE, _GRAM = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = True
_WORD[0x80:] = True
_RARE = np.zeros(256, dtype=bool)
_RARE[[0xC2, *range(0xE2, 0xEA), 0xF0]] = True


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have


@dataclass
class Words:
    """Words of consecutive documents: byte spans, hashes, and for document d
    the words ``first[d]`` to ``first[d + 1]``. Byte spans are relative to
    ``data``; ``offsets`` has the documents' bytes."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))

    def inner(self) -> np.ndarray:
        """The position of each word in its document."""
        return np.arange(len(self.hash)) - np.repeat(self.first[:-1], np.diff(self.first))

    def left(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hash))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * kind().itemsize).astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    if not len(column):
        return
    _, o = buffers(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(o, o[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def words(column: pa.Array, *, lower: bool = True) -> Words:
    """Split and hash the words of a string column."""
    if column.null_count:
        column = pc.fill_null(column, "")
    data, offsets = buffers(pc.utf8_lower(column) if lower else column)
    n = len(data)
    word = np.zeros(n + 1, dtype=bool)
    word[:n] = _WORD[data]
    lead = None
    if n and _RARE[data].any():
        lead = (data & 0xC0) != 0x80
        punctuation = data == 0xE3
        punctuation[:-1] &= data[1:] == 0x80
        for at, width in ((data == 0xC2, 2), (data == 0xE2, 3), (punctuation, 3)):
            for k in range(width):
                word[k:n] &= ~at[: n - k]
    begin = word[:n].copy()
    if n:
        begin[1:] &= ~word[: n - 1]
        if lead is not None:
            single = (data >= 0xE3) & (data <= 0xE9) & ~punctuation
            begin |= single & word[:n]
            after = np.zeros(n, dtype=bool)
            after[3:] = single[: n - 3] if n > 3 else single[:0]
            begin |= after & word[:n] & lead
        at = offsets[:-1][offsets[:-1] < n]
        begin[at] = word[at]
    start = np.flatnonzero(begin)
    stop = np.zeros(n + 1, dtype=bool)
    if n:
        stop[1:] = word[:n] & ~word[1:]
        stop[1:n] |= word[: n - 1] & begin[1:]
    end = np.flatnonzero(stop)
    if len(start):
        up, down = _powers(_BASE, n + 1)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
    else:
        h = np.zeros(0, dtype=U64)
    return Words(data, offsets, start, end, h, np.searchsorted(start, offsets))


def grams(w: Words, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the k words from each word on (from the words ``at``);
    ``MAX`` where the document has fewer."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, dtype=U64)
    up, down = _powers(_GRAM, n + k + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(w.hash * up[:n], out=total[1:])
    i = np.arange(n) if at is None else at
    h = mix((total[np.minimum(i + k, n)] - total[i]) * down[i])
    h[h == MAX] = U64(0)
    left = w.left() if at is None else w.left()[at]
    h[left < k] = MAX
    return h


def slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` over x[i : i + width]; the tail is of shorter windows."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = take(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(w: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (among all words) and hashes of the winnowed k-grams.

    In each run of ``window`` k-grams of a document the ones with the least
    hash are kept (all of them in a tie), so two documents that share
    ``window + k - 1`` words keep a common k-gram at the same place in it.
    """
    h = grams(w, k)
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least = slide(h, window, np.minimum)
    whole = w.left() >= window + k - 1
    least[~whole] = U64(0)
    # the largest of the minima of the windows that hold the position; those
    # that reach over the end of a document are 0 and never count
    most = slide(least[::-1], window, np.maximum)[::-1]
    keep = np.flatnonzero((h == most) & (h != MAX))
    return keep, h[keep]


def char_starts(text_bytes: np.ndarray) -> np.ndarray:
    """Number of characters before each byte of UTF-8."""
    out = np.zeros(len(text_bytes) + 1, dtype=np.int64)
    np.cumsum((text_bytes & 0xC0) != 0x80, out=out[1:])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's bigint."""
    return h.view(np.int64)
