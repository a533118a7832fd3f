"""Edit distances, longest common substrings and subsequences of texts.

Of two text columns they are computed pair by pair, row by row of the table of
prefixes, a row being one numpy operation. For many texts against the same many,
as searches have them, ``Texts`` holds these as a tree of their beginnings, and
a ``Block`` of other texts goes down the tree level by level: what two texts
begin with is looked at once, and a step is done for all nodes of a level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.operators.frames import mapped


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


def common_substring(a: str | None, b: str | None) -> int:
    """Length of the longest run of characters that both have."""
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    x, y = _codes(a), _codes(b)
    row, best = np.zeros(len(y) + 1, dtype=np.int64), 0
    for c in x:
        row[1:] = np.where(y == c, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def common_subsequence(a: str | None, b: str | None) -> int:
    """Length of the longest sequence that both have, gaps allowed; by the
    bit-parallel recurrence, with Python's long integers as bit rows."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = at.get(c, 0)
        u = v & m
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def with_common_lengths(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with columns common_substring and common_subsequence of two text columns."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "common_substring int", "common_subsequence int"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            new = [pa.array([g(p, q) for p, q in zip(x, y)], pa.int32()) for g in (common_substring, common_subsequence)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "common_substring", "common_subsequence"])

    return mapped(df, f, ddl)


#: cells of the matrix of characters that a tree is made from
CELLS = 1 << 22
#: pairs that a block has, about
PAIRS = 1 << 16
_ONES = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
_TOP = np.uint64(63)


class Texts:
    """Distinct texts as a tree of their beginnings.

    ``levels`` has for each length of beginnings, from 1 on: the parents of its
    nodes in the level before (None where each node has just one child), their
    characters as places in ``alphabet``, the texts that end there and their nodes."""

    def __init__(self, texts: Sequence[str]):
        self.texts = sorted(set(texts))
        self.place = {t: i for i, t in enumerate(self.texts)}
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        whole = "".join(self.texts)
        self.alphabet = {c: i for i, c in enumerate(sorted(set(whole)))}
        known = np.array([ord(c) for c in self.alphabet], dtype=np.uint32)
        width = int(self.lengths.max(initial=0))
        inside = np.arange(width) < self.lengths[:, None]
        codes = np.full((len(self.texts), width), -1, dtype=np.int32)
        codes[inside] = np.searchsorted(known, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        shared = np.zeros(len(self.texts), dtype=np.int64)
        if width and len(self.texts) > 1:
            shared[1:] = np.argmin(codes[1:] == codes[:-1], axis=1)  # distinct texts differ somewhere
        new = inside & (np.arange(width) >= shared[:, None])
        at = np.cumsum(new, axis=0, dtype=np.intp) - 1
        by_length = np.argsort(self.lengths, kind="stable")
        first = np.searchsorted(self.lengths[by_length], np.arange(width + 2))
        self.levels, before = [], 1
        for k in range(width):
            rows = np.flatnonzero(new[:, k])
            parents = at[rows, k - 1] if k else np.zeros(len(rows), dtype=np.intp)
            ends = by_length[first[k + 1] : first[k + 2]]
            same = len(rows) == before and bool((parents == np.arange(before)).all())
            self.levels.append((None if same else parents, codes[rows, k].astype(np.intp), ends, at[ends, k]))
            before = len(rows)


class Block:
    """Texts against those of a tree: each measure is a matrix of (text, text of the tree)."""

    def __init__(self, texts: Sequence[str], tree: Texts):
        self.texts, self.tree = texts, tree
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.words = max(1, -(-int(self.lengths.max(initial=0)) // 64))

    def _walk(self, state: list[np.ndarray], step: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]], end: Callable[[list[np.ndarray], int], np.ndarray]) -> np.ndarray:
        """``end`` of the states that the tree's texts lead to; ``state`` is the root's."""
        out = np.empty((len(self.texts), len(self.tree.texts)), dtype=np.int32)
        empty = np.flatnonzero(self.tree.lengths == 0)
        out[:, empty] = end(state, 0)
        for k, (parents, codes, ends, at) in enumerate(self.tree.levels):
            if parents is not None:
                state = [np.take(s, parents, axis=1, mode="clip") for s in state]
            state = step(state, codes)
            if len(ends):
                out[:, ends] = end([np.take(s, at, axis=1) for s in state], k + 1)
        return out

    def _places(self) -> np.ndarray:
        """Bits of the places of each character of the alphabet: (word, text, character)."""
        bits = np.zeros((self.words, len(self.texts), max(1, len(self.tree.alphabet))), dtype=np.uint64)
        for q, t in enumerate(self.texts):
            for i, c in enumerate(t):
                if (k := self.tree.alphabet.get(c)) is not None:
                    bits[i >> 6, q, k] |= np.uint64(1 << (i & 63))
        return bits

    def _used(self) -> list[np.ndarray]:
        """The bits of each word that texts have a character for."""
        return [np.array([[(1 << min(64, max(0, n - 64 * w))) - 1] for n in self.lengths.tolist()], dtype=np.uint64) for w in range(self.words)]

    def edit_distance(self) -> np.ndarray:
        """Myers' bit-parallel recurrence: words of the signs of a column's steps."""
        places, used = self._places(), self._used()
        root = np.zeros((len(self.texts), 1), dtype=np.uint64)

        def step(state: list[np.ndarray], codes: np.ndarray) -> list[np.ndarray]:
            out: list[np.ndarray] = []
            more: np.ndarray | np.uint64 = np.uint64(1)  # the first row counts up
            less: np.ndarray | np.uint64 = np.uint64(0)
            for w in range(self.words):
                up, down = state[2 * w], state[2 * w + 1]
                eq = np.take(places[w], codes, axis=1, mode="clip")
                vertical = eq | down
                eq |= less
                x = eq & up
                x += up
                x ^= up
                x |= eq
                p = ~(x | up)
                p |= down
                x &= up
                last = w + 1 == self.words
                next_more, next_less = (more, less) if last else (p >> _TOP, x >> _TOP)
                p <<= np.uint64(1)
                p |= more
                x <<= np.uint64(1)
                x |= less
                y = vertical | p
                np.invert(y, out=y)
                y |= x
                p &= vertical
                out += [y, p]
                more, less = next_more, next_less
            return out

        def end(state: list[np.ndarray], n: int) -> np.ndarray:
            return n + sum(np.bitwise_count(state[2 * w] & used[w]).astype(np.int64) - np.bitwise_count(state[2 * w + 1] & used[w]) for w in range(self.words))

        return self._walk([root | _ONES, root] * self.words, step, end)

    def likeliness(self, digits: int) -> np.ndarray:
        """One less the share of edits in the longer text, rounded half up; NaN for two empty texts."""
        longest = np.maximum(self.lengths[:, None], self.tree.lengths)
        with np.errstate(invalid="ignore"):
            return np.floor((1 - self.edit_distance() / longest) * 10**digits + 0.5) / 10**digits

    def alike(self, threshold: float = 0.9) -> np.ndarray:
        """As ``functions.text.alike``: the tree's text is the start or the end of
        the other, or lengths and edits are within the threshold."""
        m, n = self.lengths[:, None], self.tree.lengths
        out = (m >= threshold * n) & (n >= threshold * m) & (self.edit_distance() <= np.floor((1 - threshold) * n + 1e-9))
        for q, t in enumerate(self.texts):
            out[q, [k for i in range(len(t) + 1) for x in (t[:i], t[i:]) if (k := self.tree.place.get(x)) is not None]] = True
        return out

    def common_subsequence(self) -> np.ndarray:
        """Length of the longest sequence that both have, gaps allowed."""
        places, used = self._places(), self._used()
        root = np.full((len(self.texts), 1), _ONES)

        def step(state: list[np.ndarray], codes: np.ndarray) -> list[np.ndarray]:
            out: list[np.ndarray] = []
            carry = None
            for w in range(self.words):
                v = state[w]
                u = v & np.take(places[w], codes, axis=1, mode="clip")
                total = v + u
                if w + 1 < self.words:
                    over = total < v
                if carry is not None:
                    total += carry
                    if w + 1 < self.words:
                        over |= total < carry
                if w + 1 < self.words:
                    carry = over.astype(np.uint64)
                total |= v - u
                out.append(total)
            return out

        def end(state: list[np.ndarray], n: int) -> np.ndarray:
            return self.lengths[:, None] - sum(np.bitwise_count(state[w] & used[w]).astype(np.int64) for w in range(self.words))

        return self._walk([root] * self.words, step, end)

    def common_substring(self) -> np.ndarray:
        """Length of the longest run of characters that both have, by the
        automaton of each text's substrings."""
        made = [_automaton(t, self.tree.alphabet) for t in self.texts]
        size, width = max(len(n) for n, _ in made), max(1, len(self.tree.alphabet))
        follow, most = np.zeros((len(made), size, width), dtype=np.int64), np.full((len(made), size, width), -1, dtype=np.int32)
        for q, (n, m) in enumerate(made):
            follow[q, : len(n)], most[q, : len(n)] = (q * size + n) * width, m
        follow, most = follow.ravel(), most.ravel()

        def step(state: list[np.ndarray], codes: np.ndarray) -> list[np.ndarray]:
            at, run, best = state
            at = at + codes
            run = np.minimum(run, most.take(at, mode="clip"))
            run += 1
            return [follow.take(at, mode="clip"), run, np.maximum(best, run)]

        root = np.arange(len(made), dtype=np.int64)[:, None] * (size * width)
        none = np.zeros((len(made), 1), dtype=np.int32)
        return self._walk([root, none, none], step, lambda state, n: state[2])


def _automaton(text: str, alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each state of the suffix automaton and each character: the state that
    follows, and how long a run that has come there may be to go on whole, -1 if none goes on."""
    steps: list[dict[str, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 != length[q]:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    follow, most = np.zeros((len(steps), max(1, len(alphabet))), dtype=np.int64), np.full((len(steps), max(1, len(alphabet))), -1, dtype=np.int32)
    for s in sorted(range(len(steps)), key=length.__getitem__):
        if s:
            follow[s], most[s] = follow[link[s]], most[link[s]]
        own = [(alphabet[c], t) for c, t in steps[s].items() if c in alphabet]
        if own:
            at, to = zip(*own)
            follow[s, list(at)], most[s, list(at)] = to, length[s]
    return follow, most


def blocks(queries: Sequence[str], texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Block]]:
    """Every query against every text, in blocks of similar lengths: the places
    of a block's queries, the places of its texts, which of its tree's texts
    each of these is, and the block. Neither a tree nor a block grows with the
    number of texts."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    q_order = sorted(range(len(queries)), key=lambda i: len(queries[i]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * len(texts[order[stop]]) <= CELLS:
            stop += 1
        some = order[start:stop]
        tree = Texts([texts[i] for i in some])
        which = np.array([tree.place[texts[i]] for i in some], dtype=np.int64)
        at = 0
        while at < len(q_order):
            n = 1
            while at + n < len(q_order) and (n + 1) * len(tree.texts) * max(1, -(-len(queries[q_order[at + n]]) // 64)) <= PAIRS:
                n += 1
            chosen = q_order[at : at + n]
            yield np.array(chosen), np.array(some), which, Block([queries[i] for i in chosen], tree)
            at += n
        start = stop
