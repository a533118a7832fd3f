"""Main text of web pages by shallow text features.

A page becomes a flat sequence of text blocks, cut at every block-level tag.
Each block has its word count and link density (share of words inside links);
with those of the block before and after it they are what a small decision
tree sees. The tree is trained here, on ``LABELLED``, and applied to whole
batches of blocks at once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.markup import Tags
from loomtext.llm.common import mapped, text_column

_A_TITLE = r"<title\b[^>]*>(?:(?:(?!</head\b|<body\b|<title\b).)*?</title\s*>|[^<]*)"
# groups inside a possessive loop fail in Python's re: no group, each name written out
_CLOSED = "|".join(rf"<{x}\b[^>]*>.*?</{x}\s*>" for x in ("script", "style", "noscript", "template", "noframes"))
# A head ends at its </head> or, as its end tag may be left out, before the first
# text or tag that can't be in one.
_HEAD = (
    rf"<head\b[^>]*>(?:\s+|<!--.*?-->|<(?:!(?!--)|\?)[^>]*>|{_CLOSED}|{_A_TITLE}"
    r"|<(?:base|basefont|bgsound|link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</(?!(?:head|body|html|br)\b)[a-z][^>]*>"
    r"|<(?:!--|(?:script|style|noscript|template|noframes)\b).*?(?=</head\s*>))*+(?:</head\s*>)?"
)
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|{_HEAD}|{_A_TITLE}|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)|[^<]+|<", re.S | re.I)
_OPEN = re.compile(r"[^<]+|<")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def blocks(page: str) -> list[Block]:
    """The text blocks of a page; ``head``, titles, scripts, styles and comments have none."""
    out: list[Block] = []
    text: list[str] = []
    words = linked = depth = 0

    def flush() -> None:
        nonlocal words, linked
        if words:
            out.append(Block(" ".join("".join(text).split()), words, linked))
        text.clear()
        words = linked = 0

    at, tags = 0, Tags(page)
    while at < len(page):
        # behind the last > there is text and perhaps a comment left open
        m = (_TOKEN if at <= tags.last or page.startswith("<!--", at) else _OPEN).match(page, at)
        name = m[3] if m.re is _TOKEN else None
        at = m.end() if name is None else tags.end(m.end())
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                piece = html.unescape(piece)
                text.append(piece)
                n = len(piece.split())
                words += n
                linked += n if depth else 0
            continue
        name = name.lower()
        if name == "a":
            depth = max(0, depth - 1) if m[2] else 1
        elif name not in _INLINE:
            flush()
            # a block that ends closes a link left open
            if m[2]:
                depth = 0
    flush()
    return out


def observed(bs: list[Block]) -> np.ndarray:
    """[blocks, 6]: words and link density of the block before, of it and of the next."""
    v = np.zeros((len(bs) + 2, 2))
    v[1:-1] = [(b.words, b.density) for b in bs] if bs else np.zeros((0, 2))
    return np.concatenate([v[:-2], v[1:-1], v[2:]], axis=1)


#: before: words, density; the block; after; and 1 for main text. Seen on pages
#: with navigation lists, headings, paragraphs, notes, comments and footers.
LABELLED = [
    (0, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 1, 1, 8, 0, 0), (1, 1, 8, 0, 12, 0, 0), (8, 0, 12, 0, 60, 0, 1),
    (12, 0, 60, 0, 45, 0, 1), (60, 0, 45, 0, 5, 0, 1), (45, 0, 5, 0, 70, 0, 1), (5, 0, 70, 0, 9, 0, 1), (70, 0, 9, 0, 0, 0, 0),
    (0, 0, 2, 1, 3, 1, 0), (2, 1, 3, 1, 2, 1, 0), (3, 1, 2, 1, 6, 0, 0), (2, 1, 6, 0, 9, 0, 0), (6, 0, 9, 0, 38, 0, 1),
    (9, 0, 38, 0, 22, 0, 1), (38, 0, 22, 0, 64, 0.05, 1), (22, 0, 64, 0.05, 31, 0, 1), (64, 0.05, 31, 0, 12, 0, 1), (31, 0, 12, 0, 0, 0, 0),
    (1, 1, 1, 1, 5, 0, 0), (1, 1, 5, 0, 14, 0, 0), (5, 0, 14, 0, 14, 0, 1), (14, 0, 14, 0, 33, 0, 1), (14, 0, 33, 0, 40, 0, 1),
    (33, 0, 40, 0, 3, 0, 1), (40, 0, 3, 0, 52, 0, 1), (3, 0, 52, 0, 2, 0, 1), (52, 0, 2, 0, 28, 0, 1), (2, 0, 28, 0, 11, 0, 1),
    (28, 0, 11, 0, 0, 0, 0), (0, 0, 4, 0.5, 3, 1, 0), (4, 0.5, 3, 1, 3, 1, 0), (3, 1, 3, 1, 20, 0.9, 0), (3, 1, 20, 0.9, 10, 0, 0),
    (20, 0.9, 10, 0, 85, 0.02, 1), (10, 0, 85, 0.02, 120, 0, 1), (85, 0.02, 120, 0, 15, 0.8, 1), (120, 0, 15, 0.8, 7, 1, 0), (15, 0.8, 7, 1, 6, 1, 0),
    (7, 1, 6, 1, 10, 0.3, 0), (6, 1, 10, 0.3, 0, 0, 0), (1, 1, 9, 0, 9, 0, 0), (9, 0, 9, 0, 9, 0, 1), (9, 0, 9, 0, 47, 0, 1),
    (9, 0, 47, 0, 10, 0, 1), (47, 0, 10, 0, 0, 0, 0), (1, 1, 7, 0, 13, 0, 0), (7, 0, 13, 0, 250, 0, 1), (13, 0, 250, 0, 8, 0, 1),
    (250, 0, 8, 0, 0, 0, 0), (1, 1, 10, 0, 4, 0, 0), (10, 0, 4, 0, 4, 0, 1), (4, 0, 4, 0, 26, 0, 1), (4, 0, 26, 0, 18, 0, 1),
    (26, 0, 18, 0, 5, 0, 1), (18, 0, 5, 0, 0, 0, 0), (2, 1, 30, 0.6, 12, 0.7, 0), (30, 0.6, 12, 0.7, 14, 1, 0), (0, 0, 10, 0, 80, 0, 1),
    (80, 0, 6, 0.5, 4, 1, 0), (6, 0.5, 4, 1, 0, 0, 0), (0, 0, 35, 0, 0, 0, 1), (0, 0, 3, 0, 0, 0, 0), (55, 0, 24, 0, 0, 0, 1),
    (55, 0, 40, 0.1, 0, 0, 1), (40, 0, 16, 0.25, 50, 0, 1), (50, 0, 25, 0.2, 30, 0, 1), (1, 1, 8, 0, 6, 0, 0), (8, 0, 6, 0, 6, 0, 1),
    (6, 0, 6, 0, 19, 0, 1), (6, 0, 19, 0, 7, 0, 1), (19, 0, 7, 0, 16, 0, 1), (7, 0, 16, 0, 9, 0, 1), (16, 0, 9, 0, 0, 0, 0),
]


@dataclass
class Tree:
    """Nodes in arrays; a leaf's feature is -1."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := self.feature[at] >= 0).any():
            f = self.feature[at[inner]]
            go = x[np.flatnonzero(inner), f] < self.cut[at[inner]]
            at[inner] = np.where(go, self.low[at[inner]], self.high[at[inner]])
        return self.share[at]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2) -> Tree:
    """A tree by Gini impurity; ties go to the first feature and lowest cut."""
    nodes: list[list[float]] = []

    def node(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        p = y[rows].mean()
        nodes.append([-1, 0.0, 0, 0, p])
        if level == depth or p in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        base = p * (1 - p)
        for f in range(x.shape[1]):
            v = np.unique(x[rows, f])
            for c in (v[1:] + v[:-1]) / 2:
                low = x[rows, f] < c
                a, b = y[rows[low]], y[rows[~low]]
                if min(len(a), len(b)) >= least:
                    gain = base - (len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())) / len(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, float(c))
        if best[1] >= 0:
            low = x[rows, best[1]] < best[2]
            nodes[me][:2] = [best[1], best[2]]
            nodes[me][2] = node(rows[low], level + 1)
            nodes[me][3] = node(rows[~low], level + 1)
        return me

    node(np.arange(len(x)), 0)
    t = np.array(nodes)
    return Tree(t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4])


def trained(labelled: list[tuple] | None = None) -> Tree:
    t = np.array(labelled or LABELLED, dtype=float)
    return grow(t[:, :6], t[:, 6])


def main_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, title, text, n_blocks, n_main: one row for each row of ``pages``.

    ``text`` has the main blocks, one a line, entities decoded. A null page has
    null text and title and no blocks; an empty one, or one without main text,
    an empty text. Markup may be broken: an open comment or script reaches to
    the end, a stray < is text; the time is linear in the page whatever is left
    open. Rows that repeat are each read; other columns
    are ignored.
    """
    tree = tree or trained()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [p.as_py() for p in text_column(b, "html")]
            parts = [blocks(p or "") for p in pages]
            x = np.concatenate([observed(p) for p in parts]) if parts else np.zeros((0, 6))
            main = tree.probability(x) >= 0.5
            text, title, n_main, at = [], [], [], 0
            for page, part in zip(pages, parts):
                mine = [k.text for k, ok in zip(part, main[at : at + len(part)]) if ok]
                at += len(part)
                text.append(None if page is None else "\n".join(mine))
                n_main.append(len(mine))
                t = _TITLE.search(page or "")
                title.append(" ".join(html.unescape(t[1]).split()) if t else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array([len(p) for p in parts], pa.int64()), pa.array(n_main, pa.int64())], names=["page_id", "title", "text", "n_blocks", "n_main"])

    return mapped(pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")), f, "page_id long, title string, text string, n_blocks long, n_main long")
