"""Token counts under a byte-level BPE, with a shortcut for whole tokens.

``prove`` merges every vocabulary string by the ranks, offline and once: those
that end as one token are whole. A pre-token among them counts as one without
any merging; only the rest is merged, and its counts are kept in a bounded
table. The vocabulary is of fixed size and its path is a parameter.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import mapped, text_column

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEPT = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece: the adjacent pair of least rank joins first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def prove(ranks: dict[bytes, int]) -> frozenset[str]:
    """The vocabulary strings that merge into one token when they stand alone."""
    whole = set()
    for piece in ranks:
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            continue
        if len(merge(piece, ranks)) == 1:
            whole.add(text)
    return frozenset(whole)


class Counter(dict):
    """Tokens of a pre-token: 1 for the whole ones, else by merging."""

    def __init__(self, ranks: dict[bytes, int], whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.ranks = whole, ranks
        import tiktoken

        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, text: str) -> int:
        piece = text.encode()
        # the core takes a vocabulary string as it is, proven or not
        n = len(merge(piece, self.ranks)) if piece in self.ranks else len(self.core.encode_single_piece(piece))
        if len(self) >= KEPT:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        if len(text) <= 64:
            self[text] = n
        return n


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_whole (the pre-tokens that took the
    shortcut): one row for each row of ``docs``, whole texts.

    Special tokens' strings count as ordinary text. An empty text has 0 of
    each, a null text null. Rows that repeat are each counted; other columns
    are ignored. The read vocabulary travels to the executors as one
    broadcast of its own fixed size.
    """
    ranks = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, prove(ranks)))
    key = uuid.uuid4().hex

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(*shared.value)
        counter = _COUNTERS[key]
        split, cost, is_whole = regex.compile(PATTERN).findall, counter.__getitem__, counter.whole.__contains__
        for b in batches:
            out: list[list] = [[], [], []]
            for text in text_column(b):
                if not text.is_valid:
                    row = (None, None, None)
                else:
                    pieces = split(text.as_py())
                    row = (sum(map(cost, pieces)), len(pieces), sum(map(is_whole, pieces)))
                for o, x in zip(out, row):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.int64()) for o in out)], names=["doc_id", "n_tokens", "n_pretokens", "n_whole"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(d, f, "doc_id long, n_tokens long, n_pretokens long, n_whole long")
