"""Personal data, also in disguise, with the offsets of the source text.

A text passes three transducers, each of which keeps for every character it
writes the source characters that it stands for:

1. homoglyphs: Cyrillic, Greek, full-width and other look-alikes become ASCII,
   digits of any script become 0-9, invisible characters vanish;
2. spelled digits: three or more of zero/oh/one .. nine (also in French,
   German and Spanish) in a row become digits;
3. disguises: [at], (dot), " at .. dot " and their like become @ and full stop.

Identifiers are found in what comes out and their spans mapped back. A text
goes through only if one regular expression, which every identifier's source
must match, finds something in it; that test runs over whole columns.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import mapped, text_column

# ruff: noqa: RUF001
_LOOK = dict(zip("аеорсухіјѕԁһӏкмтвнАВЕКМНОРСТХІЈЅУαονρικυτχΑΒΕΖΗΙΚΜΝΟΡΤΥΧɡıℓ", "aeopcyxijsdhlkmtbhABEKMHOPCTXIJSYaovpikutxABEZHIKMNOPTYXgil"))
_LOOK |= {"﹫": "@", "․": ".", "。": ".", "｡": ".", "•": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ", "∶": ":", "ꓸ": "."}
_LOOK |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_GONE = {"​", "‌", "‍", "⁠", "﻿", "­", "᠎", "‎", "‏"}
FOLD: dict[str, str] = _LOOK | dict.fromkeys(_GONE, "")
FOLD |= {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x1FFFF) if unicodedata.category(chr(c)) == "Nd"}
_KEYS = frozenset(FOLD)

_NAMES = {
    "0": "zero oh null zéro cero", "1": "one un une ein eins uno una", "2": "two deux zwei dos", "3": "three trois drei tres", "4": "four quatre vier cuatro",
    "5": "five cinq fünf cinco", "6": "six sechs seis", "7": "seven sept sieben siete", "8": "eight huit acht ocho", "9": "nine neuf neun nueve",
}
DIGIT = {w: d for d, names in _NAMES.items() for w in names.split()}
_NAME = "(?:" + "|".join(sorted(DIGIT, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)(?<!\w){_NAME}(?:(?:[\s,.\-]{{1,2}}|(?:\s*\d)+\s*){_NAME}(?!\w)){{2,}}")
_ONE_NAME = re.compile(rf"(?i){_NAME}(?!\w)")
_BETWEEN = re.compile(r"(?<=\d)[\s,.]{1,2}(?=\d)")

_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_AT = re.compile(rf"(?i){_OPEN}(?:at|arroba|chez|@){_CLOSE}")
_DOT = re.compile(rf"(?i){_OPEN}(?:dot|punto|point|punkt|\.){_CLOSE}")
_BARE_DOT = re.compile(r"(?i)(?<=[\w])\s+dot\s+(?=[a-z0-9])")
_BARE_AT = re.compile(r"(?i)(?<=[\w])\s+at\s+(?=[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.(?:com|org|net|edu|gov|mil|info|biz|io|co|ai|dev|app|me|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|au|in|jp|cn|br|ru)\b)")

FINDERS = {
    "secret": re.compile(r"(?i)(?<![a-z])(?:api[_ -]?key|access[_ -]?key|secret[_ -]?key|private[_ -]?key|auth[_ -]?token|token|secret|password|passwd|pwd)\s{0,4}[=:]\s{0,4}[\"'“]?([A-Za-z0-9_+/.\-]{8,})"),
    "email": re.compile(r"[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    "ssn": re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "card": re.compile(r"(?<!\d)(?<!\d[ \-])\d(?:[ \-]?\d){12,}+"),
    "phone": re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{2,4}(?:[ .\-]\d{2,4})*(?!\d)|(?<![\w.])\+?\d{10,12}(?!\d)"),
}
# What a text must hold for a finder that is slow to find nothing.
_NEEDS = {"email": re.compile("@"), "ip": re.compile(r"[0-9]\.[0-9]{1,3}\."), "ssn": re.compile(r"[0-9]-[0-9]{2}-[0-9]")}
# The parts of a run that is too long for one number.
_CARD = re.compile(r"\d{13,19}|\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,4}|\d{4}(?:[ \-]\d{4}){3}[ \-]\d{1,3}|\d{4}[ \-]\d{6}[ \-]\d{4,5}")
_CARD_WORD = re.compile(r"(?i)\b(?:cards?|visa|mastercard|amex|credit|debit|carte|tarjeta|kreditkarte|karte)\b")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{2,4}(?:[ .\-]\d{2,4}){0,4}|\+?\d{10,12}")
_USUAL = re.compile(r"(?:\+\d{1,3}[ .\-]?)?(?:(?:\(\d{3}\) ?|\d{3}([ .\-]))?\d{3}[ .\-]\d{4}|\d{2}(?:([ .\-])\d{2})(?:\2\d{2}){3})|\+?\d{10,12}")
_GROUP = re.compile(r"\+?\(?\d+\)?")
_DATE = re.compile(r"\d{4}[ .\-]\d{2}[ .\-]\d{2}|\d{2}[ .\-]\d{2}[ .\-]\d{4}")

# What a text must hold for any of the above, in RE2's syntax, whose \s and \w
# are ASCII only. A character that may be part of any identifier and is rare
# is enough by itself; so are two spelled digits in a row, without which no
# third comes.
_S, _W, _DASH, _STOP = r"[\t-\r\x1c-\x20\x{85}\p{Z}]", r"\p{L}\p{N}_", r"\-‐-―−", "[.․。｡•∙．ꓸ]"
_RUN = rf"(?:{_S}|[().,/+•{_DASH}]){{0,3}}"
_FAINT = r"[\x{00AD}\x{180E}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
TRIGGER = "(?i)" + "|".join(
    [
        "[@＠﹫]",
        rf"[\[({{<（＜［｛]{_S}*(?:at|arroba|chez|dot|punto|point|punkt|{_STOP}){_S}*[\])}}>）＞］｝]",
        rf"\p{{Nd}}{_S}+dot{_S}+[\p{{Nd}}a-z]",
        rf"[{_W}]{_S}+at{_S}+[{_W}{_DASH}]+(?:{_STOP}|{_S}*[\[({{<]|{_S}+dot{_S})",
        rf"\p{{Nd}}(?:{_RUN}\p{{Nd}}){{6}}",
        rf"(?:^|[^{_W}]){_NAME}(?:(?:{_S}|[,.•{_DASH}]){{1,2}}|(?:{_S}*\p{{Nd}})+{_S}*){_NAME}(?:[^{_W}]|$)",
        r"\p{Nd}[.•]\p{Nd}{1,3}[.•]\p{Nd}{1,3}[.•]\p{Nd}",
        rf"[a-z]{{2}}\p{{Nd}}{{2}}(?:{_S}?[a-z\p{{Nd}}]{{4}}){{3}}",
        rf"(?:key|token|secret|password|passwd|pwd){_S}{{0,4}}[=:]",
        _FAINT,
        # İ is an i to Python's (?i)
        "[İ" + "".join(sorted(c for c in _LOOK if unicodedata.category(c)[0] in "LNPS" and c not in "‐‑‒–—•−")) + "]",
    ]
)


@dataclass
class Traced:
    """A text and, for each character, the source characters it stands for,
    in eight bytes: long texts fit."""

    text: str
    start: array
    end: array

    def replaced(self, hits: list[tuple[int, int, str]]) -> Traced:
        """With each (from, to, what) in place of its characters. What is put
        in stands, character by character, for the whole of what was there."""
        if not hits:
            return self
        text, start, end, at = [], array("i"), array("i"), 0
        for a, b, what in hits:
            text += [self.text[at:a], what]
            start += self.start[at:a]
            end += self.end[at:a]
            for _ in what:
                start.append(self.start[a])
                end.append(self.end[b - 1])
            at = b
        return Traced("".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:])


def folded(t: Traced) -> Traced:
    # most texts have none of the characters: what they have is soon known
    some = () if t.text.isascii() else _KEYS.intersection(t.text)
    if not some:
        return t
    return t.replaced([(m.start(), m.end(), FOLD[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, sorted(some))) + "]", t.text)])


def digits(t: Traced) -> Traced:
    hits = []
    for m in _SPELLED.finditer(t.text):
        at = m.start()
        for n in _ONE_NAME.finditer(t.text, m.start(), m.end()):
            if n.start() > at and not t.text[at : n.start()].strip(" \t\n,.-"):
                hits.append((at, n.start(), ""))
            hits.append((n.start(), n.end(), DIGIT[n[0].replace("İ", "i").lower().replace("ſ", "s")]))
            at = n.end()
    return t.replaced(hits)


def undisguised(t: Traced) -> Traced:
    for pattern, what in ((_DOT, "."), (_AT, "@"), (_BARE_DOT, "."), (_BARE_AT, "@")):
        if pattern is _BARE_DOT and not re.search(r"(?i)@|\sat\s", t.text):
            continue
        t = t.replaced([(m.start(), m.end(), what) for m in pattern.finditer(t.text)])
    return t


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _card_worth(s: str, named: bool = False) -> int:
    """0 for what is no card: a right check digit makes one, but not of a book
    number, or a word for a card before it."""
    if not _CARD.fullmatch(s) or not s.strip("0 -"):
        return 0
    n = sum(map(str.isdigit, s))
    if _luhn(s) and (named or n != 13 or s[:3] not in ("978", "979")):
        return n * 3
    return n * 2 if named else 0


def _phone_worth(s: str) -> int:
    n = sum(map(str.isdigit, s))
    if not 7 <= n <= 15 or not _PHONE.fullmatch(s) or _DATE.fullmatch(s) or not s.strip("0 .-"):
        return 0
    return n * (3 if _USUAL.fullmatch(s) and len(set(re.findall(r"(?<=\d)[ .\-](?=\d)", s))) < 2 else 2)


def _parts(s: str, worth: Callable[[str], int]) -> list[tuple[int, int]]:
    """The spans of the numbers that a run of digit groups is made of: those
    that together are worth most, and so leave the fewest digits out."""
    groups = [m.span() for m in _GROUP.finditer(s)]
    best: list[tuple[int, int, int]] = [(0, -1, 0)]  # worth up to a group, where its last number starts, its groups
    for k in range(1, len(groups) + 1):
        now = (best[k - 1][0], -1, 0)
        for i in range(max(0, k - 8), k):
            w = worth(s[groups[i][0] : groups[k - 1][1]])
            if w and best[i][0] + w > now[0]:
                now = (best[i][0] + w, i, k - i)
        best.append(now)
    out, k = [], len(groups)
    while k > 0:
        _, i, n = best[k]
        if n:
            out.append((groups[i][0], groups[k - 1][1]))
        k = i if n else k - 1
    return out[::-1]


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Where others follow, an IBAN is the longest start of a match that proves
    right, and the search goes on behind it."""
    at = 0
    while m := FINDERS["iban"].search(text, at):
        a, b = m.span()
        ends = [b, *(x for x in range(b - 1, a, -1) if text[x] == " ")]
        end = next((x for x in ends if len(text[a:x].replace(" ", "")) >= 15 and _iban(text[a:x])), 0)
        if end:
            yield a, end
        at = end or a + 1


def _within(kind: str, a: int, b: int, text: str) -> list[tuple[int, int]]:
    """The spans of the identifiers in a match from a to b."""
    s = text[a:b]
    n = sum(map(str.isdigit, s))
    if kind == "card":
        named = bool(_CARD_WORD.search(text, max(0, a - 40), a))
        if n <= 19 and (_luhn(s) or named) and s.strip("0 -"):
            return [(a, b)] if named or n != 13 or s[:3] not in ("978", "979") else []
        return [(a + x, a + y) for x, y in _parts(s, lambda part: _card_worth(part, named))]
    if kind == "phone" and _CARD.fullmatch(s):
        return []
    if kind == "phone" and (n > 15 or not _PHONE.fullmatch(s)):
        return [(a + x, a + y) for x, y in _parts(s, _phone_worth)]
    if kind == "phone" and (n < 7 or _DATE.fullmatch(s)):
        return []
    return [(a, b)]


_PLACES = array("i", range(1 << 16))


def traced(text: str) -> Traced:
    """A text whose characters stand for themselves."""
    n = len(text)
    while len(_PLACES) <= n:
        _PLACES.extend(range(len(_PLACES), 2 * len(_PLACES)))
    return Traced(text, _PLACES[:n], _PLACES[1 : n + 1])


def normalised(text: str) -> Traced:
    return undisguised(digits(folded(traced(text))))


def identifiers(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) by place; where two overlap the
    kind that FINDERS names first stays."""
    t = normalised(text)
    found: list[tuple[str, int, int, str]] = []
    taken = bytearray(len(t.text))
    rest = t.text
    for kind, pattern in FINDERS.items():
        if kind in _NEEDS and not _NEEDS[kind].search(rest):
            continue
        if kind == "iban":
            spans = _ibans(rest)
        elif kind == "secret":
            spans = (m.span(1) for m in pattern.finditer(rest))
        else:
            spans = (x for m in pattern.finditer(rest) for x in _within(kind, *m.span(), rest))
        for a, b in spans:
            if any(taken[a:b]):
                continue
            if kind == "email":
                a += len(t.text[a:b]) - len(t.text[a:b].lstrip(".%+-"))
            taken[a:b] = b"\1" * (b - a)
            found.append((kind, t.start[a], t.end[b - 1], t.text[a:b]))
        if found and kind in ("ssn", "iban", "card"):
            # what is taken parts what stands beside it
            rest = "".join("_" if x else c for c, x in zip(t.text, taken))
    return sorted(found, key=lambda x: (x[1], x[2]))


def suspects(texts: pa.Array) -> pa.Array:
    """Rows that hold something an identifier could be made of."""
    return pc.fill_null(pc.match_substring_regex(texts, TRIGGER), False)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start_char, end_char, value: each identifier of each row.

    Offsets are in characters of the source text, whatever the disguise;
    ``value`` is the normalised form. A run of 13 to 19 digits is a card if its
    check digit is right, unless it is a book number, or if one of the 40
    characters' words before it names a card. Null and empty texts have none, rows
    that repeat have theirs each time, null ids are passed on, other columns
    are ignored, an empty table gives no rows.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(suspects(text_column(b)))
            rows = [(i, *x) for i, text in enumerate(text_column(b)) for x in identifiers(text.as_py())]
            c = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.string())], names=["doc_id", "kind", "start_char", "end_char", "value"])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return mapped(d, f, "doc_id long, kind string, start_char long, end_char long, value string")


def redact(text: str) -> str:
    out, at = [], 0
    for kind, a, b, _ in identifiers(text):
        out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each identifier replaced by its kind, as in <EMAIL>.

    Where there is a column n_chars it is brought up to date for changed texts.
    Nulls stay null; all rows and columns are kept.
    """
    counted = dict(docs.dtypes).get("n_chars") == "bigint"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = b.schema.get_field_index("text"), text_column(b)
            mask = suspects(texts)
            new = pa.array([redact(x.as_py()) for x in texts.filter(mask)], texts.type)
            b = b.set_column(at, b.schema.field(at), pc.replace_with_mask(texts, mask, new))
            if counted:
                n = b.schema.get_field_index("n_chars")
                changed = pc.fill_null(pc.not_equal(texts, b.column(at)), False)
                b = b.set_column(n, b.schema.field(n), pc.if_else(changed, pc.utf8_length(b.column(at)).cast(pa.int64()), b.column(n)))
            yield b

    return mapped(docs, f, docs.schema)
