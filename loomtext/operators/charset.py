"""Character sets of byte columns: detection, vote and decoding.

A candidate is dropped at the first byte sequence that its encoding does not
allow. Of several survivors the one whose decoded text looks most like text of
its region wins. Candidates are narrowed by language.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.frames import mapped

CODECS = {
    "UTF-8": "utf-8", "GB2312": "gb2312", "GB18030": "gb18030", "Big5": "big5", "EUC-TW": "euc_tw", "EUC-JP": "euc_jp", "Shift_JIS": "shift_jis", "EUC-KR": "euc_kr",
    "HZ-GB-2312": "hz", "ISO-2022-CN": "iso2022_cn", "ISO-2022-JP": "iso2022_jp", "ISO-2022-KR": "iso2022_kr", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "windows-1252": "cp1252",
}
_WORLD = ["UTF-8", "UTF-16LE", "UTF-16BE"]
CANDIDATES = {
    "Chinese": [*_WORLD, "GB2312", "GB18030", "Big5", "HZ-GB-2312", "ISO-2022-CN", "EUC-TW"],
    "SimplifiedChinese": [*_WORLD, "GB2312", "GB18030", "HZ-GB-2312", "ISO-2022-CN"],
    "TraditionalChinese": [*_WORLD, "Big5", "EUC-TW", "ISO-2022-CN"],
    "Japanese": [*_WORLD, "EUC-JP", "Shift_JIS", "ISO-2022-JP"],
    "Korean": [*_WORLD, "EUC-KR", "ISO-2022-KR"],
    "ALL": [*_WORLD, "GB2312", "GB18030", "Big5", "EUC-JP", "Shift_JIS", "EUC-KR", "HZ-GB-2312", "ISO-2022-JP", "ISO-2022-KR", "EUC-TW", "windows-1252"],
}
_ESCAPES = {"ISO-2022-JP": rb"\x1b(?:\$[@B]|\([JB])", "ISO-2022-KR": rb"\x1b\$\)C", "ISO-2022-CN": rb"\x1b\$\)[AG]", "HZ-GB-2312": rb"~\{"}
_COMMON = {"zh": set("的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处"), "ja": set("のにはをたがでてとしれさいうるなすもかこまくあり"), "ko": set("의이다는을에가한를고지로기사하")}


def _valid(data: bytes, name: str) -> str | None:
    """The text, if every byte fits; a sequence cut off at the end does."""
    if name in _ESCAPES and not re.search(_ESCAPES[name], data):
        return None
    try:
        codec = CODECS[name]
        if name in ("EUC-TW", "ISO-2022-CN"):
            return None if not _has(codec) else codecs.getincrementaldecoder(codec)().decode(data)
        return codecs.getincrementaldecoder(codec)().decode(data)
    except (UnicodeDecodeError, LookupError):
        return None


def _has(codec: str) -> bool:
    try:
        codecs.lookup(codec)
        return True
    except LookupError:
        return False


def _plausible(text: str, name: str) -> float:
    """Share of characters that texts of the encoding's region have often."""
    high = [c for c in text if ord(c) > 0x7F]
    if not high:
        return 0.0
    kind = "ja" if name in ("EUC-JP", "Shift_JIS", "ISO-2022-JP") else "ko" if name in ("EUC-KR", "ISO-2022-KR") else "zh"
    letters = sum(c.isalnum() for c in high) / len(high)
    if name == "windows-1252":
        return 0.2 * letters * (len(high) < 0.3 * len(text))
    return sum(c in _COMMON[kind] for c in high) / len(high) + 0.1 * letters


def probable(data: bytes, language: str = "ALL") -> list[str]:
    """The surviving character sets, best first."""
    if data[:3] == b"\xef\xbb\xbf":
        return ["UTF-8"]
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return ["UTF-16LE" if data[:1] == b"\xff" else "UTF-16BE"]
    if not data:
        return []
    for name in _ESCAPES:
        if name in CANDIDATES[language] and _valid(data, name) is not None:
            return [name]
    if max(data) < 0x80:
        return ["ASCII"]
    out = []
    for k, name in enumerate(CANDIDATES[language]):
        if name.startswith("UTF-16") or name in _ESCAPES or (text := _valid(data, name)) is None:
            continue
        # valid UTF-8 with bytes above 127 is hardly ever anything else
        out.append((-10.0 if name == "UTF-8" else -_plausible(text, name), k, name))
    return [name for _, _, name in sorted(out)]


def detect(data: bytes | None, language: str = "ALL") -> str | None:
    return next(iter(probable(data, language)), None) if data is not None else None


def detected(df: DataFrame, body: str = "body", language: str = "ALL", to: str = "charset") -> DataFrame:
    """``df`` with the character set of a binary column; null where none fits."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{to}` string"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = pa.array([detect(x, language) for x in b.column(b.schema.get_field_index(body)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, names], names=[*b.schema.names, to])

    return mapped(df, f, ddl)


def vote(meta: Column, header: Column, detector: Column, given: Column | None = None, default: str = "utf-8") -> Column:
    """Declared and header agree; else the detector with either of them; else
    the caller's; else detector, header, declaration; else the default."""
    low = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    m, h, d = low(meta), low(header), low(detector)
    return F.coalesce(F.when(m == h, m), F.when((d == m) | (d == h), d), low(given) if given is not None else F.lit(None), d, h, m, F.lit(default))


def declared(head: Column) -> Column:
    """The charset that markup declares."""
    return F.nullif(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([\w\-]+)", 1), F.lit(""))


def decoded(df: DataFrame, body: str = "body", charset: str = "charset", to: str = "html") -> DataFrame:
    """``df`` with the text of a binary column; bytes that don't fit become U+FFFD."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{to}` string"])

    def one(data: bytes | None, name: str | None) -> str | None:
        if data is None:
            return None
        codec = next((c for n, c in CODECS.items() if n.lower() == (name or "").lower()), name or "utf-8")
        return data.decode(codec if _has(codec) else "utf-8", "replace")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [one(x, n) for x, n in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (body, charset)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, to])

    return mapped(df, f, ddl)


def crawl_status(message: Column) -> Column:
    """Status of a crawl error message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike("timed? ?out|502"), 502).when(m.rlike("could not be resolved|name resolution|dns|404"), 404).otherwise(500)
