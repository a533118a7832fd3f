"""Articles of pages: title, publish date and the best-scored block."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.markup import decoded
from loomtext.functions.text import SPACE
from loomtext.operators.dom import Node, parse
from loomtext.operators.frames import mapped

DATE = r"[0-9]{4}[0-9-/:. 年月日T]*[0-9日]"
#: digits and marks, units of time, of dates, words around them; each occurrence counts
DATE_UNITS = "".join(("0123456789", ":：/-.", "秒分钟小时半天周星期", "年月日期", "昨前间", "布发表于出稿更新上线"))
STOP_PHRASES = ("Copyright", "版权", "网站地图", "不得转载", "关于我们")
PARITY_TAGS = ("div",)
BLOCK_TAGS = ("div", "article", "section", "main", "td")


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def title(html: Column) -> Column:
    """The title without blanks; the first heading's text, if it is within it."""
    t = _bare(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    h = _bare(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    return F.when((h != "") & F.contains(t, h), h).otherwise(t)


_SLASH = re.compile(r"(?:\d{4}|\d{2})(?:-\d{1,2}-|/\d{1,2}/)\d{1,2}(?:\s?\d{2}:\d{2})?|\d{4}年\d{1,2}月\d{1,2}日(?:\s?\d{2}:\d{2})?")


def date_text(root: Node) -> str:
    """The first date of the page's text; without one, of the short texts the
    one with the most date characters and nearest to six characters long."""
    m = _SLASH.search(root.inner_text())
    if m:
        return m[0]
    best: tuple[float, str] | None = None
    for n in root.descendants():
        if n.tag != "#text":
            s = "".join(n.inner_text().split())
            if s and len(s) < 30:
                hits = sum(c in s for c in DATE_UNITS)
                score = 2 * hits - abs(6 - len(s))
                if hits and (best is None or score > best[0]):
                    best = (score, s)
    return best[1] if best else ""


def parse_date(c: Column, now: Column | None = None) -> Column:
    """Timestamp of a date text: year-month-day in dashes, slashes, full stops
    or Chinese units, two-digit years in this century, with or without a time;
    and, when ``now`` is given, what lies minutes, hours or days back. Else null."""
    t = F.regexp_replace(F.trim(c), r"[年月/.]", "-")
    t = F.regexp_replace(F.regexp_replace(t, "日", " "), "T", " ")
    pick = lambda i: F.regexp_extract(t, r"([0-9]{4}|[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})(?:\s*([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?", i)
    year = F.when(F.length(pick(1)) == 2, F.concat(F.lit("20"), pick(1))).otherwise(pick(1))
    clock = F.concat_ws(":", *(F.lpad(F.when(pick(i) == "", "0").otherwise(pick(i)), 2, "0") for i in (4, 5, 6)))
    absolute = F.when(pick(1) != "", F.try_to_timestamp(F.concat(year, F.lit("-"), F.lpad(pick(2), 2, "0"), F.lit("-"), F.lpad(pick(3), 2, "0"), F.lit(" "), clock), F.lit("yyyy-MM-dd HH:mm:ss")))
    if now is None:
        return absolute
    back = F.regexp_extract(c, "([0-9]+)\\s*(?:秒|分钟|小时|天|周)(?:钟)?前", 1).try_cast("int")
    unit = F.regexp_extract(c, "[0-9]+\\s*(秒|分钟|小时|天|周)(?:钟)?前", 1)
    seconds = F.when(unit == "秒", 1).when(unit == "分钟", 60).when(unit == "小时", 3600).when(unit == "天", 86400).when(unit == "周", 604800)
    relative = F.when(F.contains(c, F.lit("半小时前")), 1800).when(F.contains(c, F.lit("前天")), 172800).when(F.contains(c, F.lit("昨天")), 86400).otherwise(back * seconds)
    return F.coalesce(absolute, F.timestamp_micros(F.unix_micros(now) - relative.cast("long") * 1_000_000))


def block_scores(root: Node, tags: Sequence[str] = PARITY_TAGS, stop: Sequence[str] = STOP_PHRASES) -> list[tuple[float, str, str]]:
    """(score, html, text) of every block with text, in document order.

    From 15: less 3 for each non-blank block inside (if there are several) and 2
    for each link, plus a 40th of the length. Paragraphs directly inside, if
    they hold nine tenths of the text, stand for the block with a score of
    their own. Short texts, runs of blank lines and stop phrases cost."""
    return [(score, "".join(c.outer_html() for c in kids) if kids else d.inner_html(), text) for score, d, kids, text in _scored(root, tags, stop)]


class _Sums:
    """Running sums over a tree in document order: what a subtree holds is the
    difference of two of them."""

    def __init__(self, root: Node, tags: Sequence[str]):
        nodes = [root, *root.descendants()]
        self.text = "".join(n.text for n in nodes if n.tag == "#text")
        chars = np.cumsum([0, *(len(n.text) if n.tag == "#text" else 0 for n in nodes)])
        space = np.fromiter((not c.isspace() for c in self.text), dtype=np.int64, count=len(self.text))
        self.chars, self.seen = chars.tolist(), np.r_[0, np.cumsum(space)].tolist()
        self.blocks = [n for n in nodes if n.tag in tags]
        self.block_ids = [n.node_id for n in self.blocks]
        links = np.array([n.tag == "a" for n in nodes], dtype=np.int64)
        bare = np.array([self.bare(n) for n in nodes], dtype=np.int64)
        filled = np.array([n.tag in tags for n in nodes], dtype=np.int64) * (bare > 0)
        self.links, self.linked, self.filled = (np.r_[0, np.cumsum(x)].tolist() for x in (links, links * bare, filled))

    def inner_text(self, n: Node) -> str:
        return self.text[self.chars[n.node_id] : self.chars[n.end_id + 1]]

    def bare(self, n: Node) -> int:
        return self.seen[self.chars[n.end_id + 1]] - self.seen[self.chars[n.node_id]]

    def below(self, sums: list[int], n: Node) -> int:
        return sums[n.end_id + 1] - sums[n.node_id + 1]

    def inner_blocks(self, n: Node) -> tuple[int, Node | None]:
        """How many blocks are inside, and the first of them."""
        lo, hi = bisect.bisect_right(self.block_ids, n.node_id), bisect.bisect_right(self.block_ids, n.end_id)
        return hi - lo, self.blocks[lo] if hi > lo else None


def _scored(root: Node, tags: Sequence[str], stop: Sequence[str]) -> Iterator[tuple[float, Node, list[Node], str]]:
    """Score, block, the paragraphs that stand for it, if any, and text."""
    sums = _Sums(root, tags)
    for d in sums.blocks:
        n = sums.bare(d)
        if not n:
            continue
        text = sums.inner_text(d)
        score = 15.0
        inside, first = sums.inner_blocks(d)
        if inside > 1:
            score -= 3 * sums.below(sums.filled, d)
        score -= 2 * sums.below(sums.links, d)
        score += n / 40
        holder = d if any(c.tag == "p" for c in d.children) else first
        kids = [c for c in holder.children if c.tag in ("p", "pre", "img")] if holder and any(c.tag == "p" for c in holder.children) else []
        whole: list[Node] = []
        if kids:
            m = sum(map(sums.bare, kids))
            linked = [c for c in kids if sums.below(sums.links, c)]
            if (n - m) / n <= 0.1:
                whole, text = kids, "\n".join(map(sums.inner_text, kids))
                score = 15.0 + m // 40 + len(kids) - 1 - 2 * len(linked)
                k = sum(sums.below(sums.linked, c) for c in kids)
                if linked and m and (m - k) / m <= 0.05:
                    score -= 100
        if n < 25:
            score -= 2 * (25 - n)
        run = 0
        for line in text.split("\n"):
            run = 0 if line.strip() else run + 1
            score -= 1.0 if run == 3 else 0.2 if run > 3 else 0.0
        score -= 5 * sum(p in text for p in stop)
        yield score, d, whole, text


_FILTERS = ((re.compile(r"(?is)<script\b.*?</script\s*>"), ""), (re.compile(r"(?is)<style\b.*?</style\s*>"), ""), (re.compile(r"(?s)<!--.*?-->"), ""), (re.compile(r"(?i)</a\s*>"), "</a>\n"))
_TEXT = ((re.compile(r"(?is)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|article|section|ul|ol|table)\s*>"), "\n"), (re.compile(r"(?s)<[^>]*>"), ""))


def clean_html(html: str, *, keep_images: bool = False) -> str:
    """Text of markup: block ends become newlines, entities are decoded."""
    html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", html)
    html = _TEXT[0][0].sub("\n", html)
    html = re.sub(r"(?is)<(?!img\b)[^>]*>" if keep_images else r"(?s)<[^>]*>", "", html)
    return decoded(html).strip()


def extract_articles(pages: DataFrame, *, tags: Sequence[str] = PARITY_TAGS, format: bool = False, stop: Sequence[str] = STOP_PHRASES, now: Column | None = None) -> DataFrame:
    """page_id, url, title, date_text, pub_date, score, html_content, content.

    One row for each page: stateless, no shuffle, valid on a stream. Pages
    without a scored block have null score and contents. ``format`` runs the
    publishing formatter over the block.
    """
    from loomtext.operators.formatter import format_html

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                for pattern, to in _FILTERS:
                    html = pattern.sub(to, html or "")
                root = parse(html)
                best = max(_scored(root, tags, stop), key=lambda x: x[0], default=None)
                content = ("".join(c.outer_html() for c in best[2]) if best[2] else best[1].inner_html()) if best else None
                if format and content is not None:
                    content = format_html(content, url or "")
                rows.append((page_id, url, html, date_text(root), best[0] if best else None, content, clean_html(content) if content else None))
            yield pa.RecordBatch.from_pylist([dict(zip(("page_id", "url", "html", "date_text", "score", "html_content", "content"), r)) for r in rows], schema=_SCHEMA)

    x = mapped(pages.select("page_id", "url", "html"), f, "page_id long, url string, html string, date_text string, score double, html_content string, content string")
    return x.select("page_id", "url", title(F.col("html")).alias("title"), "date_text", parse_date(F.col("date_text"), now).alias("pub_date"), "score", "html_content", "content")


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("date_text", pa.string()), ("score", pa.float64()), ("html_content", pa.string()), ("content", pa.string())])
