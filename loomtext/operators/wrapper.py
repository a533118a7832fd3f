"""Wrappers: paths or regular expressions that turn pages into rows."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.article import clean_html, parse_date
from loomtext.operators.dom import Node, parse
from loomtext.operators.formatter import format_html
from loomtext.operators.frames import mapped
from loomtext.operators.xpath import select

AUTHOR = r"作\s*者|编\s*辑|记\s*者|选\s*稿|(?i:author|by)\s*(?=[:：])"
MEDIA = r"来\s*源(?:\s*于)?|来\s*自|媒\s*体|转\s*[载自]|原\s*文|(?i:source)\s*(?=[:：])"
ITEM = "item_no int, url string, title string, media string, author string, date_text string, abstract string, views int, replies int"
_ITEM = pa.schema([("page_id", pa.int64()), ("item_no", pa.int32()), *((c, pa.string()) for c in ("url", "title", "media", "author", "date_text", "abstract")), ("views", pa.int32()), ("replies", pa.int32())])


def items_schema() -> pa.Schema:
    """The columns of list items before their dates are read."""
    return _ITEM


items_schema.ddl = f"page_id long, {ITEM}"


def with_dates(items: DataFrame) -> DataFrame:
    return items.withColumn("pub_date", parse_date(F.col("date_text")))


def segment(text: str | None, prefix: str) -> str | None:
    """What stands behind the last label, up to the next blank."""
    if not text:
        return text
    hits = list(re.finditer(prefix, text))
    if not hits:
        return text
    rest = text[hits[-1].end() :].lstrip(":：]】 ")
    return rest.split(" ", 1)[0] if rest.find(" ") > 0 else rest


def clean_author(s: str | None) -> str | None:
    s = segment(s, AUTHOR)
    return re.split(r"来源|时间|日期", s)[0].strip() if s else s


def clean_media(s: str | None) -> str | None:
    s = segment(s, MEDIA)
    return s.split(" ")[0] if s else s


def _text(base: Node, path: str | None, at: int = 0) -> str | None:
    if not path:
        return base.clean_text()
    found = [n for n in select(base, path) if n.own_text().strip() or n.inner_text().strip()]
    return found[min(at, len(found) - 1)].clean_text() if found else None


def _numbers(s: str | None) -> list[int]:
    return [int(x) for x in re.findall(r"\d{1,9}", (s or "").replace(",", ""))]


def list_items(root: Node, url: str, p: dict) -> Iterator[tuple]:
    """The items of a page by a path pattern, one for each link of each base node.

    Links to documents (.pdf) and addresses with @ are left out. One cell for
    views and replies gives the larger number to the views."""
    n = 0
    for base in select(root, p["ItemRootXPath"]) if p.get("ItemRootXPath") else []:
        title_path = p.get("TitleXPath")
        if not title_path:
            continue
        links = [x for x in select(base, p.get("UrlXPath") or title_path) if x.attrs.get("href")]
        for i, link in enumerate(links):
            href = link.attrs["href"]
            if href.startswith("javascript:") and (m := re.search(r"\('([^']*)'", href)):
                href = m[1]
            href = urljoin(url, href.replace("&amp;", "&").strip())
            if ".pdf" in href or "@" in href or href.lower().startswith("javascript:"):
                continue
            views = replies = None
            seen = _numbers(_text(base, p["ViewXPath"], i)) if p.get("ViewXPath") else []
            if len(seen) == 1:
                views = seen[0]
            elif len(seen) > 1 and p.get("ViewXPath") == p.get("ReplyXPath"):
                views, replies = max(seen[:2]), min(seen[:2])
            if p.get("ReplyXPath") and p["ReplyXPath"] != p.get("ViewXPath") and (seen := _numbers(_text(base, p["ReplyXPath"], i))):
                replies = seen[0]
            get = lambda k: _text(base, p[k], i) if p.get(k) else None  # noqa: B023, E731
            yield n, href, _text(base, title_path, i), clean_media(get("MediaNameXPath")), clean_author(get("AuthorXPath")), get("DateXPath"), get("AbsTractXPath"), views, replies
            n += 1


def parse_lists(pages: DataFrame) -> DataFrame:
    """Items of pages (page_id, url, html, pattern): one row for each item.

    ``pattern`` is JSON with ItemRootXPath, TitleXPath, UrlXPath, DateXPath,
    MediaNameXPath, AuthorXPath, AbsTractXPath, ViewXPath, ReplyXPath. Pages
    with a null or broken pattern have no items."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, html, pattern in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    p = json.loads(pattern or "{}")
                except ValueError:
                    p = {}
                out += [dict(zip(_ITEM.names, (page_id, *row))) for row in list_items(parse(html), url or "", p)]
            yield pa.RecordBatch.from_pylist(out, schema=_ITEM)

    return with_dates(mapped(pages.select("page_id", "url", "html", "pattern"), f, items_schema.ddl))


def better_date(listed: Column, item: Column, now: Column) -> Column:
    """The item page's date (after 2000) where the list has none, has no time of
    day while the item has, or is fresh and well past an item date with a time."""
    timed = lambda t: (F.hour(t) + F.minute(t) + F.second(t)) > 0
    fresh = (listed > F.timestamp_micros(F.unix_micros(now) - 600_000_000)) & (F.unix_seconds(listed) - F.unix_seconds(item) > 119)
    use = listed.isNull() | (~timed(listed) & timed(item)) | (timed(item) & fresh)
    return F.when(item.isNotNull() & (F.year(item) > 2000) & use, item).otherwise(listed)


_ONE = "page_id long, title string, media string, author string, date_text string, views int, replies int, html_content string, content string"
_ONE_PA = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("title", "media", "author", "date_text")), ("views", pa.int32()), ("replies", pa.int32()), ("html_content", pa.string()), ("content", pa.string())])


def parse_items(pages: DataFrame) -> DataFrame:
    """Fields of item pages (page_id, url, html, pattern) by Item..XPath paths."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, html, pattern in zip(*(c.to_pylist() for c in b.columns)):
                p = json.loads(pattern or "{}")
                root = parse(html)
                get = lambda k: _text(root, p[k]) if p.get(k) else None  # noqa: B023, E731
                one = lambda k: next(iter(_numbers(get(k))), None)  # noqa: B023, E731
                body = "".join(format_html(n.outer_html(), url or "") or "" for n in select(root, p["ItemContentXPath"])) if p.get("ItemContentXPath") else None
                body = clean_links(clean_editor(body)) if body else body
                row = (page_id, get("ItemTitleXPath"), clean_media(get("ItemMediaNameXPath")), clean_author(get("ItemAuthorXPath")), get("ItemDateXPath"), one("ItemViewXPath"), one("ItemReplyXPath"), body, clean_html(body) if body else None)
                out.append(dict(zip(_ONE_PA.names, row)))
            yield pa.RecordBatch.from_pylist(out, schema=_ONE_PA)

    return mapped(pages.select("page_id", "url", "html", "pattern"), f, _ONE).withColumn("pub_date", parse_date(F.col("date_text")))


def merged_items(listed: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """List rows (with page_id of their item page) completed from item pages."""
    i = items.select("page_id", *(F.col(c).alias(f"i_{c}") for c in ("title", "media", "author", "pub_date", "views", "replies", "html_content", "content")))
    x = listed.join(i, "page_id", "left")
    for c in ("title", "media", "author", "views", "replies"):
        x = x.withColumn(c, F.coalesce(c, f"i_{c}"))
    return x.withColumn("pub_date", better_date(F.col("pub_date"), F.col("i_pub_date"), now)).withColumnsRenamed({"i_html_content": "html_content", "i_content": "content"}).drop("i_title", "i_media", "i_author", "i_pub_date", "i_views", "i_replies")


_EDITOR = re.compile(r"[(（\[【][^()（）\[\]【】]{0,60}?(?:编辑|责编|记者|来源|本文)[^()（）\[\]【】]{0,60}?[)）\]】]")
_NAVIGATION = re.compile(r"(?is)<a\b[^>]*>(?:(?!</a).)*?(?:更多|返回|首页|点击|进入|专题|下一页|上一页|>>)(?:(?!</a).)*</a\s*>")


def clean_editor(html: str) -> str:
    """Without bracketed notes on editors and sources."""
    return _EDITOR.sub("", html)


def clean_links(html: str) -> str:
    """Without links that only lead elsewhere."""
    return _NAVIGATION.sub("", html)


def regex_rows(pages: DataFrame, *, first_only: bool = False, seconds: float = 10.0) -> DataFrame:
    """Rows of pages (page_id, url, html, pattern) by a pattern with named groups.

    Groups: Url, Title, Text, AuthorName, Source or MediaName, PubDate, View,
    Reply, Forward, NextPageUrl. Counters are 0 where absent. Where the matching
    of a page takes longer than ``seconds``, its rows found by then have false in
    ``complete``; if there are none, one row without values tells it."""
    text = ("Url", "Title", "Text", "AuthorName", "MediaName", "PubDate", "NextPageUrl")
    count = ("View", "Reply", "Forward")
    names = ["page_id", "match_no", "url", "title", "text", "author", "media", "date_text", "next_page_url", "views", "replies", "forwards"]
    schema = pa.schema([("page_id", pa.int64()), ("match_no", pa.int32()), *((n, pa.string()) for n in names[2:9]), *((n, pa.int32()) for n in names[9:]), ("complete", pa.bool_())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, html, pattern in zip(*(c.to_pylist() for c in b.columns)):
                if not pattern or html is None:
                    continue
                end, mine, late = time.monotonic() + seconds, [], False
                for k, m in enumerate(re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern), re.I | re.M).finditer(html)):
                    g = {n: (v or "").strip() for n, v in m.groupdict().items()}
                    g.setdefault("MediaName", g.get("Source", ""))
                    words = [g.get(n) or None for n in text]
                    words[0] = urljoin(url or "", words[0]) if words[0] else None
                    numbers = [next(iter(_numbers(g.get(n))), 0) for n in count]
                    mine.append(dict(zip(names, (page_id, k, *words, *numbers))))
                    late = time.monotonic() > end
                    if first_only or late:
                        break
                late = late or (not mine and time.monotonic() > end)
                out += [{**r, "complete": not late} for r in mine or [{"page_id": page_id}] * late]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ddl = "page_id long, match_no int, url string, title string, text string, author string, media string, date_text string, next_page_url string, views int, replies int, forwards int, complete boolean"
    return mapped(pages.select("page_id", "url", "html", "pattern"), f, ddl).withColumn("pub_date", parse_date(F.col("date_text")))
