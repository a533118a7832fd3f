"""Publishing form of article markup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.operators.dom import Node, parse
from loomtext.operators.frames import mapped

_DROPPED = frozenset("script style noscript link meta form input button select textarea object".split())
_UNWRAPPED = frozenset("font center html body article section main header footer".split())
_KEPT_ATTRS = {"img": {"src", "alt", "width", "height"}, "a": {"href", "title"}, "embed": {"src", "width", "height", "type", "allowfullscreen"}, "iframe": {"src", "width", "height", "allowfullscreen", "frameborder"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}, "video": {"src", "controls", "poster"}, "source": {"src", "type"}}
_LOGO = re.compile(r"(?i)(?:share|icon|logo)[\w\-]*\.(?:gif|png|jpe?g|ico)")
_EMPTY_BRACKETS = re.compile(r"\(\s*\)|（\s*）|\[\s*\]|【\s*】")


def format_html(html: str | None, url: str = "") -> str | None:
    """Images get an alt, their real source and an absolute address, icons and
    share logos go, players keep only harmless attributes, empty paragraphs,
    event handlers, styles and data attributes go, so do empty brackets."""
    if not html:
        return html
    root = parse(html)
    _edit(root, url)
    return _EMPTY_BRACKETS.sub("", re.sub(r"[ \t\u3000]{2,}", " ", root.inner_html())).strip()


def _edit(n: Node, url: str) -> None:
    out: list[Node] = []
    for c in n.children:
        if c.tag == "#text":
            out.append(c)
            continue
        if c.tag in _DROPPED:
            continue
        _edit(c, url)
        if c.tag == "img":
            src = c.attrs.get("real_src") or c.attrs.get("data-src") or c.attrs.get("src") or ""
            if not src or _LOGO.search(src):
                continue
            c.attrs = {**c.attrs, "src": urljoin(url, src.strip()), "alt": c.attrs.get("alt", "")}
        elif c.tag == "a" and "href" in c.attrs:
            href = c.attrs["href"].strip()
            if not href or href.lower().startswith(("javascript:", "#")):
                out += c.children
                continue
            c.attrs["href"] = urljoin(url, href)
        elif c.tag in ("embed", "iframe", "video", "source") and c.attrs.get("src"):
            c.attrs["src"] = urljoin(url, c.attrs["src"])
        keep = _KEPT_ATTRS.get(c.tag, set())
        c.attrs = {k: v for k, v in c.attrs.items() if k in keep}
        if c.tag in ("p", "span", "strong", "b", "em", "div") and not c.inner_text().replace("&nbsp;", "").strip("\u3000 \t\r\n") and not any(x.tag in ("img", "embed", "iframe", "video") for x in c.descendants()):
            continue
        if c.tag == "p" and c.children and c.children[0].tag == "#text":
            c.children[0].text = re.sub(r"^(?:\s|\u3000|&nbsp;)+", "", c.children[0].text)
        if c.tag in _UNWRAPPED:
            out += c.children
        else:
            out.append(c)
    for c in out:
        c.parent = n
    n.children = out


def format_pages(rows: DataFrame, html: str = "html", url: str = "url", to: str = "formatted") -> DataFrame:
    """``rows`` with the publishing form of a column of markup."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{to}` string"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, u = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (html, url))
            done = pa.array([format_html(x, y or "") for x, y in zip(h, u)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, done], names=[*b.schema.names, to])

    return mapped(rows, f, schema)
