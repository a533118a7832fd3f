"""A tolerant HTML tree and the node table.

Rules of our own: void elements have no children; an open ``p`` ends at the
next block, ``li``, ``td``, ``tr``, ``option`` at their like; an end tag closes
the nearest open element of its name and all within, or is ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.functions.markup import Tags, decoded
from loomtext.operators.frames import mapped

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
_ENDS_P = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("ul", "ol"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:\-]*)|[^<]+|<", re.S)
_OPEN = re.compile(r"[^<]+|<")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element, a text (tag ``#text``) or the root (tag ``#document``)."""

    __slots__ = ("tag", "attrs", "children", "parent", "text", "node_id", "end_id", "sib_ord")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, text: str = ""):
        self.tag, self.attrs, self.children, self.parent, self.text = tag, attrs or {}, [], parent, text
        self.node_id = self.end_id = self.sib_ord = 0

    def descendants(self) -> Iterator[Node]:
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.children[::-1]

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None and n.tag != "#document":
            yield n
            n = n.parent

    def inner_text(self) -> str:
        if self.tag == "#text":
            return self.text
        return "".join(n.text for n in self.descendants() if n.tag == "#text")

    def own_text(self) -> str:
        """Text directly inside, or all of a link's, joined by blanks."""
        if self.tag == "#text":
            return self.text
        return " ".join(c.inner_text().strip() for c in self.children if c.tag == "#text" or self.tag == "a").rstrip(" ")

    def clean_text(self) -> str:
        return " ".join(decoded(self.inner_text()).split())

    def inner_html(self) -> str:
        return "".join(c.outer_html() for c in self.children)

    def outer_html(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "#text":
                out.append(n.text)
            else:
                if n.tag != "#document":
                    out.append(f"<{n.tag}" + "".join(f' {k}="{v}"' for k, v in n.attrs.items()) + ">")
                    if n.tag not in VOID:
                        stack.append(f"</{n.tag}>")
                stack += n.children[::-1]
        return "".join(out)

    def path(self) -> str:
        """Absolute path with the ordinal of every step."""
        steps = [f"{n.tag.replace('#text', 'text()')}[{n.sib_ord}]" for n in (self, *self.ancestors()) if n.tag != "#document"]
        return "/" + "/".join(reversed(steps))

    @property
    def depth(self) -> int:
        return sum(1 for _ in self.ancestors()) + 1 if self.tag != "#document" else 0


def parse(html: str | None) -> Node:
    root = Node("#document")
    open_: list[Node] = [root]
    at, html = 0, html or ""
    tags = Tags(html)

    def add(n: Node) -> None:
        n.parent = open_[-1]
        open_[-1].children.append(n)

    while at < len(html):
        # behind the last > there is text and perhaps a comment left open
        m = (_TAG if at <= tags.last or html.startswith("<!--", at) else _OPEN).match(html, at)
        name, inside = m[2] if m.re is _TAG else None, ""
        if name is not None:
            stop = tags.end(m.end())
            inside = html[m.end() : stop - 1]
            at = stop
        else:
            at = m.end()
        if name is None:
            if m[0][:2] not in ("<!", "<?"):
                add(Node("#text", text=m[0]))
            continue
        name = name.lower()
        if m[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == name:
                    del open_[i:]
                    break
            continue
        if name in _ENDS_P:
            _close(open_, "p", ("td", "th", "div", "li", "table"))
        if name in _SAME:
            _close(open_, name, _SAME[name])
        attrs: dict[str, str] = {}
        for a in _ATTR.finditer(inside.rstrip("/")):
            attrs.setdefault(a[1].lower(), next((g for g in a.groups()[1:] if g is not None), ""))
        n = Node(name, attrs)
        add(n)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            raw = html[at : end.start() if end else len(html)]
            if raw:
                n.children.append(Node("#text", parent=n, text=raw))
            at = end.end() if end else len(html)
        elif name not in VOID and not inside.endswith("/"):
            open_.append(n)
    _number(root)
    return root


def _close(open_: list[Node], tag: str, until: tuple[str, ...]) -> None:
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag == tag:
            del open_[i:]
            return
        if open_[i].tag in until:
            return


def _number(root: Node) -> None:
    """Pre-order ids, the last id of each subtree, ordinals among like siblings."""
    order = [root, *root.descendants()]
    for i, n in enumerate(order):
        n.node_id = n.end_id = i
    for n in reversed(order):
        if n.children:
            n.end_id = n.children[-1].end_id
        seen: Counter[str] = Counter()
        for c in n.children:
            seen[c.tag] += 1
            c.sib_ord = seen[c.tag]


NODES = "page_id long, node_id long, end_id long, parent_id long, depth int, sib_ord int, tag string, attrs map<string,string>, own_text string, text string, xpath string"
_NODES = pa.schema([("page_id", pa.int64()), ("node_id", pa.int64()), ("end_id", pa.int64()), ("parent_id", pa.int64()), ("depth", pa.int32()), ("sib_ord", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string()), ("text", pa.string()), ("xpath", pa.string())])


def _rows(page_id: int, root: Node, subtree_text: bool, tags: frozenset[str] | None = None) -> list[tuple]:
    """The rows of a page, of all nodes or those of some tags: paths grow from the parent's, texts are cut from the page's."""
    nodes = [root, *root.descendants()]
    text = "".join(n.text for n in nodes if n.tag == "#text")
    at = list(itertools.accumulate((len(n.text) if n.tag == "#text" else 0 for n in nodes), initial=0))
    paths, depth, out = [""] * len(nodes), [0] * len(nodes), []
    for n in nodes[1:]:
        k, up = n.node_id, n.parent.node_id
        paths[k] = f"{paths[up]}/{n.tag.replace('#text', 'text()')}[{n.sib_ord}]"
        depth[k] = depth[up] + 1
        if tags is not None and n.tag not in tags:
            continue
        inner = text[at[k] : at[n.end_id + 1]] if subtree_text or n.tag == "#text" else None
        own = n.text if n.tag == "#text" else " ".join(text[at[c.node_id] : at[c.end_id + 1]].strip() for c in n.children if c.tag == "#text" or n.tag == "a").rstrip(" ")
        out.append((page_id, k, n.end_id, up, depth[k], n.sib_ord, n.tag, list(n.attrs.items()), own, inner, paths[k]))
    return out


def node_table(pages: DataFrame, *, subtree_text: bool = True, tags: Iterable[str] | None = None) -> DataFrame:
    """One row for each node, or each node of some ``tags``: "B inside A" is B.node_id in (A.node_id, A.end_id].

    ``text`` is all the text inside a node; without ``subtree_text`` only text
    nodes have it, which keeps deep pages small: what an element holds is then
    the text nodes up to its end_id."""

    some = None if tags is None else frozenset(tags)
    enough = 1 if some is None else 4096  # a page's whole table is a batch of its own

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for left, page_id, html in zip(range(b.num_rows - 1, -1, -1), b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += _rows(page_id, parse(html), subtree_text, some)
                if left and len(rows) < enough:
                    continue
                batch, rows = rows, []
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*batch) if batch else [[]] * len(_NODES), _NODES)], schema=_NODES)

    return mapped(pages.select("page_id", "html"), f, NODES)
