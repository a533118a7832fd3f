"""Node paths: a subset of XPath over the tree, and short paths of nodes.

Steps: ``/``, ``//``, ``.``, ``..``, a tag or ``*``, ``text()``, a final
``@name``; predicates ``[n]``, ``[last()]``, ``[last()>=n]``, ``[@a]``,
``[@a='v']``, ``[contains(@a,'v')]`` and ``[not(..)]`` of the attribute forms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.operators.dom import Node, parse
from loomtext.operators.frames import mapped

_STEP = re.compile(r"(//|/)?((?:[^/\[\]'\"]+|\[(?:[^\[\]'\"]|'[^']*'|\"[^\"]*\")*\])+)")
_PREDICATE = re.compile(r"\[((?:[^\[\]'\"]|'[^']*'|\"[^\"]*\")*)\]")
_EQUAL = re.compile(r"@([\w\-:]+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|(\S+))$")
_CONTAINS = re.compile(r"contains\(\s*@([\w\-:]+)\s*,\s*(?:'([^']*)'|\"([^\"]*)\")\s*\)$")


@lru_cache(4096)
def compiled(path: str) -> tuple[tuple[bool, str, tuple[str, ...]], ...]:
    """(any depth, tag, predicates) of each step."""
    out, path = [], path.strip()
    for m in _STEP.finditer(path):
        tag = m[2].split("[", 1)[0].strip()
        out.append((m[1] == "//", tag, tuple(p.strip() for p in _PREDICATE.findall(m[2]))))
    return tuple(out)


def _holds(n: Node, p: str) -> bool:
    if p.startswith("not(") and p.endswith(")"):
        return not _holds(n, p[4:-1].strip())
    if m := _CONTAINS.match(p):
        return next(g for g in m.groups()[1:] if g is not None) in n.attrs.get(m[1], "")
    if m := _EQUAL.match(p):
        return n.attrs.get(m[1]) == next(g for g in m.groups()[1:] if g is not None)
    if p.startswith("@"):
        return p[1:] in n.attrs
    raise ValueError(f"predicate [{p}] is not supported")


def _pick(found: list[Node], predicates: tuple[str, ...]) -> list[Node]:
    for p in predicates:
        if p.isdigit():
            found = found[int(p) - 1 : int(p)]
        elif p == "last()":
            found = found[-1:]
        elif m := re.fullmatch(r"last\(\)\s*>=\s*(\d+)", p):
            found = found if len(found) >= int(m[1]) else []
        else:
            found = [n for n in found if _holds(n, p)]
    return found


def select(base: Node, path: str) -> list[Node]:
    """The nodes of a path, without repetition, in document order. A leading /
    starts at the root of the page, anything else at ``base``."""
    steps = compiled(path)
    if not steps:
        return [base]
    now = [base]
    if path.lstrip().startswith("/"):
        while now[0].parent is not None:
            now = [now[0].parent]
    for deep, tag, predicates in steps:
        if tag in (".", ""):
            if deep:
                now = [x for n in now for x in (n, *n.descendants())]
            continue
        if tag == "..":
            now = [n.parent for n in now if n.parent is not None]
        elif tag.startswith("@"):
            now = [n for n in now if tag[1:] in n.attrs]
        else:
            want = "#text" if tag == "text()" else tag
            match = lambda c: c.tag == want or want == "*" and c.tag != "#text"  # noqa: B023, E731
            parents = [x for n in now for x in (n, *n.descendants())] if deep else now
            now = [x for p in parents for x in _pick([c for c in p.children if match(c)], predicates)]
        now = list({id(n): n for n in now}.values())
    return sorted(now, key=lambda n: n.node_id)


def without_ordinals(path: str, level: int) -> str:
    """Without the ``level``-th ordinal from the right; as it is if there are fewer."""
    hits = list(re.finditer(r"\[\d+\]", path))
    return path[: hits[-level].start()] + path[hits[-level].end() :] if 0 < level <= len(hits) else path


def sequence_stem(n: Node, root: Node, least: int = 10) -> str | None:
    """The id without its number, if the number has 3 digits or more and at
    least ``least`` nodes have an id of that stem."""
    stem = re.sub(r"\d{3,}", "", n.attrs.get("id", ""))
    if not re.search(r"\d{3,}", n.attrs.get("id", "")):
        return None
    like = sum(re.sub(r"\d{3,}", "", x.attrs["id"]) == stem for x in root.descendants() if x.tag == n.tag and "id" in x.attrs)
    return stem if like >= least else None


def random_id(n: Node, least: int = 10) -> bool:
    """An id of 9 characters or more in a row of ``least`` siblings whose ids are as long."""
    if len(n.attrs.get("id", "")) < 9 or n.parent is None:
        return False
    like = [c for c in n.parent.children if c.tag == n.tag]
    at, size = like.index(n), len(n.attrs["id"])
    same = [len(c.attrs.get("id", "")) == size for c in like]
    lo = hi = at
    while lo > 0 and same[lo - 1]:
        lo -= 1
    while hi + 1 < len(same) and same[hi + 1]:
        hi += 1
    return hi - lo + 1 >= least


class ShortPaths:
    """Short paths within one page: by a unique id, then by a class unique in
    the page, else the parent's path and one more step."""

    def __init__(self, root: Node):
        self.root = root
        self.ids: Counter[tuple[str, str]] = Counter()
        self.classes: Counter[tuple[str, str]] = Counter()
        for n in root.descendants():
            if "id" in n.attrs:
                self.ids[n.tag, n.attrs["id"]] += 1
            for c in set(n.attrs.get("class", "").split()):
                self.classes[n.tag, c] += 1
        self.known: dict[int, str] = {}

    def of(self, n: Node) -> str:
        if n.node_id not in self.known:
            self.known[n.node_id] = self._of(n)
        return self.known[n.node_id]

    def _of(self, n: Node) -> str:
        if n.tag == "#document":
            return ""
        tag = n.tag.replace("#text", "text()")
        i = n.attrs.get("id")
        if i and "'" not in i and self.ids[n.tag, i] == 1 and not random_id(n):
            stem = sequence_stem(n, self.root)
            if stem is None:
                return f"//{tag}[@id='{i}']"
        for c in n.attrs.get("class", "").split():
            if "'" not in c and "$" not in c and self.classes[n.tag, c] == 1:
                whole = [x for x in self.root.descendants() if x.tag == n.tag and c in x.attrs.get("class", "")]
                if len(whole) == 1:
                    return f"//{tag}[contains(@class,'{c}')]"
        like = [c for c in n.parent.children if c.tag == n.tag] if n.parent else [n]
        return f"{self.of(n.parent) if n.parent else ''}/{tag}" + (f"[{n.sib_ord}]" if len(like) > 1 else "")


def class_and_id_path(n: Node) -> str:
    """Absolute path with id and class predicates; ids with two digits or more are left out."""
    steps = []
    for x in (n, *n.ancestors()):
        i, c = x.attrs.get("id", ""), x.attrs.get("class", "")
        steps.append(x.tag + (f"[@id='{i}']" if i and sum(d.isdigit() for d in i) < 2 else "") + (f"[@class='{c}']" if c else ""))
    return "/" + "/".join(reversed(steps))


def id_kinds(pages: DataFrame, least: int = 10) -> DataFrame:
    """page_id, node_id, tag, sib_ord, id, stem, random: of every node with an id the
    stem if it counts on, and whether it looks drawn at random."""
    names = ["page_id", "node_id", "tag", "sib_ord", "id", "stem", "random"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = parse(html)
                rows += [(page_id, n.node_id, n.tag, n.sib_ord, n.attrs["id"], sequence_stem(n, root, least), random_id(n, least)) for n in root.descendants() if "id" in n.attrs]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return mapped(pages.select("page_id", "html"), f, "page_id long, node_id long, tag string, sib_ord int, id string, stem string, random boolean")
