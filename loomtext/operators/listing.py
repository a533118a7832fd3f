"""Repeated items of list pages: patterns of links and of the fields beside them.

Links are seeds. Level by level, up to ``CLIMB``, seeds whose paths agree but
for one ordinal, in nodes of the same tag and child tags, form groups; small
groups also climb on. Groups under one parent merge. Each pattern gets a short
base path and a relative title path, patterns that select the same nodes
count once, and the best by score stay. Texts within a pattern's bases give
candidate paths for date, views, replies, media, author and abstract, which
are scored and combined.
"""

from __future__ import annotations

import datetime
import itertools
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.article import DATE_UNITS
from loomtext.operators.dom import Node, parse
from loomtext.operators.frames import mapped
from loomtext.operators.xpath import ShortPaths, select, without_ordinals


@dataclass(frozen=True)
class Strategy:
    """Constants by media type and language."""

    media: str = "news"
    language: str = "English"
    climb: int = 15
    merge: int = 8
    keep_patterns: int = 5
    keep_paths: int = 8
    share_of_best: float = 1 / 8
    best_count: int = 20
    best_title: int = 18
    longest_title: int = 70
    best_media: int = 4
    best_author: int = 3
    empty_score: float = 200.0
    today: datetime.date | None = None


STRATEGIES = {
    ("news", "Chinese"): Strategy("news", "Chinese", best_count=20, best_title=18, longest_title=70),
    ("forum", "Chinese"): Strategy("forum", "Chinese", best_count=40, best_title=16, longest_title=60),
    ("blog", "Chinese"): Strategy("blog", "Chinese", best_count=10, best_title=12, longest_title=70),
    ("news", "English"): Strategy("news", "English", best_title=25, best_media=12, best_author=12),
    ("forum", "English"): Strategy("forum", "English", best_count=40, best_title=25, longest_title=60, best_media=12, best_author=10),
    ("blog", "English"): Strategy("blog", "English", best_count=10, best_title=20, best_media=12, best_author=12),
}


def weighted_length(text: str) -> int:
    """Without blanks; runs of ASCII letters, digits and operators count half."""
    s = "".join(text.split())
    a = sum(len(m) for m in re.findall(r"[a-zA-Z0-9+\-*\\/]+", s))
    return len(s) - a + a // 2


def good_href(href: str) -> bool:
    h = href.strip().lower()
    return bool(h) and not h.startswith(("#", "javascript:", "mailto:", "tel:"))


def valid_title(text: str, language: str = "English") -> bool:
    """Long enough and less than half digits."""
    t = text.strip()
    digits = sum(c.isdigit() for c in t)
    enough = len(t) >= 5 if language == "Chinese" else len(t.split()) > 5
    return enough and digits * 2 < len(t)


def histogram(n: Node) -> tuple[tuple[str, int], ...]:
    return tuple(sorted(Counter(c.tag for c in n.children).items()))


@dataclass
class Pattern:
    base: str
    title: str
    nodes: tuple[int, ...]
    count: int
    mean_length: float
    score: float = 0.0
    fields: dict[str, str] = field(default_factory=dict)
    total: float = 0.0


def _ancestor(n: Node, k: int) -> Node | None:
    for _ in range(k):
        if n.parent is None or n.parent.tag in ("#document", "html"):
            return None
        n = n.parent
    return n


def groups(links: list[Node], s: Strategy) -> list[tuple[list[Node], int]]:
    """(links, levels up to their base node) of each group of two or more."""
    out: list[tuple[list[Node], int]] = []
    rows = [(n, n.path()) for n in links]
    for level in range(s.climb):
        keyed: dict[tuple, list[tuple[Node, str]]] = defaultdict(list)
        for n, path in rows:
            base = _ancestor(n, level)
            if base is not None:
                keyed[without_ordinals(path, level + 1), base.tag, histogram(base)].append((n, path))
        rows = []
        for same in keyed.values():
            if len(same) > 1:
                out.append(([n for n, _ in same], level))
            if len(same) < 4:
                rows += same
        if not rows:
            break
    return out


def merged(found: list[tuple[list[Node], int]], s: Strategy) -> list[tuple[list[Node], int]]:
    """Groups whose bases have one grandparent, tag, child tags and way to the
    link become one, again and again up to ``merge`` levels."""
    for up in range(1, s.merge + 1):
        keyed: dict[tuple, list[Node]] = defaultdict(list)
        way: dict[tuple, int] = {}
        for nodes, level in found:
            base = _ancestor(nodes[0], level)
            top = _ancestor(nodes[0], level + up)
            suffix = re.sub(r"\[\d+\]", "", nodes[0].path()[len(base.path()) :]) if base else ""
            key = (top.node_id if top else ("alone", nodes[0].node_id, level), base.tag if base else "", histogram(base) if base else (), suffix, level)
            keyed[key] += nodes
            way[key] = level
        found = [(list({n.node_id: n for n in nodes}.values()), way[k]) for k, nodes in keyed.items()]
    return found


def relative(n: Node, base: Node, *, ordinals: bool = True) -> str:
    """Path of ``n`` from ``base``; steps among like siblings have an ordinal."""
    steps = []
    while n is not base:
        like = sum(c.tag == n.tag for c in n.parent.children)
        steps.append(n.tag.replace("#text", "text()") + (f"[{n.sib_ord}]" if ordinals and like > 1 else ""))
        n = n.parent
    return "./" + "/".join(reversed(steps)) if steps else "."


def title_score(count: int, length: float, named: bool, heading: bool, s: Strategy) -> float:
    """More for counts and lengths near the best ones, named paths and headings."""
    short = 300 * (1 - min(1.0, abs(math.log(max(length, 1) / s.best_title)) / math.log(8)))
    if length > s.longest_title:
        short /= 2
    many = 200 * (1 - min(1.0, abs(math.log(max(count, 1) / s.best_count)) / math.log(20)))
    return (short + many) * (1.2 if named else 1.0) * (1.5 if heading else 1.0)


_MEDIA_WORDS = re.compile(r"来源|来自|媒体|转载|(?i:source|via)\s*[:：]")
_MEDIA_ENDS = re.compile(r"(?:网|报|社|台|在线|新闻|周刊|杂志|(?i:news|times|post|daily|\.com|\.net))$")
_AUTHOR_WORDS = re.compile(r"作者|编辑|记者|楼主|(?i:author|by)\s*[:：]|^(?i:by)\s")
_REPLY = re.compile(r"回复|回帖|评论|跟帖|(?i:repl(?:y|ies)|comments?)")
_DATE = re.compile(r"\d{2,4}[-/年.]\d{1,2}(?:[-/月.]\d{1,2})?|\d{1,2}:\d{2}|\d+\s*(?:分钟|小时|天)前|昨天|前天")


def name_score(n: Node, must: tuple[str, ...], never: tuple[str, ...], up: int = 3) -> float:
    """Keywords in the ids and classes of a node and its ancestors, fading by 0.8."""
    total = 1.0
    for k, x in enumerate(itertools.islice((n, *n.ancestors()), up)):
        names = (x.attrs.get("id", "") + " " + x.attrs.get("class", "")).lower()
        w = 0.8**k
        yes, no = any(m in names for m in must), any(m in names for m in never)
        if yes:
            total += (0.5 if no else 1.5) * w
        elif no:
            return 0.0 if k == 0 else max(0.0, total - w)
    return total


def _length_factor(n: int, best: int) -> float:
    rate = max(n, 1) / best
    rate = rate if rate >= 1 else 1 / rate
    return 0.4 + 0.35 * (3 - rate) if rate <= 3 else 1 / 3


_DAY = re.compile(r"(\d{4}|\d{2})\s*[-/年.]\s*(\d{1,2})\s*[-/月.]\s*(\d{1,2})")
_AGO = re.compile(r"(\d+)\s*(分钟|小时|天)前")


def days_back(text: str, today: datetime.date) -> float | None:
    """How many days before ``today`` a date text lies; null if it is none."""
    if m := _DAY.search(text):
        year = int(m[1]) + (2000 if len(m[1]) == 2 else 0)
        try:
            return abs((today - datetime.date(year, int(m[2]), int(m[3]))).days)
        except ValueError:
            return None
    if m := _AGO.search(text):
        return int(m[1]) / {"分钟": 1440, "小时": 24, "天": 1}[m[2]]
    return 2.0 if "前天" in text else 1.0 if "昨天" in text else None


def nearness(days: float) -> float:
    """2 for today down to 1.5 for a day, 1 for a week and 0.3 from half a year on."""
    if days > 180:
        return 0.3
    if days > 7:
        return 1.0 - 0.7 * (days - 7) / 173
    return 1.5 - 0.5 * (days - 1) / 6 if days > 1 else 2.0 - 0.5 * days


def date_score(nodes: list[Node], bases: int, level: int, named: bool, today: datetime.date | None) -> float:
    """Dates on a third of the bases or more: their share, how near they are
    (twice as near with a time of day, nearer yet under a fitting name), less
    0.2 for each step beyond the first. Without ``today`` the days don't count."""
    texts = [n.clean_text() for n in nodes]
    dates = [t for t in texts if len(t) < 40 and _DATE.search(t)]
    if len(dates) * 3 < bases:
        return 0.0
    score = min(1.0, len(dates) / bases)
    names = name_score(nodes[0], ("date", "time"), ())
    if today is not None and (back := [d for t in dates if (d := days_back(t, today)) is not None]):
        mean = sum(back) / len(back) / (2 if any(re.search(r"\d{1,2}:\d{2}", t) for t in dates) else 1)
        score *= nearness(mean / max(names, 1e-9))
    else:
        score *= names
    return score * max(0.2, 1 - 0.2 * max(0, level - 1)) * (1.2 if named else 1.0)


def counter_scores(nodes: list[Node], level: int, named: bool, s: Strategy) -> tuple[float, float]:
    """(view, reply) of a path whose texts are one or two numbers and little else.

    One number each counts half more (a fifth more if they may be days of a
    month); two count double, or 0.8 where they may be month and day. A word or
    a name for replies rules views out; news pay replies less, forums views."""
    texts = [n.clean_text() for n in nodes]
    if any(c in "年月日前昨:" for t in texts for c in t):
        return 0.0, 0.0
    plain = sum(sum(c.isdigit() or c in " ,/|()[]" for c in _REPLY.sub("", t)) / max(1, len(_REPLY.sub("", t))) for t in texts) / len(texts)
    numbers = [re.findall(r"\d+", t.replace(",", "")) for t in texts]
    if not 0.8 <= plain <= 1 or not all(1 <= len(x) <= 2 for x in numbers):
        return 0.0, 0.0
    value = [[int(v) for v in x] for x in numbers]
    if all(len(x) == 1 for x in value):
        score = plain * (1.2 if all(x[0] <= 31 for x in value) else 1.5)
    else:
        score = plain * (0.8 if all(len(x) == 2 and x[0] <= 12 and x[1] <= 31 for x in value) else 2.0)
    score *= max(0.1, 1 - 0.1 * max(0, level - 1)) * (1.2 if named else 1.0)
    forced = any(_REPLY.search(t) for t in texts) or name_score(nodes[0], ("rep", "comment"), ()) > 1
    reply = score * name_score(nodes[0], ("rep", "comment"), ("view",)) * (0.8 if s.media == "news" else 1.0)
    view = 0.0 if forced else score * name_score(nodes[0], ("view", "click", "hit", "read"), ("rep",)) * (0.8 if s.media == "forum" else 1.0)
    return view, reply


_ENGLISH = re.compile(r"[A-Za-z]{2}")
_SEPARATED = re.compile(r"[,，、/|]")
_SURNAMES = frozenset("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严")


def _bare(t: str) -> int:
    return sum(not c.isspace() for c in t)


def media_score(nodes: list[Node], s: Strategy) -> float:
    """Names of sources: a label makes one, as do the endings that they have;
    dates, separators and, in Chinese lists, English words speak against."""

    def one(n: Node) -> float:
        t = n.clean_text()
        p = 0.1 if s.media == "news" else 0.0
        p = 1.0 if _MEDIA_WORDS.search(t) or _MEDIA_ENDS.search(t) else 0.8 if p and _bare(t) >= 2 and not t.isdigit() and s.language == "Chinese" else p
        p *= 0.3 if _DATE.search(t) else 1.0
        p *= name_score(n, ("source", "media", "from"), ("date", "time")) * _length_factor(_bare(t), s.best_media)
        p *= 0.6 if _SEPARATED.search(t) else 1.0
        p *= 0.6 if s.language == "Chinese" and _ENGLISH.search(t) else 1.0
        return p / 2 if s.media == "forum" else p

    return sum(map(one, nodes)) / len(nodes)


def author_score(nodes: list[Node], s: Strategy) -> float:
    """Names of people: a label makes one, a common surname helps; a name for
    replies rules it out."""

    def one(n: Node) -> float:
        t = n.clean_text()
        names = (n.attrs.get("id", "") + n.attrs.get("class", "")).lower()
        if "rep" in names:
            return 0.0
        p = 1.0 if _AUTHOR_WORDS.search(t) else 0.2 if s.media == "forum" else 0.0
        if s.language == "Chinese" and t:
            p *= 1.1 if t[0] in _SURNAMES else 0.6
        p *= name_score(n, ("author", "user", "name"), ("reply", "date")) * _length_factor(_bare(t), s.best_author)
        p *= 1.5 if s.media == "forum" and re.search("[A-Za-z0-9]", t) else 1.0
        return p * (0.6 if _SEPARATED.search(t) else 1.0)

    return sum(map(one, nodes)) / len(nodes)


def field_scores(nodes: list[Node], bases: int, level: int, named: bool, s: Strategy) -> dict[str, float]:
    """Score of one relative path for each field; its nodes are one for a base at most."""
    texts = [n.clean_text() for n in nodes]
    if not texts:
        return {}
    cover = min(1.0, len(texts) / bases)
    factor = 500 * cover * max(0.2, 1 - 0.1 * max(0, level - 1)) * (1.2 if named else 1.0)
    view, reply = counter_scores(nodes, level, named, s)
    dates = sum(bool(_DATE.search(t)) and len(t) < 40 for t in texts) / len(texts)
    out = {"DateXPath": 500 * date_score(nodes, bases, level, named, s.today), "ViewXPath": 500 * cover * view, "ReplyXPath": 500 * cover * reply}
    out["MediaNameXPath"], out["AuthorXPath"] = factor * media_score(nodes, s), factor * author_score(nodes, s)
    mean = lambda f: sum(map(f, texts)) / len(texts)
    length = mean(len)
    if length > 60 and dates < 0.5:
        out["AbsTractXPath"] = factor * min(1.0, length / 200) * name_score(nodes[0], ("desc", "abstract", "summary", "intro"), ())
    return {k: v for k, v in out.items() if v > 0}


FIELDS = ("DateXPath", "ViewXPath", "ReplyXPath", "MediaNameXPath", "AuthorXPath", "AbsTractXPath")


def combination(scores: dict[str, dict[str, float]], views: dict[str, float], s: Strategy) -> tuple[dict[str, str], float]:
    """The best choice of one path (or none) for each field under the rules of
    exclusion: no path for two fields, but views and replies in one cell."""
    best: tuple[float, dict[str, str]] = (-1.0, {})
    options = [[("", s.empty_score), *sorted(scores.get(f, {}).items(), key=lambda x: -x[1])[: s.keep_paths]] for f in FIELDS]
    for pick in itertools.product(*options):
        used = [p for p, _ in pick if p]
        if len(set(used)) < len(used):
            continue
        view, reply = pick[1][0], pick[2][0]
        if view and reply and views.get(view, 0) <= views.get(reply, 0):
            continue
        total = sum(v for _, v in pick)
        if total > best[0]:
            best = (total, {f: p for f, (p, _) in zip(FIELDS, pick) if p})
    return best[1], best[0]


def compositions(scores: DataFrame, strategy: Strategy | None = None) -> DataFrame:
    """page_id, field, path, score, total: the best choice of a path for each
    field of scored paths (page_id, pattern, field, score), by the rules of
    ``combination``. A page's paths come to one task; there are as many as its
    list items have nodes. Fields that no path is worth have no row."""
    s = strategy or Strategy()
    schema = pa.schema([("page_id", pa.int64()), ("field", pa.string()), ("path", pa.string()), ("score", pa.float64()), ("total", pa.float64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by: dict[str, dict[str, float]] = defaultdict(dict)
                for r in rows:
                    by[r["field"]][r["pattern"]] = max(r["score"], by[r["field"]].get(r["pattern"], 0.0))
                chosen, total = combination(by, by.get("ViewXPath", {}), s)
                out += [dict(zip(schema.names, (page_id, k, p, by[k][p], total))) for k, p in sorted(chosen.items())]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    some = scores.where("score > 0 and pattern <> ''").select(F.col("page_id").cast("long"), F.struct("pattern", "field", F.col("score").cast("double").alias("score")).alias("r"))
    return mapped(some.groupBy("page_id").agg(F.array_sort(F.collect_list("r")).alias("rows")), f, "page_id long, field string, path string, score double, total double")


def find_fields(bases: list[Node], titles: set[int], s: Strategy) -> tuple[dict[str, str], float]:
    candidates: dict[str, list[Node]] = defaultdict(list)
    for b in bases:
        for n in b.descendants():
            if n.tag != "#text" and n.node_id not in titles and n.own_text().strip() and not any(a.node_id in titles for a in n.ancestors()):
                candidates[relative(n, b)].append(n)
                for c in n.attrs.get("class", "").split():
                    if "'" not in c and "$" not in c:
                        candidates[f".//{n.tag}[contains(@class,'{c}')]"].append(n)
    scores: dict[str, dict[str, float]] = defaultdict(dict)
    views: dict[str, float] = {}
    seen: set[tuple[int, ...]] = set()
    for path, nodes in sorted(candidates.items(), key=lambda x: ("@" not in x[0], len(x[0]), x[0])):
        ids = tuple(n.node_id for n in nodes)
        texts = {n.clean_text() for n in nodes}
        ordinals = {str(i) for i in range(4, len(bases) - 4)}
        # one node for a base; row numbers are no field; equal node sets count once
        if len(nodes) > len(bases) or len(nodes) * 3 < len(bases) or ids in seen or ordinals and ordinals <= texts:
            continue
        seen.add(ids)
        for f, v in field_scores(nodes, len(bases), path.count("/"), "@" in path, s).items():
            scores[f][path] = v
        numbers = [int(x) for n in nodes for x in re.findall(r"\d{1,9}", n.clean_text().replace(",", ""))[:1]]
        views[path] = sum(numbers) / max(1, len(numbers))
    return combination(scores, views, s)


def discover(root: Node, s: Strategy | None = None) -> list[Pattern]:
    """The patterns of a page, best first."""
    s = s or Strategy()
    links = [n for n in root.descendants() if n.tag == "a" and good_href(n.attrs.get("href", "")) and weighted_length(n.clean_text()) > 0]
    short = ShortPaths(root)
    out: dict[tuple[int, ...], Pattern] = {}
    for nodes, level in merged(groups(links, s), s):
        bases = list({b.node_id: b for n in nodes if (b := _ancestor(n, level)) is not None}.values())
        parents = {b.parent.node_id: b.parent for b in bases}
        if len(parents) == 1:
            base_path = f"{short.of(bases[0].parent)}/{bases[0].tag}"
        else:
            base_path = without_ordinals(without_ordinals(bases[0].path(), 1), 1)
        title = relative(nodes[0], _ancestor(nodes[0], level), ordinals=False)
        # as the path selects them, so that a pattern is what it finds
        got = [x for b in select(root, base_path) for x in select(b, title) if x.tag == "a" and good_href(x.attrs.get("href", ""))]
        if len(got) < 2:
            continue
        lengths = [weighted_length(x.clean_text()) for x in got]
        mean = sum(lengths) / len(got)
        p = Pattern(base_path, title, tuple(x.node_id for x in got), len(got), mean)
        p.score = title_score(p.count, mean, "@" in base_path, bool(re.search(r"(?:^|/)h[123](?:\[|/|$)", base_path + "/" + title)), s)
        old = out.get(p.nodes)
        if old is None or (p.base.count("/"), p.base) < (old.base.count("/"), old.base):
            out[p.nodes] = p
    ranked = sorted(out.values(), key=lambda p: (-p.score, -p.count, p.base))
    ranked = [p for p in ranked if p.score >= ranked[0].score * s.share_of_best][: s.keep_patterns]
    for p in ranked:
        p.fields, extra = find_fields(select(root, p.base), set(p.nodes), s)
        p.total = p.score + extra
    return sorted(ranked, key=lambda p: (-p.total, p.base))


_SCHEMA = pa.schema([("page_id", pa.int64()), ("rank", pa.int32()), ("base", pa.string()), ("title", pa.string()), ("items", pa.int32()), ("mean_length", pa.float64()), ("score", pa.float64()), ("total", pa.float64()), ("pattern", pa.string())])


def list_patterns(pages: DataFrame, strategy: Strategy | None = None) -> DataFrame:
    """page_id, rank, base, title, items, mean_length, score, total, pattern:
    the list patterns of each page; ``pattern`` is the JSON that the wrapper
    applies. Stateless: a page at a time, no shuffle. Pages without a list have
    no row."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, p in enumerate(discover(parse(html), strategy)):
                    pattern = json.dumps({"ItemRootXPath": p.base, "TitleXPath": p.title, "UrlXPath": p.title, **p.fields}, ensure_ascii=False)
                    out.append(dict(zip(_SCHEMA.names, (page_id, k + 1, p.base, p.title, p.count, p.mean_length, p.score, p.total, pattern))))
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return mapped(pages.select("page_id", "html"), f, "page_id long, rank int, base string, title string, items int, mean_length double, score double, total double, pattern string")


def crawl_items(pages: DataFrame, strategy: Strategy | None = None) -> DataFrame:
    """Items of each page (page_id, url, html) by its best pattern. The pattern
    is found and applied on the one tree of the page: no shuffle, and pages of
    the same page_id stay apart."""
    from loomtext.operators.wrapper import items_schema, list_items, with_dates

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                root = parse(html)
                for p in discover(root, strategy)[:1]:
                    pattern = {"ItemRootXPath": p.base, "TitleXPath": p.title, "UrlXPath": p.title, **p.fields}
                    out += [dict(zip(items_schema().names, (page_id, *row))) for row in list_items(root, url or "", pattern)]
            yield pa.RecordBatch.from_pylist(out, schema=items_schema())

    return with_dates(mapped(pages.select("page_id", "url", "html"), f, items_schema.ddl))


def forum_patterns(pages: DataFrame, strategy: Strategy | None = None) -> DataFrame:
    """page_id, base, floor, author, date: the paths of the posts of forum pages
    (page_id, html). Pages without two posts have no row."""
    names = {"base": "ItemRootXPath", "floor": "FloorXPath", "author": "AuthorXPath", "date": "DateXPath"}
    schema = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in names)])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [{"page_id": page_id, **{n: p.get(k) for n, k in names.items()}} for page_id, html in zip(*(c.to_pylist() for c in b.columns)) for p in forum_posts(parse(html), strategy)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return mapped(pages.select("page_id", "html"), f, "page_id long, base string, floor string, author string, date string")


def content_paths(pages: DataFrame, site: str = "site", least_text: int = 100) -> DataFrame:
    """site, path, pages, text_length: paths of body text that hold on several
    pages of a site and whose text is not the same on all of them.

    A parent whose paragraphs are most of its text is one candidate on each
    page; candidates are summed by site. Boilerplate, which pages share word
    for word, goes."""
    from pyspark.sql import functions as F

    schema = pa.schema([("site", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("length", pa.int64()), ("text_hash", pa.string())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = []
            for where, page_id, html in zip(*(c.to_pylist() for c in b.columns)):
                root = parse(html)
                short = ShortPaths(root)
                for n in root.descendants():
                    kids = [c for c in n.children if c.tag in ("p", "pre", "#text")]
                    text = "".join("".join(c.inner_text().split()) for c in kids)
                    if n.tag not in ("script", "style", "title", "p", "pre", "a", "span", "b", "strong", "#text", "#document") and len(text) >= least_text:
                        out.append({"site": where, "page_id": page_id, "path": short.of(n), "length": len(text), "text_hash": hashlib.md5(text.encode()).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    each = mapped(pages.select(F.col(site).cast("string"), "page_id", "html"), f, "site string, page_id long, path string, length long, text_hash string")
    g = each.groupBy("site", "path").agg(F.countDistinct("page_id").alias("pages"), F.sum("length").alias("text_length"), F.countDistinct("text_hash").alias("texts"))
    return g.where("pages = 1 or texts > 1").drop("texts")


_FLOOR = re.compile(r"\d+\s*(?:楼|#|层)|沙发|板凳|楼主|(?i:floor|post)\s*#?\d+")


def forum_posts(root: Node, s: Strategy | None = None) -> list[dict[str, str]]:
    """Base, floor, author and date paths of the posts of a forum page.

    Floor marks are texts like "3楼" or "#3"; the bases are the ancestors that
    hold one mark each, at the highest level where they are of one tag under one
    parent. Author paths are those of links, with a bonus for names in "aut";
    date paths those of texts that read as dates, with a bonus for "time"."""
    marks = [n for n in root.descendants() if n.tag not in ("#text", "script", "style", "title") and (t := n.own_text().strip()) and len(t) < 20 and _FLOOR.search(t)]
    if len(marks) < 2:
        return []
    best: list[Node] | None = None
    for level in range(1, (s or Strategy()).climb):
        up = [_ancestor(n, level) for n in marks]
        if any(u is None for u in up) or len({u.node_id for u in up if u}) < len(marks):
            break
        if len({(u.parent.node_id, u.tag) for u in up if u}) == 1:
            best = [u for u in up if u]
    if best is None:
        return []
    short = ShortPaths(root)

    def ranked(test, bonus: str) -> str | None:
        seen: Counter[str] = Counter()
        for b in best:
            for p, n in {relative(n, b): n for n in b.descendants() if n.tag != "#text" and test(n)}.items():
                named = any(bonus in (x.attrs.get("id", "") + x.attrs.get("class", "")).lower() for x in itertools.takewhile(lambda x: x is not b, (n, *n.ancestors())))
                seen[p] += 3 if named else 2
        return max(seen, key=lambda p: (seen[p], -len(p), p)) if seen else None

    out = {"ItemRootXPath": f"{short.of(best[0].parent)}/{best[0].tag}", "FloorXPath": ranked(lambda n: bool(_FLOOR.search(n.own_text())) and len(n.own_text()) < 20, "info")}
    out["AuthorXPath"] = ranked(lambda n: n.tag == "a" and bool(n.clean_text()), "aut")
    out["DateXPath"] = ranked(lambda n: bool(_DATE.search(n.own_text())) and len(n.own_text()) < 100, "time")
    return [{k: v for k, v in out.items() if v}]


def validated(items: DataFrame, least: int = 3) -> DataFrame:
    """page_id, valid: whether the items of a wrapper (page_id, title, url, ..)
    are enough and whole: titles and addresses in nine of ten, and, for the
    fields that it gives at all, dates, media and authors in nine, views in
    four, replies in one of ten."""
    from pyspark.sql import functions as F

    share = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    g = items.groupBy("page_id").agg(F.count("*").alias("n"), *(share(c).alias(c) for c in ("title", "url", "pub_date", "media", "author", "views", "replies")))
    ok = (F.col("n") >= least) & (F.col("title") >= 0.9) & (F.col("url") >= 0.9)
    for c, most in (("pub_date", 0.9), ("media", 0.9), ("author", 0.9), ("views", 0.4), ("replies", 0.1)):
        ok = ok & ((F.col(c) == 0) | (F.col(c) >= most))
    return g.select("page_id", ok.alias("valid"))
