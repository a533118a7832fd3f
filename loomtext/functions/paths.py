"""Algebra of node paths and URLs as native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import common_prefix_length

NOT_CONTAINERS = ["a", "span", "input", "script", "head", "link", "meta", "title", "style", "br"]


def uses_name(path: Column) -> Column:
    return F.coalesce(path.rlike(r"@id|@class|last\(\)"), F.lit(False))


def level(path: Column) -> Column:
    """Number of steps between the first and the last."""
    p = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("//"), F.lit("/")), r"^[.]+", ""), "^/+|/+$", "")
    return F.coalesce(F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))), F.lit(0))


def without_last_ordinal(path: Column) -> Column:
    return F.regexp_replace(path, r"\[[0-9][^\[]*\]$", "")


def without_ordinals(path: Column) -> Column:
    """Without any ordinal."""
    return F.regexp_replace(path, r"\[[0-9]+\]", "")


def same_steps(a: Column, b: Column) -> Column:
    """Equal but for ordinals."""
    return (a == b) | (without_ordinals(a) == without_ordinals(b))


def of_element(path: Column) -> Column:
    """The path of the element that a text node's path lies in."""
    return F.regexp_replace(path, r"/text\(\)(?:\[[0-9]+\])?$", "")


def parent(path: Column, n: int = 1) -> Column:
    """Without its last n steps."""
    return F.regexp_replace(path, rf"(?:/[^/]*){{{n}}}$", "") if n else path


def last_tag(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\[.*$", "")


def without_ordinal_from_last(path: Column, k: int) -> Column:
    """Without the k-th of its ordinals from the right."""
    return F.regexp_replace(path, rf"\[[0-9]+\]((?:[^\[]*\[[0-9]+\]){{{k - 1}}}[^\[]*)$", "$1")


def common_ancestor(a: Column, b: Column, *, tags_only: bool = False) -> Column:
    """The steps that both paths begin with."""
    x, y = F.split(a, "/"), F.split(b, "/")
    clean = (lambda s: F.regexp_replace(s, r"\[.*$", "")) if tags_only else (lambda s: s)
    n = F.least(F.size(x), F.size(y))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: clean(F.element_at(x, i)) != clean(F.element_at(y, i)))
    return F.array_join(F.slice(x, F.lit(1), F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n)), "/")


def group_ancestor(path: Column) -> Column:
    """Aggregate: the deepest common ancestor of a group of paths."""
    return common_ancestor(F.min(path), F.max(path))


def combined(base: Column, relative: Column) -> Column:
    """``relative`` from ``base`` on, with its ../ steps resolved."""
    steps = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda s: (s != ".") & (s != ""))
    out = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    return F.concat(F.when(F.startswith(base, F.lit("/")), "/").otherwise(""), F.array_join(out, "/"))


def relative(path: Column, to: Column) -> Column:
    """The way from ``to`` to ``path``: ../ up to the common ancestor, then down."""
    base = common_ancestor(path, to)
    depth = lambda p: F.size(F.split(p, "/"))
    up = F.repeat(F.lit("../"), depth(to) - depth(base))
    down = F.array_join(F.slice(F.split(path, "/"), depth(base) + 1, F.greatest(depth(path) - depth(base), F.lit(0))), "/")
    return F.regexp_replace(F.concat(up, down), "/$", "")


def difference(a: Column, b: Column) -> Column:
    """How many characters of ``a`` lie between the common start and end."""
    start = common_prefix_length(a, b)
    end = common_prefix_length(F.reverse(a), F.reverse(b))
    return F.greatest(F.length(a) - start - end, F.lit(0))


def generalised(a: Column, b: Column) -> Column:
    """One path for both: ordinals go from the steps that differ; null where
    more than ordinals differs."""
    x, y = F.split(a, "/"), F.split(b, "/")
    bare = lambda s: F.regexp_replace(s, r"\[[^\]]*\]", "")
    steps = F.zip_with(x, y, lambda p, q: F.when(p == q, p).when(bare(p) == bare(q), bare(p)))
    return F.when((F.size(x) == F.size(y)) & ~F.exists(steps, lambda s: s.isNull()), F.array_join(steps, "/"))


def is_container(tag: Column) -> Column:
    return ~(tag.isin(NOT_CONTAINERS) | F.startswith(tag, F.lit("#")))


def contains_keyword(attribute: Column, words: Sequence[str]) -> Column:
    """Some token of an id or class holds one of the words."""
    tokens = F.split(F.lower(F.coalesce(attribute, F.lit(""))), r"\s+")
    return F.exists(tokens, lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, F.lower(w))))


def keyword_weight(attribute: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the words that a token holds."""
    tokens = F.split(F.lower(F.coalesce(attribute, F.lit(""))), r"\s+")
    out = F.lit(0.0)
    for word, w in weights.items():
        low = F.lit(word.lower())
        out = out + F.when(F.exists(tokens, lambda t: F.contains(t, low)), w).otherwise(0.0)  # noqa: B023
    return out


def good_url(href: Column) -> Column:
    h = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    return (h != "") & ~F.startswith(h, F.lit("#")) & ~h.rlike("^(?:javascript|mailto|tel):")


def absolute_url(href: Column, base: Column, *, case_sensitive: bool = True) -> Column:
    """``href`` resolved against ``base``: absolute, scheme-relative, rooted,
    query-only and relative forms, with ./ and ../ taken out."""
    h = F.trim(F.replace(href, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    own, tail = F.regexp_extract(h, "^([^?#]*)", 1), F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    full = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    steps = F.split(full, "/")
    last = F.element_at(steps, -1)
    kept = F.aggregate(F.filter(steps, lambda s: s != "."), F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(s == "..", acc).otherwise(F.array_append(acc, s)))
    resolved = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    out = (
        F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme, h))
        .when(h == "", base)
        .when(F.startswith(h, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), h))
        .when(own == "", F.concat(root, F.when(path == "", "/").otherwise(path), tail))
        .otherwise(F.concat(root, resolved, tail))
    )
    return out if case_sensitive else F.lower(out)


def url_close(a: Column, b: Column) -> Column:
    """Both on the same host."""
    host = lambda u: F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]*)", 1)
    return host(a) == host(b)
