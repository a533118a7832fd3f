"""Next pages: native column work over the links of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.paths import absolute_url
from loomtext.functions.text import alike

LABEL = "下一页"
#: digits that the address of a page in a row of page numbers has at most
DIGITS = 5
_NUMERALS = "一二三四五六七八九十"
_LINK = r"(?is)<a\b[^>]*?href\s*=\s*[\"']?[^\"'\s>]+[\"']?[^>]*>.*?</a\s*>"


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, idx, text, href: the links of each page, absolute, in order."""
    links = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(f"({_LINK})"), 1)).alias("idx", "a"))
    href = F.regexp_extract("a", r"(?is)href\s*=\s*[\"']?([^\"'\s>]+)", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("a", "(?s)<[^>]*>", ""), r"\s+", " "))
    return links.select("page_id", "url", (F.col("idx") + 1).alias("idx"), text.alias("text"), absolute_url(href, F.col("url")).alias("href"))


def next_links(links: DataFrame, labels: tuple[str, ...] = (LABEL,), digits: int | None = DIGITS) -> DataFrame:
    """page_id, next_url, rule: the next page among links (page_id, idx, text, href).

    Rule 1: the text holds a label; only http addresses count, any other gives
    an empty one. Else, of numbered links whose address has at most ``digits``
    digits (None: any number), the first of two neighbours (rule 2) whose
    addresses are alike without their digits. Pages without either have no row."""
    numbered = links.where(F.col("text").rlike(f"[{_NUMERALS}0-9页]") | _any(F.col("text"), labels))
    has = _any(F.col("text"), labels)
    named = numbered.where(has).groupBy("page_id").agg(F.min_by("href", "idx").alias("href"))
    named = named.select("page_id", F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise("").alias("next_url"), F.lit(1).alias("rule"))
    w = Window.partitionBy("page_id").orderBy("idx")
    few = F.lit(True) if digits is None else F.length(F.regexp_replace("href", f"[^{_NUMERALS}0-9页]", "")) <= digits
    bare = lambda c: F.regexp_replace(c, "[0-9]", "")
    near = numbered.where(few).withColumn("n_idx", F.lead("idx").over(w)).withColumn("n_href", F.lead("href").over(w))
    near = near.where((F.col("n_idx") == F.col("idx") + 1) & alike(bare("href"), bare("n_href")))
    pairs = near.groupBy("page_id").agg(F.min_by("href", "idx").alias("next_url"))
    rest = pairs.join(named.select("page_id"), "page_id", "left_anti").select("page_id", "next_url", F.lit(2).alias("rule"))
    return named.unionByName(rest)


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def next_pages(pages: DataFrame, labels: tuple[str, ...] = (LABEL,), digits: int | None = DIGITS) -> DataFrame:
    """page_id, next_url, rule; none where the next page is the page itself."""
    x = next_links(page_links(pages), labels, digits)
    return x.join(pages.select("page_id", "url"), "page_id").where("next_url <> url").select("page_id", "next_url", "rule")
