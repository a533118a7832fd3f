"""Fields of item pages, found across the pages of a site.

Nodes of many pages meet by their path without ordinals; what a path holds on
how many of a site's pages tells which field it is of. All aggregates, with
partial sums before the shuffle; no page meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.paths import of_element, without_ordinals

DATE = r"[0-9]{4}\s*[-/.年]\s*[0-9]{1,2}\s*[-/.月]\s*[0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]+\s*(?:分钟|小时|天)前"
LONGEST_DATE = 60


def _shares(nodes: DataFrame, sites: DataFrame, holds: Column, least: float) -> DataFrame:
    """site, path, pages, share: paths that hold something on at least ``least``
    of the site's pages (columns page_id, site)."""
    path = without_ordinals(of_element(F.col("xpath")))
    found = nodes.where(holds).select("page_id", path.alias("path")).distinct()
    total = sites.groupBy("site").agg(F.count_distinct("page_id").alias("total"))
    n = found.join(sites.select("page_id", "site").distinct(), "page_id").groupBy("site", "path").agg(F.count("*").alias("pages"))
    return n.join(total, "site").select("site", "path", "pages", (F.col("pages") / F.col("total")).alias("share")).where(F.col("share") >= least)


def date_paths(nodes: DataFrame, sites: DataFrame, least: float = 0.5) -> DataFrame:
    """Paths of text that reads as a date and is little more."""
    text = F.trim("text")
    return _shares(nodes, sites, (F.col("tag") == "#text") & (F.length(text) <= LONGEST_DATE) & text.rlike(DATE), least)


def string_paths(nodes: DataFrame, sites: DataFrame, wanted: DataFrame, least: float = 0.5) -> DataFrame:
    """Paths of the text that is ``wanted`` of a page (page_id, wanted), such as
    a title known from a list. Blanks around it don't count."""
    w = wanted.select("page_id", F.trim("wanted").alias("__wanted")).where("__wanted <> ''").distinct()
    x = nodes.where("tag = '#text'").withColumn("__text", F.trim("text"))
    x = x.join(w, (x["page_id"] == w["page_id"]) & (x["__text"] == w["__wanted"]), "left_semi")
    return _shares(x, sites, F.lit(True), least)


def combined_paths(fields: DataFrame, contents: DataFrame) -> DataFrame:
    """site, path, content, depth: for each content path (site, path) the field
    paths of the same site by how many steps they share with it, most first: a
    date or an author stands near the content it belongs to."""
    c = contents.select("site", F.col("path").alias("content"))
    x = fields.select("site", "path").join(c, "site")
    p, q = F.split("path", "/"), F.split("content", "/")
    n = F.least(F.size(p), F.size(q))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(p, i) != F.element_at(q, i))
    return x.withColumn("depth", F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n) - 1).orderBy("site", F.desc("depth"), "path")


def nearest_named(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, named_id: each node's nearest ancestor with an id or a class."""
    named = nodes.where("attrs['id'] is not null or attrs['class'] is not null").select(F.col("page_id").alias("__page"), F.col("node_id").alias("named_id"), F.col("end_id").alias("__end"))
    x = nodes.join(named, (F.col("page_id") == F.col("__page")) & (F.col("node_id") > F.col("named_id")) & (F.col("node_id") <= F.col("__end")))
    return x.groupBy("page_id", "node_id").agg(F.max("named_id").alias("named_id"))
