"""Feature vectors of link and field patterns, for the SVM scores.

The nodes of a pattern are one group of a table (page_id, pattern, text, href,
names, depth); all features are aggregates, computed in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import weighted_length
from loomtext.operators.svm import Model, scored

NUMERIC = ("count", "mean_length", "length_spread", "digit_share", "date_share", "mark_share", "distinct_share", "link_share", "mean_depth")
KEYWORDS = ("来源", "作者", "编辑", "回复", "评论", "查看", "点击", "阅读", "发表", "昨天", "分钟", "小时", "更多", "下一页", "reply", "view", "author", "posted", "comment", "source")
NAMES = ("title", "list", "item", "news", "date", "time", "author", "user", "view", "reply", "source", "nav", "menu", "foot", "head", "ad")
_DATE = r"[0-9]{2,4}[-/年.][0-9]{1,2}|[0-9]{1,2}:[0-9]{2}|前天|昨天|[0-9]+\s*(?:分钟|小时|天)前"


def pattern_features(nodes: DataFrame, keys: Sequence[str] = ("page_id", "pattern"), keywords: Sequence[str] = KEYWORDS, names: Sequence[str] = NAMES) -> DataFrame:
    """The keys and ``features``: numbers in NUMERIC's order, the share of texts
    with each keyword, the share of nodes whose ids or classes hold each name."""
    t, n = F.coalesce(F.col("text"), F.lit("")), F.greatest(F.length("text"), F.lit(1))
    length = weighted_length(F.col("text"))
    numeric = [
        F.count("*").cast("double"), F.avg(length), F.coalesce(F.stddev_samp(length), F.lit(0.0)), F.avg(F.regexp_count(t, F.lit("[0-9]")) / n),
        F.avg(t.rlike(_DATE).cast("int")), F.avg(F.regexp_count(t, F.lit(r"\p{P}")) / n), F.count_distinct("text") / F.count("*"), F.avg((F.coalesce(F.col("href"), F.lit("")) != "").cast("int")), F.avg("depth"),
    ]
    words = [F.avg(F.contains(F.lower(t), F.lit(w)).cast("int")) for w in keywords]
    named = [F.avg(F.contains(F.lower(F.coalesce(F.col("names"), F.lit(""))), F.lit(w)).cast("int")) for w in names]
    return nodes.groupBy(*keys).agg(F.array(*(F.coalesce(c, F.lit(0.0)).cast("double") for c in (*numeric, *words, *named))).alias("features"))


def masked(features: Column, keep: Sequence[int]) -> Column:
    """The places of a vector that a mask keeps."""
    return F.array(*(F.element_at(features, i + 1) for i in keep))


def title_score(probability: Column, count: Column, length: Column, best_count: int = 50, best_length: int = 25) -> Column:
    """1000 for the title class, 500 more, less what count and length are off."""
    near = F.abs(F.ln(F.greatest(length, F.lit(0.1))) - math.log(best_length)) * 200
    off = F.when(F.abs(length - best_length) > 5, near - 20 * (length - best_length)).otherwise(near)
    return 1000 * probability + 500 - off - 200 * F.abs(F.ln(F.greatest(count, F.lit(1))) - math.log(best_count))


def link_nodes(node_table: DataFrame) -> DataFrame:
    """page_id, pattern, text, href, names, depth: links by their paths without ordinals."""
    x = node_table.where("tag = 'a' and attrs['href'] is not null")
    names = F.concat_ws(" ", F.col("attrs")["id"], F.col("attrs")["class"])
    return x.select("page_id", F.regexp_replace("xpath", r"\[[0-9]+\]", "").alias("pattern"), F.trim("text").alias("text"), F.col("attrs")["href"].alias("href"), names.alias("names"), "depth")


#: what the classes of a relation model stand for
RELATIONS = {2: "AuthorXPath", 3: "AbsTractXPath", 4: "DateXPath", 5: "MediaNameXPath", 6: "ViewXPath"}


def relation_scores(rows: DataFrame, model: Model, relations: dict[int, str] | None = None, keys: Sequence[str] = ("page_id", "pattern")) -> DataFrame:
    """The keys, field and score of rows with ``features``: 500 times the
    probability of each class of a model trained with probabilities. Classes
    that stand for no field have no row."""
    names = relations or RELATIONS
    x = scored(rows.select(*keys, "features"), model, probability=True)
    pairs = F.array(*(F.struct(F.lit(names[k]).alias("field"), (F.element_at("probability", i + 1) * 500).alias("score")) for i, k in enumerate(model.labels) if k in names))
    return x.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.field", "x.score")
