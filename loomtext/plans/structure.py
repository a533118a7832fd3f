"""Queries of the page operators, the SVM surface, evaluation, reflow and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import nodes as N
from loomtext.functions import paths as P
from loomtext.functions import text as T
from loomtext.operators import article, evaluate, features, formatter, listing, pairs, paging, reflow, svm, wrapper
from loomtext.operators.charset import detected
from loomtext.operators.dom import node_table
from loomtext.plans.queries import ORACLE, QUERIES, host_search, query, table
from loomtext.sources.tables import table_text
from loomtext.streaming.pages import counter_series

__all__ = ["ORACLE", "QUERIES"]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query(ORACLE["tag_histogram"])
def dom_tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the parsed trees by tag."""
    return node_table(_pages(spark, sf_dir), subtree_text=False).where("tag <> '#text'").groupBy("tag").agg(F.count("*").alias("n"))


@query()
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_table(_pages(spark, sf_dir))


@query(r"SELECT page_id, round(length(regexp_replace(html, '(?s)<[^>]*>', '', 'g')) / length(html), 9) AS density FROM pages")
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.round(F.length(F.regexp_replace("html", "(?s)<[^>]*>", "")) / F.length("html"), 9).alias("density"))


@query()
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only div blocks are scored."""
    return article.extract_articles(_pages(spark, sf_dir))


@query()
def articles_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All block tags are scored, the body formatted for publishing."""
    return article.extract_articles(_pages(spark, sf_dir), tags=article.BLOCK_TAGS, format=True)


@query()
def formatted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatter.format_pages(_pages(spark, sf_dir).select("page_id", "url", "html")).select("page_id", "formatted")


@query()
def list_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_patterns(_pages(spark, sf_dir))


_NAV = r"""'<li><a href=\"([^\"]*)\">([^<]*)</a></li>'""".replace('\\"', '"')


@query(
    rf"SELECT page_id, CAST(i - 1 AS INT) AS item_no, regexp_extract(a, {_NAV}, 2) AS title, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(a, {_NAV}, 1) AS url"
    rf" FROM (SELECT page_id, url, generate_subscripts(l, 1) AS i, unnest(l) AS a FROM (SELECT page_id, url, regexp_extract_all(html, {_NAV}) AS l FROM pages))"
)
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by a path wrapper; the addresses' host is the page's."""
    pattern = '{"ItemRootXPath": "//ul/li", "TitleXPath": "./a", "UrlXPath": "./a"}'
    return wrapper.parse_lists(_pages(spark, sf_dir).withColumn("pattern", F.lit(pattern))).select("page_id", "item_no", "title", "url")


@query()
def discovered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.crawl_items(_pages(spark, sf_dir))


@query(
    rf"SELECT page_id, CAST(i - 1 AS INT) AS match_no, trim(regexp_extract(a, {_NAV}, 2)) AS title FROM"
    rf" (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS a FROM (SELECT page_id, regexp_extract_all(html, {_NAV}) AS l FROM pages))"
)
def regex_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by a regular expression with named groups."""
    pattern = '<li><a href="(?<Url>[^"]*)">(?<Title>[^<]*)</a></li>'
    return wrapper.regex_rows(_pages(spark, sf_dir).withColumn("pattern", F.lit(pattern))).select("page_id", "match_no", "title")


@query()
def item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = '{"ItemTitleXPath": "//h1", "ItemContentXPath": "//article"}'
    return wrapper.parse_items(_pages(spark, sf_dir).withColumn("pattern", F.lit(pattern))).select("page_id", "title", "content")


@query()
def content_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).withColumn("site", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return listing.content_paths(p)


@query()
def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.next_pages(_pages(spark, sf_dir))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '[^\\x{00}-\\x{7F}]') THEN 'UTF-8' ELSE 'ASCII' END AS charset FROM pages")
def charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detector says of pages' bytes."""
    b = _pages(spark, sf_dir).select("page_id", F.encode("html", "UTF-8").alias("body"))
    return detected(b).select("page_id", "charset")


_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(rf"SELECT page_id, regexp_replace(p, '(/[^/]*)$', '') AS parent, regexp_replace(string_split(p, '/')[-1], '\[.*$', '') AS last, CAST(length(trim(p, '/')) - length(replace(trim(p, '/'), '/', '')) AS INT) AS level FROM (SELECT page_id, {_PATH} AS p FROM pages)")
def path_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    x = _pages(spark, sf_dir).select("page_id", p.alias("p"))
    return x.select("page_id", P.parent(F.col("p")).alias("parent"), P.last_tag(F.col("p")).alias("last"), P.level(F.col("p")).alias("level"))


@query("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


_SCORED = "SELECT CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS pos FROM documents d JOIN labels l USING (doc_id)"
_STEPS = f"""WITH s AS ({_SCORED}), g AS (SELECT score, sum(pos) AS p, count(*) AS n FROM s GROUP BY score),
c AS (SELECT score, p, sum(p) OVER w AS tp, sum(n) OVER w - sum(p) OVER w AS fp, sum(p) OVER () AS positives, sum(n) OVER () - sum(p) OVER () AS negatives FROM g WINDOW w AS (ORDER BY score DESC))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("toxic").alias("positive"))


@query(f"{_STEPS} SELECT score, round(tp / (tp + fp), 9) AS precision, round(tp / positives, 9) AS recall FROM c WHERE p > 0")
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pr_curve(_scored(spark, sf_dir)).select("score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"{_STEPS} SELECT score, round(tp / positives, 9) AS tpr, round(fp / negatives, 9) AS fpr FROM c")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_curve(_scored(spark, sf_dir)).select("score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(f"{_STEPS} SELECT round(sum(p * tp / (tp + fp)) / max(positives), 9) AS average_precision FROM c")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(_scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(f"{_STEPS}, q AS (SELECT *, tp - p AS pt, coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS pf FROM c) SELECT round(sum((fp - pf) * (tp + pt) / 2) / (max(positives) * max(negatives)), 9) AS auc FROM q")
def roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auc(_scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


_EACH = "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query(f"{_EACH}, m AS (SELECT i, min(v) AS lo, max(v) AS hi FROM e GROUP BY i) SELECT vec_id, CAST(i AS INT) AS i, round(CASE WHEN hi <> lo THEN -1 + (v - lo) * 2 / (hi - lo) ELSE 0 END, 6) AS value FROM e JOIN m USING (i)")
def min_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    z = svm.ranged(F.col("x"), svm.range_transform(e, "x"))
    return e.select("vec_id", F.posexplode(z).alias("i", "value")).select("vec_id", (F.col("i") + 1).alias("i"), F.round("value", 6).alias("value"))


@query(f"{_EACH}, m AS (SELECT i, avg(v) AS a, stddev_samp(v) AS s FROM e GROUP BY i) SELECT vec_id, CAST(i AS INT) AS i, round((v - a) / s, 6) AS value FROM e JOIN m USING (i)")
def gaussian_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    z = svm.standardised(F.col("x"), svm.gaussian_transform(e, "x"))
    return e.select("vec_id", F.posexplode(z).alias("i", "value")).select("vec_id", (F.col("i") + 1).alias("i"), F.round("value", 6).alias("value"))


@query(f"{_EACH}, l AS (SELECT e.*, label FROM e JOIN embeddings USING (vec_id)), c AS (SELECT label, i, avg(v) AS m FROM l GROUP BY label, i) SELECT vec_id, c.label, round(exp(-0.5 * sum((v - m) * (v - m))), 6) AS value FROM e JOIN c USING (i) GROUP BY vec_id, c.label")
def rbf_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's kernel value with the mean vector of each label: one row for
    each label is broadcast."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    mean = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return e.select("vec_id", "x").crossJoin(mean).select("vec_id", "label", F.round(svm.rbf(F.col("x"), F.col("m"), 0.5), 6).alias("value"))


#: rows that ``svm_labels`` is trained on, about: a hash draws each by itself
SVM_TRAIN_ROWS = 300


@query()
def svm_labels(spark: SparkSession, sf_dir: str, train_rows: int = SVM_TRAIN_ROWS) -> DataFrame:
    """Embeddings scored by a machine trained on about ``train_rows`` of them."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    n = e.count()
    part = int(min(1.0, train_rows / max(n, 1)) * (1 << 30))
    rows = e.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < part).orderBy("vec_id").collect()
    m = svm.train(np.array([r.features for r in rows]), np.array([r.label for r in rows]), svm.Parameter(gamma=0.5, C=4.0))
    return svm.scored(e, m).select("vec_id", "label", "prediction")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = counter_series(table(spark, sf_dir, "events"))
    return x.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("value", 4).alias("value"))


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


_CONVERSATIONS = "(SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations)"
_HEADED = "(SELECT conv_id AS doc_id, turn AS page_no, 'Report ' || conv_id || chr(10) || text || chr(10) || '- end of page' || chr(10) || turn AS text FROM conversations)"


def _running(pages: str) -> str:
    """SQL: headers and footers of pages."""
    return rf"""SELECT doc_id, bare, place, count(*) AS n FROM (SELECT doc_id, bare, 'top' AS place FROM (SELECT doc_id, bare, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i) AS a FROM ({_lines(pages)}) WHERE bare <> '' AND NOT regexp_matches(bare, '^[0-9]{{1,9}}$')) WHERE a <= 3
UNION ALL SELECT doc_id, bare, 'end' AS place FROM (SELECT doc_id, bare, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i DESC) AS z FROM ({_lines(pages)}) WHERE bare <> '' AND NOT regexp_matches(bare, '^[0-9]{{1,9}}$')) WHERE z <= 3)
JOIN (SELECT doc_id, count(*) AS pages FROM {pages} GROUP BY 1) USING (doc_id) GROUP BY doc_id, bare, place, pages HAVING count(*) > 2 AND count(*) >= pages - 2"""


def _lines(pages: str) -> str:
    return rf"SELECT doc_id, page_no, i, line, regexp_replace(line, '[\s\x{{3000}}]', '', 'g') AS bare FROM (SELECT doc_id, page_no, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT doc_id, page_no, string_split_regex(text, '\r?\n') AS p FROM {pages}))"


def _flow(pages: str) -> str:
    """SQL: pages as running text."""
    return rf"""WITH r AS MATERIALIZED ({_running(pages)}),
t AS (SELECT *, sum(CAST(NOT number AS INT)) OVER (PARTITION BY doc_id, page_no ORDER BY i) AS top, sum(CAST(NOT number AS INT)) OVER (PARTITION BY doc_id, page_no ORDER BY i DESC) AS tail FROM (SELECT *, regexp_matches(bare, '^[0-9]{{1,9}}$') AS number FROM ({_lines(pages)}) WHERE bare <> '')),
b AS (SELECT t.* FROM t LEFT JOIN (SELECT doc_id, bare, true AS f FROM r WHERE place = 'top') u ON u.doc_id = t.doc_id AND u.bare = t.bare LEFT JOIN (SELECT doc_id, bare, true AS f FROM r WHERE place = 'end') v ON v.doc_id = t.doc_id AND v.bare = t.bare
WHERE NOT ((u.f IS NOT NULL AND top <= 3) OR (v.f IS NOT NULL AND tail <= 3) OR (number AND (top < 3 OR tail < 3)) OR upper(t.bare) IN ('目录', 'MENU', 'CONTENTS') OR regexp_matches(t.bare, '\.{{6,}}\s*[0-9]+'))),
c AS (SELECT b.*, regexp_matches(line, '{reflow.CLOSING}') AS closes, regexp_matches(line, '^(?:[◆■•（]|[-*] )') OR (NOT regexp_matches(line, '{reflow.CLOSING}') AND NOT regexp_matches(line, '{reflow.INNER}') AND length(bare) < mean) AS alone
FROM b JOIN (SELECT doc_id, least(floor(avg(length(bare))), 30) AS mean FROM b GROUP BY doc_id) USING (doc_id)),
o AS (SELECT *, coalesce(lag(closes OR alone) OVER (PARTITION BY doc_id ORDER BY page_no, i), true) OR alone AS opens FROM c),
p AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY page_no, i ROWS UNBOUNDED PRECEDING) AS part FROM o)
SELECT doc_id, string_agg(text, chr(10) ORDER BY part) AS text FROM (SELECT doc_id, part, string_agg(rtrim(line, ' '), ' ' ORDER BY page_no, i) AS text FROM p GROUP BY doc_id, part) GROUP BY doc_id"""


@query(_running(_CONVERSATIONS))
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and footers, turns of a conversation taken as pages."""
    return reflow.running_lines(_doc_pages(spark, sf_dir))


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages with a header, a footer and a number each."""
    text = F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n- end of page\n"), F.col("page_no").cast("string"))
    return _doc_pages(spark, sf_dir).withColumn("text", text)


@query(_running(_HEADED))
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflow.running_lines(_headed(spark, sf_dir))


@query(_flow(_HEADED))
def reflowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflow.reflowed(_headed(spark, sf_dir))


@query(_flow(_CONVERSATIONS))
def reflowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflow.reflowed(_doc_pages(spark, sf_dir))


@query("SELECT r_regionkey || ',' || r_name AS value FROM region")
def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_text(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "csv")


@query("SELECT page_id, CAST(sum(n) AS BIGINT) AS links FROM (SELECT page_id, len(regexp_extract_all(html, '<a ')) AS n FROM pages) GROUP BY page_id")
def subtree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links below the root element, by running sums over the node table."""
    x = N.subtree_counts(node_table(_pages(spark, sf_dir), subtree_text=False), links=F.col("tag") == "a")
    return x.where("tag = 'html'").select("page_id", "links")


@query()
def same_tag_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_neighbours(node_table(_pages(spark, sf_dir), subtree_text=False)).select("page_id", "node_id", "previous_id", "next_id")


@query()
def child_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.child_histograms(node_table(_pages(spark, sf_dir), subtree_text=False))


@query()
def link_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pattern_features(features.link_nodes(node_table(_pages(spark, sf_dir))))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*</a></li>')) >= 3 AS valid FROM pages WHERE len(regexp_extract_all(html, '<li><a href=\"[^\"]*\">[^<]*</a></li>')) > 1")
def valid_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.validated(listing.crawl_items(_pages(spark, sf_dir)))


@query()
def common_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common substring and subsequence of the addresses of a host: of
    those whose page_id is divisible by 20 with all others."""
    values = lambda x: [x.common_substring(), x.common_subsequence()]
    return pairs.text_search(*host_search(spark, sf_dir), values, "common_substring int, common_subsequence int")


@query(rf"""SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>|&[a-z#0-9]{{2,8}};', '', 'g'), '{T.SPACE}', '', 'g') AS text FROM pages""")
def bare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", T.strip_annotations(F.col("html")).alias("text"))
