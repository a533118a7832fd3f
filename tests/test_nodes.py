import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.functions import nodes as N
from loomtext.functions import similarity as S
from loomtext.operators import features, frames, items, listing, svm
from loomtext.operators.dom import node_table, parse

PAGE = "<html><body><ul><li id=a><a href=x>1</a><a href=y>2</a></li><li><b>3</b></li></ul><p>4</p></body></html>"


def test_common_lengths(spark):
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choices("abcé", k=rnd.randint(0, 25))) for _ in range(2))
        m = difflib.SequenceMatcher(None, a, b, False).find_longest_match(0, len(a), 0, len(b)).size
        assert S.common_substring(a, b) == m
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        assert S.common_subsequence(a, b) == d[len(a)][len(b)]
    got = S.with_common_lengths(spark.createDataFrame([("abcd", "xbcy"), (None, "a")], "a string, b string"), "a", "b").collect()
    assert [(r.common_substring, r.common_subsequence) for r in got] == [(2, 2), (0, 0)]


def test_node_questions(spark):
    nodes = node_table(spark.createDataFrame([(1, PAGE), (2, "")], "page_id long, html string")).cache()
    by = {r.xpath: r for r in N.subtree_counts(nodes, links=F.col("tag") == "a", texts=F.col("tag") == "#text").collect()}
    assert by["/html[1]"].links == 2 and by["/html[1]"].texts == 4 and by["/html[1]/body[1]/ul[1]/li[2]"].links == 0
    near = {r.xpath: r for r in N.with_neighbours(nodes).collect()}
    a = [near[f"/html[1]/body[1]/ul[1]/li[1]/a[{k}]"] for k in (1, 2)]
    assert a[0].next_id == a[1].node_id and a[1].previous_id == a[0].node_id and a[0].previous_id is None
    h = {r.node_id: [(c.tag, c.n) for c in r.children] for r in N.child_histograms(nodes).collect()}
    assert h[by["/html[1]/body[1]"].node_id] == [("p", 1), ("ul", 1)]
    links = nodes.where("tag = 'a'")
    (m,) = N.majority_ancestor(nodes, links).collect()
    assert m.node_id == by["/html[1]/body[1]/ul[1]/li[1]"].node_id
    assert N.same_nodes(links, links).first().same and not N.same_nodes(links, nodes.where("tag = 'b'")).first().same
    assert [(r.name, r["values"]) for r in N.attribute_values(nodes).where("tag = 'a'").collect()] == [("href", ["x", "y"])]
    assert N.sample_indices(nodes, F.col("node_id"), 3).count() == 3
    f = features.pattern_features(features.link_nodes(nodes)).first()
    assert f.pattern == "/html/body/ul/li/a" and f.features[0] == 2.0 and len(f.features) == len(features.NUMERIC) + len(features.KEYWORDS) + len(features.NAMES)
    s = spark.createDataFrame([(1.0, 50.0, 25.0)], "p double, n double, l double").select(features.title_score(F.col("p"), F.col("n"), F.col("l"))).first()[0]
    assert s == 1500


def test_forum_posts():
    page = "<div id='posts'>" + "".join(f"<div><i class='info'>{k}楼</i><a class='author' href='/u{k}'>user{k}</a><a href='/q'>quote</a><span class='time'>2024-01-0{k} 10:00</span><p>text {k}</p></div>" for k in range(1, 6)) + "</div>"
    assert listing.forum_posts(parse(page)) == [{"ItemRootXPath": "//div[@id='posts']/div", "FloorXPath": "./i", "AuthorXPath": "./a[1]", "DateXPath": "./span"}]
    assert listing.forum_posts(parse("<p>1楼</p>")) == []


def test_validation_kernels_and_splits(spark):
    items = spark.createDataFrame([(1, "t", "u", None, None, None, 1, None)] * 3 + [(2, None, "u", None, None, None, None, None)] * 3, "page_id int, title string, url string, pub_date timestamp, media string, author string, views int, replies int")
    assert {r.page_id: r.valid for r in listing.validated(items).collect()} == {1: True, 2: False}
    x = np.random.default_rng(1).random((5, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<double>")
    k = svm.kernel_matrix(x, x, svm.Parameter(gamma=0.7))
    for most in (10, 1):
        assert all(abs(r.value - k[r.row, r.column]) < 1e-9 for r in svm.kernel_table(df, df, 0.7, most_columns=most).collect())
    a, b = svm.split(df, "id", 0.5)
    assert a.count() + b.count() == 5


def test_field_scores_by_hand():
    import datetime

    s = listing.Strategy(today=datetime.date(2024, 5, 3))
    make = lambda *texts, c="": [parse(f'<b class="{c}">{t}</b>').children[0] for t in texts]
    near, far = make("2024-05-01", "2024-05-02"), make("2021-05-01", "2020-05-02")
    assert listing.date_score(near, 2, 1, False, s.today) > listing.date_score(far, 2, 1, False, s.today) == pytest.approx(0.3)
    assert listing.date_score(near, 2, 2, True, s.today) == pytest.approx(listing.date_score(near, 2, 1, False, s.today) * 0.8 * 1.2)
    assert listing.date_score(near[:1], 4, 1, False, None) == 0 and listing.date_score(near, 4, 1, False, None) == 0.5
    assert listing.nearness(0) == 2 and listing.nearness(1) == 1.5 and listing.nearness(7) == 1 and listing.nearness(181) == 0.3
    assert listing.days_back("3小时前", s.today) == 0.125 and listing.days_back("昨天", s.today) == 1 and listing.days_back("2024-13-40", s.today) is None
    view, reply = listing.counter_scores(make("120", "75"), 1, False, s)
    assert view == 1.5 and reply == pytest.approx(1.2)
    assert listing.counter_scores(make("5", "31"), 1, False, s)[0] == pytest.approx(1.2)
    assert listing.counter_scores(make("120/4", "75/88"), 1, False, s)[0] == 2 and listing.counter_scores(make("5/4", "7/8"), 1, False, s)[0] == pytest.approx(0.8)
    assert listing.counter_scores(make("5月4"), 1, False, s) == (0, 0) and listing.counter_scores(make("1 2 3"), 1, False, s) == (0, 0)
    assert listing.counter_scores(make("12", c="replies"), 1, False, s)[0] == 0
    assert listing.media_score(make("Source: Daily"), s) > listing.media_score(make("Source: Daily 2024-05-01"), s) > 0
    assert listing.author_score(make("by: Ann"), s) > listing.author_score(make("by: Ann, Bob"), s) > 0 == listing.author_score(make("by: Ann", c="rep"), s)


def test_failed_rows_say_why(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "i long, t string")
    got = {r.i: (r.v, r.error) for r in frames.attempted(df, lambda r: {"v": 10 // int(r["t"])}, "v long").collect()}
    assert got[1] == (2, None) and got[2][0] is None and got[2][1].startswith("ValueError") and got[3][1].startswith("TypeError")


def test_fields_across_pages(spark):
    pages = [(i, "s", f"<div class='k'><h1>Title {i}</h1><i>2024-05-{i + 10}</i><p>body {i}</p></div>") for i in range(4)] + [(9, "t", "<p>none</p>")]
    df = spark.createDataFrame(pages, "page_id long, site string, html string")
    nodes, sites = node_table(df), df.select("page_id", "site")
    assert [tuple(r) for r in items.date_paths(nodes, sites).collect()] == [("s", "/div/i", 4, 1.0)]
    wanted = df.select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("wanted"))
    found = items.string_paths(nodes, sites, wanted)
    assert [(r.site, r.path, r.pages) for r in found.collect()] == [("s", "/div/h1", 4)]
    near = items.combined_paths(found, spark.createDataFrame([("s", "/div/p"), ("s", "/x")], "site string, path string")).collect()
    assert [(r.content, r.depth) for r in near] == [("/div/p", 1), ("/x", 0)]
    named = items.nearest_named(nodes.where("page_id = 0"))
    assert named.select("named_id").distinct().count() == 1
    assert items.date_paths(nodes.limit(0), sites).count() == 0


def test_relations_by_a_model_and_their_composition(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.3, (30, 2)) for m in ((0, 0), (2, 0), (0, 2))])
    y = np.repeat([4, 2, 9], 30)
    m = svm.train(x, y, svm.Parameter(gamma=0.5, C=4.0, probability=True))
    rows = spark.createDataFrame([(1, "./a", [0.0, 0.1]), (1, "./b", [2.0, 0.0]), (2, "./c", [0.0, 2.0])], "page_id long, pattern string, features array<double>")
    scores = features.relation_scores(rows, m)
    assert {r.field for r in scores.collect()} == {"DateXPath", "AuthorXPath"}
    got = {(r.page_id, r.field): r.path for r in listing.compositions(scores).collect()}
    assert got == {(1, "DateXPath"): "./a", (1, "AuthorXPath"): "./b"}
    # one path is not two fields
    two = spark.createDataFrame([(1, "./a", "DateXPath", 400.0), (1, "./a", "AuthorXPath", 450.0), (1, "./b", "DateXPath", 300.0)], "page_id long, pattern string, field string, score double")
    assert {(r.field, r.path) for r in listing.compositions(two).collect()} == {("AuthorXPath", "./a"), ("DateXPath", "./b")}
    assert listing.compositions(two.limit(0)).count() == 0


def test_majority_paths_are_those_of_the_ancestors(spark, tmp_path):
    rnd = random.Random(7)
    made = lambda d: "".join(f"<{(g := rnd.choice(['div', 'ul', 'li', 'b']))}>{made(d - 1)}</{g}>" for _ in range(rnd.randint(0, 3))) if d else "t"
    pages = spark.createDataFrame([(i, f"<html><body>{made(5)}</body></html>") for i in range(60)] + [(60, ""), (61, "<li>a</li>"), (62, "<li>a</li><li>b</li>")], "page_id long, html string")
    nodes = node_table(pages, subtree_text=False).cache()
    chosen = nodes.where("tag = 'li'")
    want = N.majority_ancestor(nodes, chosen).join(nodes, ["page_id", "node_id"]).select("page_id", "xpath")
    got = N.majority_paths(chosen)
    assert sorted(map(tuple, got.select("page_id", "xpath").collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    some = node_table(pages, subtree_text=False, tags=["li", "b"])
    key = ["page_id", "node_id", "end_id", "parent_id", "depth", "sib_ord", "tag", "own_text", "xpath"]
    assert sorted(map(tuple, some.select(key).collect())) == sorted(map(tuple, nodes.where("tag in ('li', 'b')").select(key).collect()))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    plan = entry.queries()["list_holders"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
