import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.functions.markup import decoded
from loomtext.operators import article, charset, evaluate, listing, paging, reflow, wrapper
from loomtext.operators.dom import node_table, parse
from loomtext.operators.formatter import format_html
from loomtext.operators.xpath import ShortPaths, class_and_id_path, random_id, select, sequence_stem

LIST = "<div id='n12'><ul class='news top'>" + "".join(
    f"<li><h3><a href='/n/{i}.html'>A headline that is long enough, about thing {i}</a></h3><span class='date'>2024-01-{i + 10} 10:0{i % 10}</span><b class='src'>来源：晨报 x</b><em class='view'>{i * 100 + 50}</em><i class='reply'>{i * 3 + 40}</i></li>" for i in range(12)
) + "</ul><a href='mailto:x'>m</a></div>"


def test_tree_rules():
    r = parse("<div>a<p>b<p>c<br>d</div>e<li>x<li>y</ul><script>if(a<b)'</p>'</script><b>open")
    assert [c.tag for c in r.children] == ["div", "#text", "li", "li"]
    div = r.children[0]
    assert [c.tag for c in div.children] == ["#text", "p", "p"] and div.inner_text() == "abcd"
    assert r.children[-1].inner_text() == "yif(a<b)'</p>'open"
    assert div.children[2].path() == "/div[1]/p[2]" and div.end_id == div.children[2].children[-1].node_id
    assert parse(None).children == [] and parse("a < b").inner_text() == "a < b"


def test_node_table(spark):
    rows = {r.xpath: r for r in node_table(spark.createDataFrame([(1, "<p id=x>a<a href='y'>b<i>c</i></a></p>")], "page_id long, html string")).collect()}
    assert rows["/p[1]"].attrs == {"id": "x"} and rows["/p[1]"].own_text == "a" and rows["/p[1]/a[1]"].own_text == "b c" and rows["/p[1]"].text == "abc"


def test_paths():
    r = parse("<div id='a'><p class='x y'>1</p><p>2</p><p id='q'>3</p></div><div><p>4</p></div>")
    text = lambda p: [n.inner_text() for n in select(r, p)]
    assert text("//p") == ["1", "2", "3", "4"] and text("/div[1]/p[2]") == ["2"] and text("//div[@id='a']/p[last()]") == ["3"]
    assert text("//p[contains(@class,'y')]") == ["1"] and text("//p[not(@class)]") == ["2", "3", "4"] and text("//p[@id]/..") == ["123"]
    assert text("//div/p[last()>=2][1]") == ["1"] and text("//p/text()") == ["1", "2", "3", "4"] and text(".//*[@id=q]") == ["3"]
    assert select(r.children[0], "./p[3]")[0].attrs["id"] == "q"
    s = ShortPaths(r)
    for n in r.descendants():
        assert select(r, s.of(n)) == [n]
    assert s.of(select(r, "//p[@id]")[0]) == "//p[@id='q']" and class_and_id_path(select(r, "//p")[0]) == "/div[@id='a']/p[@class='x y']"
    many = parse("".join(f"<p id='post{i}'>x</p>" for i in range(100, 112)) + "".join(f"<i id='{i}abcdefgh'>x</i>" for i in range(10)))
    assert sequence_stem(many.children[0], many) == "post" and random_id(many.children[-1]) and not random_id(many.children[0])
    with pytest.raises(ValueError, match="not supported"):
        select(r, "//p[position()>1]")


def test_block_scores_by_hand():
    # 30 characters, no links: 15 + 30 / 40
    (b,) = article.block_scores(parse("<div>" + "x" * 30 + "</div>"))
    assert b[0] == pytest.approx(15.75)
    # short: 2 for each character that 25 lack
    (b,) = article.block_scores(parse("<div>" + "x" * 20 + "</div>"))
    assert b[0] == pytest.approx(15 + 0.5 - 10)
    # paragraphs stand for the block: 15 + 80 // 40 + 1, less 2 for the linked one
    (b,) = article.block_scores(parse("<div><p>" + "x" * 40 + "</p><p>" + "y" * 38 + "<a>zz</a></p></div>"))
    assert b[0] == pytest.approx(15 + 2 + 1 - 2)
    # all link: less 100
    (b,) = article.block_scores(parse("<div><p><a>" + "x" * 40 + "</a></p></div>"))
    assert b[0] == pytest.approx(15 + 1 + 0 - 2 - 100)
    # blank lines and a stop phrase
    (b,) = article.block_scores(parse("<div>" + "x" * 40 + "\n\n\n\n\n" + "Copyright</div>"))
    assert b[0] == pytest.approx(15 + 49 / 40 - 1 - 0.2 - 5)


def test_articles(spark):
    body = "".join(f"<p>{'word ' * 30}</p>" for _ in range(4))
    page = f"<title>Big News - Site</title><h1>Big  News</h1><script>x</script><div class='ad'>buy</div><div>发布于 2024年3月5日 10:30</div><div id='c'>{body}<img src='/a.png?x=1'></div>"
    rows = [(1, "http://s.com/d/p", page), (2, "u", None), (3, "u", "<p>2 hours</p>")]
    got = {r.page_id: r for r in article.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string"), format=True).collect()}
    assert got[1].title == "BigNews" and got[1].pub_date == dt.datetime(2024, 3, 5, 10, 30) and got[1].content.startswith("word word") and 'src="http://s.com/a.png?x=1"' in got[1].html_content
    assert got[2].score is None and got[2].title == "" and got[3].date_text == "2hours"


@pytest.mark.parametrize(("text", "want"), [("2024-1-5", "2024-01-05 00:00"), ("24/01/05 07:08", "2024-01-05 07:08"), ("2024年1月5日 7:08", "2024-01-05 07:08"), ("3小时前", "2024-06-01 09:00"), ("昨天", "2024-05-31 12:00"), ("5 分钟前", "2024-06-01 11:55"), ("2024-13-45", None), ("x", None), (None, None)])
def test_dates(spark, text, want):
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    got = spark.createDataFrame([(text,)], "c string").select(F.date_format(article.parse_date(F.col("c"), now), "yyyy-MM-dd HH:mm")).first()[0]
    assert got == want


def test_formatter():
    html = """<p></p><p>　 a <img src='x.gif' data-src='/b/c.png?q=1' data-code="1" style=""></p><p><img src="/share_logo.png"></p><a href="javascript:x()" onclick="y">k</a><iframe src="//v.com/1" onload="z"></iframe><b onclick="q">t（ ）</b><script>s</script>"""
    out = format_html(html, "http://h.com/d/e")
    assert out == '<p>a <img src="http://h.com/b/c.png?q=1" alt=""></p>k<iframe src="http://v.com/1"></iframe><b>t</b>'
    assert format_html(None) is None and format_html("") == ""


def test_discovery_finds_items_and_fields():
    best = listing.discover(parse(LIST))[0]
    assert best.count == 12 and best.fields["DateXPath"] == ".//span[contains(@class,'date')]" and best.fields["ViewXPath"] == ".//em[contains(@class,'view')]"
    assert best.fields["ReplyXPath"] == ".//i[contains(@class,'reply')]" and best.fields["MediaNameXPath"] == ".//b[contains(@class,'src')]"
    assert listing.discover(parse("<p>no links</p>")) == [] and listing.discover(parse("")) == []
    assert listing.valid_title("one two three four five six") and not listing.valid_title("123 4", "Chinese")


def test_wrappers(spark):
    df = spark.createDataFrame([(1, "http://s.com/l/", LIST), (2, "u", None)], "page_id long, url string, html string")
    got = listing.crawl_items(df).orderBy("item_no").collect()
    assert len(got) == 12 and got[3].url == "http://s.com/n/3.html" and got[3].media == "晨报" and got[3].views == 350 and got[3].replies == 49 and got[3].pub_date == dt.datetime(2024, 1, 13, 10, 3)
    one = json.dumps({"ItemRootXPath": "//li", "TitleXPath": ".//a", "ViewXPath": "./em", "ReplyXPath": "./em"})
    page = "<ul><li><a href='a.pdf'>t</a></li><li><a href='x@y'>t</a></li><li><a href='b'>t</a><em>3/1,200</em></li></ul>"
    rows = wrapper.parse_lists(spark.createDataFrame([(1, "http://s.com/", page, one), (2, "u", page, "{broken"), (3, "u", page, None)], "page_id long, url string, html string, pattern string")).collect()
    assert [(r.url, r.views, r.replies) for r in rows] == [("http://s.com/b", 1200, 3)]
    pat = r'<a href="(?<Url>[^"]*)">(?<Title>.*?)</a>(?: (?<View>[\d,]+))?'
    html = '<a href="/1">one</a> 1,234<a href="/2"> two </a>'
    got = wrapper.regex_rows(spark.createDataFrame([(1, "http://s.com/", html, pat)], "page_id long, url string, html string, pattern string")).collect()
    assert [(r.url, r.title, r.views) for r in got] == [("http://s.com/1", "one", 1234), ("http://s.com/2", "two", 0)]
    assert wrapper.segment("x 来源：报社 y", wrapper.MEDIA) == "报社" and wrapper.clean_author("作者：李 时间 3") == "李" and wrapper.clean_editor("a（责任编辑：x）b") == "ab" and wrapper.clean_links("a<a href=x>返回首页</a>b") == "ab"
    item = json.dumps({"ItemTitleXPath": "//h1", "ItemDateXPath": "//i", "ItemContentXPath": "//div[@id='c']"})
    i = wrapper.parse_items(spark.createDataFrame([(1, "u", "<h1>T</h1><i>2024-05-06 07:08</i><div id='c'><p>b</p></div>", item)], "page_id long, url string, html string, pattern string"))
    listed = spark.createDataFrame([(1, None, None, None, None, None, None)], "page_id long, title string, media string, author string, pub_date timestamp, views int, replies int")
    m = wrapper.merged_items(listed, i, F.lit("2024-06-01").cast("timestamp")).first()
    assert (m.title, m.content, m.pub_date) == ("T", "b", dt.datetime(2024, 5, 6, 7, 8))


@pytest.mark.parametrize(("listed", "item", "want"), [(None, "2024-05-01 00:00", "item"), ("2024-05-02 00:00", "2024-05-01 08:00", "item"), ("2024-05-02 09:00", "2024-05-01 08:00", "listed"), ("2024-06-01 11:59", "2024-05-31 08:00", "item"), ("2024-06-01 11:59", "1999-05-31 08:00", "listed")])
def test_date_precedence(spark, listed, item, want):
    df = spark.createDataFrame([(listed, item)], "l string, i string").select(F.col("l").cast("timestamp").alias("l"), F.col("i").cast("timestamp").alias("i"))
    r = df.select("l", "i", wrapper.better_date(F.col("l"), F.col("i"), F.lit("2024-06-01 12:00").cast("timestamp")).alias("g")).first()
    assert r.g == (r.i if want == "item" else r.l)


def test_next_pages(spark):
    a = "<a href='/p/1'>1</a><a href='/p/2'>2</a><a href='/about'>About</a>"
    rows = [(1, "http://s.com/p/0", a), (2, "http://s.com/p/0", a + "<a href='/p/9'>下一页</a>"), (3, "http://s.com/p/0", "<a href='javascript:go()'>下一页</a>"), (4, "http://s.com/p/1", a), (5, "http://s.com/", "<a href='/x1'>1</a><a href='/completely/other/way2'>2</a>"), (6, "u", None)]
    got = {r.page_id: (r.next_url, r.rule) for r in paging.next_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("http://s.com/p/1", 2), 2: ("http://s.com/p/9", 1), 3: ("", 1)}


def test_content_paths(spark):
    page = lambda k: f"<div id='nav'>{'same menu ' * 20}</div><div id='body'><p>{('text ' + str(k) + ' ') * 40}</p></div>"
    df = spark.createDataFrame([(k, "s", page(k)) for k in range(3)], "page_id long, site string, html string")
    assert [(r.path, r.pages) for r in listing.content_paths(df).collect()] == [("//div[@id='body']", 3)]


TEXTS = {
    "GB2312": "这是一个用来测试的中文句子，我们在这里写了很多的字。", "Big5": "這是一個用來測試的中文句子，我們在這裡寫了很多的字。", "EUC-JP": "これは文字コードを調べるための日本語の文です。",
    "Shift_JIS": "これは文字コードを調べるための日本語の文です。", "EUC-KR": "이것은 문자 집합을 시험하기 위한 한국어 문장입니다.", "UTF-8": "这是 été に", "ISO-2022-JP": "日本語の文", "windows-1252": "Un café à côté de la forêt où naît l’été, déjà",
}


@pytest.mark.parametrize("name", TEXTS)
def test_charsets(name):
    data = TEXTS[name].encode(charset.CODECS[name])
    assert charset.detect(data) == name
    assert charset.detect(b"plain") == "ASCII" and charset.detect(None) is None and charset.detect(b"\xff\xfea\x00") == "UTF-16LE"


def test_decoding_and_vote(spark):
    from loomtext.sources.tables import decode_pages

    body = ("<meta charset=gb2312>" + TEXTS["GB2312"]).encode("gb2312")
    df = spark.createDataFrame([(1, "u", bytearray(body)), (2, "u", None)], "page_id long, url string, body binary")
    got = {r.page_id: r for r in decode_pages(df).collect()}
    assert got[1].html.endswith(TEXTS["GB2312"]) and got[1].charset == "gb2312" and got[2].html is None
    cases = [("a", "a", "b", "a"), ("a", "b", "b", "b"), ("a", "c", "b", "b"), ("a", None, None, "a"), (None, "c", None, "c"), (None, None, None, "utf-8")]
    v = spark.createDataFrame(cases, "m string, h string, d string, want string").select("want", charset.vote(F.col("m"), F.col("h"), F.col("d")).alias("got")).collect()
    assert all(r.got == r.want for r in v)
    s = spark.createDataFrame([("Timed out",), ("dns error",), ("x",)], "m string").select(charset.crawl_status(F.col("m"))).collect()
    assert [r[0] for r in s] == [502, 404, 500]


def test_reflow(spark):
    long = "This line is long enough to run on to the next one of the page"
    page = lambda k: f"Annual Report\n{long}\nand here it ends.\nShort heading\n{k}\nCompany Ltd\n"
    rows = [(1, k, page(k)) for k in range(1, 5)] + [(2, 1, "one\n目录\nIntro ........ 3"), (3, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    assert {(r.bare, r.place, r.n) for r in reflow.running_lines(df).where("doc_id = 1").collect()} >= {("AnnualReport", "top", 4), ("CompanyLtd", "end", 4)}
    body = {r.line for r in reflow.body_lines(df).where("doc_id = 1").collect()}
    assert "Annual Report" not in body and "Company Ltd" not in body and not any(x.isdigit() for x in body)
    rows = [(1, 1, f"Title\n{long}\nand here it ends.\n{long}"), (1, 2, "which goes on after the page break and ends.")]
    got = reflow.reflowed(spark.createDataFrame(rows, "doc_id long, page_no int, text string")).first().text
    assert got == f"Title\n{long} and here it ends.\n{long} which goes on after the page break and ends."


def test_evaluation_by_hand(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, positive int")
    pr = sorted((r.score, round(r.precision, 6), r.recall) for r in evaluate.pr_curve(df).collect())
    assert pr == [(0.7, 0.5, 1.0), (0.9, 1.0, 0.5)]
    assert evaluate.average_precision(df).first()[0] == pytest.approx(0.75)
    # pairs of positive over negative: 3 + 2 + tie / 2 ... of 6
    assert evaluate.auc(df).first()[0] == pytest.approx((3 + 1 + 0.5) / 6)


def test_pages_of_open_tags_take_linear_time():
    for page in ("<a x" * 200000, "<!" * 200000, '<a "' * 100000 + ">", "<a '\">" * 100000):
        parse(page)
    (n,) = [n for n in parse('<p a="1>2" b=\'<\'>t</p>').children if n.tag == "p"]
    assert n.attrs == {"a": "1>2", "b": "<"} and n.inner_text() == "t"
    assert [n.tag for n in parse('x<p a="1>y').children] == ["#text", "p"]


def test_nested_blocks_take_sums():
    deep = "<div>" * 300 + "text " * 50 + "</div>" * 300
    scores = article.block_scores(parse(deep))
    assert len(scores) == 300 and all(t == "text " * 50 for _, _, t in scores)


def test_rows_of_a_pattern_that_takes_too_long_say_so(spark):
    df = spark.createDataFrame([(1, "u", "<b>x</b>" * 3, "<b>(?<Title>x)</b>"), (2, "u", "none", "<b>(?<Title>x)</b>")], "page_id long, url string, html string, pattern string")
    assert [r.complete for r in wrapper.regex_rows(df).collect()] == [True] * 3
    late = wrapper.regex_rows(df, seconds=-1.0).orderBy("page_id").collect()
    assert [(r.page_id, r.complete) for r in late] == [(1, False), (2, False)] and late[1].title is None


def test_references_end_with_a_semicolon(spark, tmp_path):
    assert decoded("a&amp;b &amp &ampx &notit; &lt;&#65;&#x42; &nosuch; &amp;lt; &eacute;") == "a&b &amp &ampx &notit; <AB &nosuch; &lt; é"
    rows = [(1, "u", "<h1>A &amp; B &lt;c&gt; &amp</h1>"), (2, "u", "<p>x</p>"), (3, "u", "<h1> </h1>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title for r in entry.queries()["item_titles"](spark, str(tmp_path)).collect()}
    assert got == {1: "A & B <c> &amp", 2: "", 3: ""}


def test_page_numbers_of_six_digits(spark, tmp_path):
    rows = [(k, "http://s.com/x", "") for k in (99_998, 99_999, 100_000, 12_345_677)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.next_url, r.rule) for r in entry.queries()["next_of_numbered"](spark, str(tmp_path)).collect()}
    assert got == {k: (f"http://s.com/p/{k + 1}", 1 + k % 2) for k, _, _ in rows}
    links = spark.createDataFrame([(1, k, str(k), f"http://s.com/{n + k}") for n in (100_000,) for k in (1, 2)], "page_id long, idx int, text string, href string")
    assert paging.next_links(links).count() == 0 and paging.next_links(links, digits=6).count() == 1
