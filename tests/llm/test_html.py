import random
import re

import numpy as np

from loomtext.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><style>p{}</style></head><body><script>var t="</p><p>no";</script>
<nav><ul><li><a href="/x">Home</a></li><li><a href="/y">About us</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy it now here.</div>
<article><h1>Caf&eacute; title of the page here</h1><p><b>Bold start<br><p>""" + "long words of text " * 12 + """</p><p>x < y and <a href="z">one link</a> """ + "more words " * 20 + """</p></article><footer>&copy; me</footer></body></html>"""


def test_blocks_by_hand():
    got = H.blocks(PAGE)
    assert [(b.text[:12], b.words, b.linked) for b in got] == [("Home", 1, 1), ("About us", 2, 2), ("Buy it now h", 4, 0), ("Café title o", 6, 0), ("Bold start", 2, 0), ("long words o", 48, 0), ("x < y and on", 46, 2), ("© me", 2, 0)]
    assert H.blocks("") == [] and [b.text for b in H.blocks("a <b>c</b>d <!-- x")] == ["a cd"]
    assert H.observed(got)[0].tolist() == [0, 0, 1, 1, 2, 1]


def test_head_without_its_end_tag():
    text = lambda page: [b.text for b in H.blocks(page)]
    inside = '<meta charset="a>b"><link rel=x><title>t < u</title><!-- <p> --><style>p{}</style><script>"</head><p>no"</script><base href=z>'
    for head in ("<head>", "<HEAD lang=en>\n"):
        for then in ("<body><p>one two</p>", "<p>one two", "<div>one</div> <h1>two</h1>", "</head><body><p>one two", "</head >one two", "one two", "</body>one two"):
            assert " ".join(text(f"<html>{head}{inside}{then}")) == "one two", then
    assert text("<html><head><title>t</title><body><p>text of it") == ["text of it"]
    assert text("<head><title>open<body><p>a b") == ["a b"] and text("<head><script>open</head><p>a b") == ["a b"] and text("<head><!-- open</head><p>a b") == ["a b"]
    assert text("<head></head><header>a</header>") == ["a"] and text("<header>a<p>b") == ["a", "b"] and text("<head>") == []


def test_tree_learns_and_is_stable():
    x = np.array(H.LABELLED, dtype=float)
    a, b = H.trained(), H.trained()
    assert (a.cut == b.cut).all()
    assert ((a.probability(x[:, :6]) >= 0.5) == x[:, 6]).mean() > 0.93
    one = H.grow(np.array([[1.0], [2.0]]), np.array([1.0, 1.0]))
    assert one.probability(np.array([[9.0]])) == 1


def test_held_out_pages(spark):
    """On pages that the table is not from, words in <article> against the rest."""
    import glob

    if not glob.glob("/root/testdata/sf0.01/pages.parquet"):
        return
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    tree = H.trained()
    right = total = 0
    for p in pages:
        bs = H.blocks(p)
        inside = " ".join(" ".join(b.text for b in H.blocks(a)) for a in re.findall(r"<article>.*?</article>", p, re.S))
        for b, ok in zip(bs, tree.probability(H.observed(bs)) >= 0.5):
            right += b.words * (ok == (b.text in inside))
            total += b.words
    assert right / total > 0.97


def test_frames(spark):
    rows = [(1, "u", PAGE, "t"), (2, "u", None, "t"), (3, "u", "", "t"), (None, "u", PAGE, "t"), (1, "u", PAGE, "t"), (4, "u", "<p>" + "w " * 300000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.main_text(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].title == "A & B" and "long words of text" in by[1].text and "one link" in by[1].text and "Home" not in by[1].text and "Buy" not in by[1].text and "©" not in by[1].text
    assert by[2].text is None and by[2].n_blocks == 0 and by[3].text == "" and by[None].text == by[1].text and len(by[4].text) == 599999
    assert H.main_text(df.limit(0)).count() == 0


def naive_blocks(page):
    """By the standard library's parser, for tidy pages."""
    from html.parser import HTMLParser

    out = []

    class Reader(HTMLParser):
        text, linked, inside, skip = "", 0, False, 0

        def cut(self):
            if self.text.split():
                out.append((" ".join(self.text.split()), len(self.text.split()), self.linked))
            self.text, self.linked = "", 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head")
            if tag == "a":
                self.inside = True
            elif tag not in H._INLINE and tag not in ("script", "style"):
                self.cut()

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "head")
            if tag == "a":
                self.inside = False
            elif tag not in H._INLINE and tag not in ("script", "style"):
                self.cut()

        def handle_data(self, data):
            if not self.skip:
                self.text += data
                self.linked += len(data.split()) if self.inside else 0

    r = Reader(convert_charrefs=False)
    r.feed(page)
    r.close()
    r.cut()
    return out


def test_blocks_equal_a_naive_parser():
    rnd = random.Random(3)

    def body(depth):
        kinds = ["text"] * 4 + ["inline", "link"] + (["block"] * 3 if depth else [])
        out = ""
        for _ in range(rnd.randint(1, 4)):
            k = rnd.choice(kinds)
            words = " " + " ".join(rnd.choices(["one", "two", "3", "été", "x.y"], k=rnd.randint(1, 5))) + " "
            if k == "text":
                out += words
            elif k == "inline":
                out += f"<b>{words}</b>"
            elif k == "link":
                out += f'<a href="/x?y=1>2">{words}</a>'
            else:
                tag = rnd.choice(["div", "p", "li", "section", "td"])
                out += f"<{tag} class='c'>{body(depth - 1)}</{tag}>"
        return out

    for _ in range(200):
        page = f"<html><head><style>p{{}}</style></head><body>{body(3)}<script>var a = '<p>no</p>';</script>{body(1)}</body></html>"
        assert [(b.text, b.words, b.linked) for b in H.blocks(page)] == naive_blocks(page)


def test_pages_of_open_tags_take_linear_time(spark):
    pages = ["<a x" * 500000, '<a "' * 200000 + ">", "<a '\">" * 200000, "<!" * 300000, "<script " * 200000, "<title>" * 200000, '<head><meta "' * 100000 + ">"]
    for page in pages:
        H.blocks(page)
    docs = spark.createDataFrame([(1, pages[0], "t"), (2, None, "t"), (2, None, "t"), (3, "", "t")], "page_id long, html string, title string")
    got = sorted((r.page_id, r.title, r.n_main) for r in H.main_text(docs).collect())
    assert len(got) == 4 and [g[0] for g in got] == [1, 2, 2, 3] and H.main_text(docs.limit(0)).count() == 0


def test_tree_equals_a_naive_descent():
    rng = np.random.default_rng(6)
    t = H.trained()
    x = np.stack([rng.integers(0, 90, 400), rng.random(400).round(1), rng.integers(0, 90, 400), rng.random(400).round(1), rng.integers(0, 90, 400), rng.random(400).round(1)], axis=1)
    for row, got in zip(x, t.probability(x)):
        at = 0
        while t.feature[at] >= 0:
            at = t.low[at] if row[t.feature[at]] < t.cut[at] else t.high[at]
        assert got == t.share[at]
