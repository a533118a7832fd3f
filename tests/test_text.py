import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.functions import paths as P
from loomtext.functions import text as T
from loomtext.sources.tables import cookies


def value(spark, column, **cells):
    ddl = ", ".join(f"{k} string" for k in cells)
    return spark.createDataFrame([tuple(cells.values())], ddl).select(column.alias("v")).first().v


def cases(C):
    return [
        (T.clean_ubb(C), "a[b]c[/b]d[url]e[quote]", "acde[quote]"),
        (T.clean_ubb(C), "", None),
        (T.clean_url(C), "see http://a-b.com/x/y?z=1&q=%20 now HTTPS://x.org", "see ://x.org"),
        (T.clean_url(C), "see http://a.com,now", "see ,now"),
        (T.clean_email(C), "mail o'neil.x+y@sub-a.example.com!", "mail !"),
        (T.clean_repetition(C), "wow!!! so... a-- ====", "wow. so. a-- ."),
        (T.clean_nonsense(C), "a , b\tc☆d&#123;e", "abcde"),
        (T.clean_nonsense(C, keep_connection=True), "a - b", "a - b"),
        (T.clean_nonsense(C, letters=True), "aжb", "ab"),
        (T.to_half_width(C), "ＡＢ　１２！", "AB 12!"),
        (T.is_full_width(C), "Ａ", True),
        (T.is_half_width(C), "", False),
        (T.to_simplified(C), "國學", "国学"),
        (T.is_traditional(C), "国学", False),
        (T.full_clean(C), "<!-- x --><p>國 <b>x</b>[b]!!!</p> a@b.co http://a.b/c", "国 x.  "),
        (T.full_clean(C), None, ""),
        (T.thumb_text(C, 3), "abcdef", "abc"),
        (T.count_digit_chars(C), "1.2 a", 4),
        (T.count_in_set(C, "ab", spaces=False), "a b c", 2),
        (T.remove_stop_words(C, ["x", "Y"]), "aXbxyc", "abxc"),
        (T.safe_file_name(C), 'a/b:c*?"<>|d', "abcd"),
        (T.non_numeric_density(C), "a1½b", 0.5),
        (T.non_digit_punctuation_density(C), "a1.b", 0.5),
        (T.high_char_density(C), "aé", 0.5),
        (T.only_digits_and_marks(C), "1-2.3", True),
        (T.only_digits_and_marks(C, "x"), "1 x 2", True),
        (T.only_digits_and_marks(C, "x"), "1,x", False),
        (T.only_digits_and_marks(C, "x", marks=True), "1,x", True),
        (T.nth_index(C, ".", 2), "a.b.c", 3),
        (T.nth_index(C, ".", 3), "a.b.c", -1),
        (T.count_char(C, "."), "a.b.c", 2),
        (T.non_space_length(C), " a b\n", 2),
        (T.safe_substring(C, 2), "abcd", "cd"),
        (T.safe_substring(C, 3), "abcd", ""),
        (T.weighted_length(C), "中文 abcde", 4),
        (T.weighted_length(C, ["中"]), "中文&nbsp;ab", 2),
        (T.language(C), "a中", "Chinese"),
        (T.language(C), "a", "English"),
        (T.safe_int(C), "x12y3", 12),
        (T.safe_int(C), "x", 0),
        (T.to_unicode_escapes(C), "a中😀", "\\u0061\\u4e2d\\ud83d\\ude00"),
        (T.from_unicode_escapes(C), "\\u4e2d\\u0061", "中a"),
        (F.date_format(T.epoch_time(C), "yyyy-MM-dd HH:mm:ss.SSS"), "1700000000123", "2023-11-14 22:13:20.123"),
        (F.date_format(T.epoch_time(C), "yyyy-MM-dd"), "1700000000", "2023-11-14"),
        (T.epoch_time(C), "17x", None),
        (T.strip_html(C), "<script>x</script><p>a&amp;b</p>c", "a&b\nc"),
        (T.to_simplified(C), "後來書畫㑳𠀀a", "后来书画㑇𠀀a"),
        (T.is_traditional(C), "a電", True),
        (T.is_traditional(C), None, None),
        (T.count_pattern(C, "a."), "abacaa", 3),
        (T.count_pattern(C, "a"), None, 0),
        (T.to_ascii_marks(C), "「ｘ」，《１》。（a）", "「x」,<1>.(a)"),
        (T.without_marks(C), "a-b, 「c」$1", "ab c1"),
        (T.same_bytes(F.encode(C, "UTF-8"), F.lit(b"a")), "a", True),
        (T.same_bytes(F.encode(C, "UTF-8"), F.lit(b"a")), None, None),
        (T.annotated(C), "a <b> c", True),
        (T.annotated(T.strip_annotations(C)), "<<<b>x>y>z", False),
        (T.common_prefix_length(C, F.lit("héllo")), "héx", 2),
        (T.common_prefix_length(C, F.lit("")), "x", 0),
        (T.clean_email(C), "a..b-c@d.e-f.gh, x@y @z a@b.c", "a.., x@y @z "),
        (T.clean_repetition(C), "!!!??..--- ((((", ".??... ."),
        (P.uses_name(C), "//a[@id='x']", True),
        (P.level(C), "./a/b//c", 2),
        (P.without_last_ordinal(C), "/a[1]/b[2]", "/a[1]/b"),
        (P.without_last_ordinal(C), "/a[1]/b[@x]", "/a[1]/b[@x]"),
        (P.without_ordinal_from_last(C, 2), "/a[1]/b[2]/c[3]", "/a[1]/b/c[3]"),
        (P.parent(C, 2), "/a/b/c", "/a"),
        (P.last_tag(C), "/a/b[2]", "b"),
        (P.combined(F.lit("/a/b"), C), "../c/./d", "/a/c/d"),
        (P.relative(C, F.lit("/a/b/x")), "/a/c/d", "../../c/d"),
        (P.generalised(C, F.lit("/a[1]/b[2]/c")), "/a[1]/b[3]/c", "/a[1]/b/c"),
        (P.generalised(C, F.lit("/a[1]/x[2]")), "/a[1]/b[3]", None),
        (P.difference(C, F.lit("/a[1]/b[12]/c")), "/a[1]/b[3]/c", 1),
        (P.common_ancestor(C, F.lit("/a/b[2]/c")), "/a/b[2]/d", "/a/b[2]"),
        (P.common_ancestor(C, F.lit("/a/b[2]/c"), tags_only=True), "/a/b[1]/d", "/a/b[1]"),
        (P.is_container(C), "span", False),
        (P.contains_keyword(C, ["News"]), "x topnews", True),
        (P.keyword_weight(C, {"a": 1.0, "zz": 5.0}), "abc", 1.0),
        (P.good_url(C), " JavaScript:x", False),
        (P.good_url(C), "/x", True),
    ]


def test_columns(spark):
    for n, (column, text, want) in enumerate(cases(F.col("c"))):
        assert (n, text, value(spark, column, c=text)) == (n, text, want)


@pytest.mark.parametrize("href", ["g", "./g", "g/", "/g", "//g.com/x", "?y", "g?y", "#s", "", "../g", "../../g", "../../../g", "g/../h", "http://a/b", "g;x=1/../y", "..", "."])
def test_absolute_url_as_the_standard_has_it(spark, href):
    from urllib.parse import urljoin

    base = "http://a.com/b/c/d?q"
    assert value(spark, P.absolute_url(F.col("c"), F.lit(base)), c=href) == urljoin(base, href)


def test_pairs_and_groups(spark):
    rows = [("kitten", "sitting"), ("abc", "abcd"), ("same", "same"), ("aaaaaaaaaa", "aaaaaaaaab"), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(T.edit_distance(F.col("a"), F.col("b")), T.likeliness(F.col("a"), F.col("b")), T.alike(F.col("a"), F.col("b")), T.common_prefix(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [3, 1, 0, 1, 1] and got[0][1] == pytest.approx(1 - 3 / 7)
    assert [r[2] for r in got] == [False, False, True, True, False] and [r[3] for r in got] == ["", "abc", "same", "aaaaaaaaa", ""]
    assert spark.createDataFrame([("abx",), ("aby",), ("abzz",)], "c string").agg(T.group_prefix(F.col("c"))).first()[0] == "ab"
    assert spark.createDataFrame([("/a/b[1]/c",), ("/a/b[1]/d",)], "c string").agg(P.group_ancestor(F.col("c"))).first()[0] == "/a/b[1]"


def test_cookies(spark):
    rows = [(1, "a=1; b=x=y ;c; =z; a=2"), (2, ""), (3, None)]
    got = {r.i: r.m for r in spark.createDataFrame(rows, "i int, h string").select("i", cookies(F.col("h")).alias("m")).collect()}
    assert got == {1: {"a": "2", "b": "x=y"}, 2: {}, 3: None}


def test_long_texts_without_a_match_take_linear_time(spark):
    long = "word.word-" * 60000 + " " * 60000 + "," * 60000
    got = spark.createDataFrame([(long,)], "c string").select(T.clean_email(F.col("c")).alias("e"), F.length(T.full_clean(F.col("c"))).alias("n")).first()
    assert got.e == long and got.n > 0


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(0, ""), (1, None), (2, "a , b[c]!!!4")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name, empty, null, other", [
    ("clean_nonsense", "", None, "ab[c]!!!4"),
    ("clean_ubb", "", None, "a , b!!!4"),
    ("non_numeric_density", float("nan"), None, 1 - 1 / 12),
    ("non_digit_punctuation_density", float("nan"), None, 1 - 7 / 12),
    ("high_char_density", float("nan"), None, 0.0),
    ("clean_repetition", "", None, "a , b[c].4"),
])
def test_queries_of_an_empty_text_are_their_sql(spark, odd_texts, name, empty, null, other):
    got = {r.doc_id: r.value for r in entry.queries()[name](spark, odd_texts).collect()}
    assert {k: str(v) for k, v in got.items()} == {0: str(empty), 1: str(null), 2: str(other)}


def test_fast_patterns_match_what_the_plain_ones_match(spark):
    rnd = random.Random(9)
    chars = " \t\n\x0b\x1c\x84\x85\x86\xa0 ᠎   　" + "".join(T._MARKS) * 2 + "ab9é¤↏←➿⟀囧〓﹀😀&#;<>" * 3
    rows = [("".join(rnd.choice(chars) * rnd.choice((1, 1, 1, 3, 4)) for _ in range(30)),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "c string")
    c = F.col("c")
    plain = c
    for p in (T.SPACED_MARKS, T.CONTROL, T.ODD, T.CODE):
        plain = F.regexp_replace(plain, p, "")
    assert df.where(plain != T.clean_nonsense(c)).count() == 0 and df.where(plain != c).count() > 1000
    assert df.where(F.regexp_replace(c, T.REPEATED, ".") != T.clean_repetition(c)).count() == 0
    tags = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)\s*>", ""), r"(?is)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|article|section|ul|ol|table)\s*>", "\n"), r"(?s)<[^>]*>", "")
    assert df.where(T.decode_entities(tags) != T.strip_html(c)).count() == 0
