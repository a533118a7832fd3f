import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import kernel as K
from loomtext.llm import langid

SEEDS = {"en": "the and of to in is that with for this thing was are on by", "de": "der die und nicht ein ist sich mit für auf dem schön über", "fr": "le la et les des une qui pour dans être à où avec", "es": "el los que del una por con ción señor está niño para"}


def text(lang, n, seed):
    rnd = random.Random(f"{lang}{seed}")
    return " ".join(rnd.choice(SEEDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 10 + k, text(lang, 60, i), lang, 1) for k, lang in enumerate(SEEDS) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, keep int")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs)


def test_viterbi_equals_every_path():
    rng = np.random.default_rng(1)
    for trial in range(30):
        sizes = rng.integers(1, 7, 5)
        score = rng.normal(0, 2, (sizes.sum(), 3))
        first = np.r_[0, np.cumsum(sizes)]
        got = langid.viterbi(score, first, 1.5, block=int(rng.integers(1, 5)))
        for a, b in itertools.pairwise(first):
            def worth(path):
                return sum(score[a + i, s] for i, s in enumerate(path)) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))

            assert worth(got[a:b]) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=int(b - a)))))


def test_held_out_accuracy(spark, model):
    rows = [(i, text(lang, 30, 1000 + i), lang) for lang in SEEDS for i in range(25)]
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, want string"), model).collect()
    assert sorted(r.lang for r in got) == sorted(r[2] for r in rows) and all(r.keep and r.share == 1 for r in got)


def test_mixed_text_spans(spark, model):
    a, b = text("en", 40, 1), text("de", 30, 2)
    mixed = f"{a}. {b}! Привет мир 123 これは日本語 です 中文。"
    (r,) = langid.languages(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    assert [s.lang for s in r.spans] == ["en", "de", "ru", "ja"]
    assert mixed[r.spans[0].start_char : r.spans[0].end_char] == a and mixed[r.spans[1].start_char : r.spans[1].end_char] == b
    assert mixed[r.spans[2].start_char : r.spans[2].end_char] == "Привет мир 123"
    assert sum(s.n_words for s in r.spans) == K.words(pa.array([mixed])).first[-1]


def test_long_text_and_edges(spark, model):
    long = " ".join(text(x, 9000, 3) for x in ("fr", "es", "fr"))
    rows = [(1, long, None, 5), (2, None, "en", 5), (3, "", "en", 5), (None, "der die und", "xx", 5), (5, "123 456", None, 5), (6, "!!! ###", None, 5), (3, "", "en", 5), (7, "zqxj wvkq xzzq qqvx jjxw", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, share long")
    got = {r.doc_id: r for r in langid.languages(df, model).collect()}
    assert [s.lang for s in got[1].spans] == ["fr", "es", "fr"] and got[1].lang == "fr"
    assert got[None].lang == "de" and got[None].keep
    for i in (2, 3, 5, 6):
        assert (got[i].lang, got[i].share, got[i].keep, got[i].spans) == ("und", 0, False, [])
    assert not got[7].keep
    kept = langid.identified(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert langid.languages(df.limit(0)).count() == 0


def test_scripts_without_a_trained_language(spark, model):
    texts = {"bn": "আমি বাংলায় গান গাই", "ta": "தமிழ் மொழி ஒரு செம்மொழி", "hy": "Բարեւ աշխարհ լավ օր", "ka": "გამარჯობა მსოფლიო კარგი", "el": "καλημέρα κόσμε", "he": "שלום עולם", "ar": "مرحبا بالعالم", "hi": "नमस्ते दुनिया", "th": "สวัสดี ชาวโลก", "ko": "안녕 세상", "ja": "これは日本語です", "zh": "中文文字", "und": "ᚠᚢᚦᚨᚱᚲ ᚠᚢᚦ"}
    rows = [(i, x, t) for i, (x, t) in enumerate(texts.items())] + [(90, "mix", f"{text('en', 8, 3)} {texts['bn']} {text('en', 8, 4)}"), (91, "zh", "𠀀𠀁 中文")]
    got = {r.doc_id: r for r in langid.languages(spark.createDataFrame(rows, "doc_id long, want string, text string"), model).collect()}
    for i, want, _ in rows[:13]:
        assert (got[i].lang, got[i].keep) == (want, want != "und"), want
    assert [s.lang for s in got[90].spans] == ["en", "bn", "en"] and got[91].lang == "zh"


def test_trained_languages_share_a_script(spark):
    seeds = {"ru": "это что как все она так его только было ещё", "uk": "це що як усі вона так його тільки було ще їх є", "en": SEEDS["en"]}
    rnd = random.Random(3)
    make = lambda x, n: " ".join(rnd.choices(seeds[x].split(), k=n))
    m = langid.train(spark.createDataFrame([(i, make(x, 50), x) for i in range(30) for x in seeds], "doc_id long, text string, lang string"))
    assert m.names().count("ru") == 1
    rows = [(1, make("ru", 20)), (2, make("uk", 20)), (3, f"{make('ru', 15)} {make('uk', 15)} {make('en', 15)}")]
    got = [[s.lang for s in r.spans] for r in sorted(langid.languages(spark.createDataFrame(rows, "doc_id long, text string"), m).collect())]
    assert got == [["ru"], ["uk"], ["ru", "uk", "en"]]


def test_ties_repeats_and_empty_tables(spark, model):
    rows = [(1, "12 34", "x"), (1, "12 34", "x"), (2, None, "x"), (3, "", "x"), (None, text("de", 9, 1), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = langid.languages(docs, model).collect()
    assert [(r.lang, r.share, r.keep, r.spans) for r in sorted(got, key=str)[:2]] == [("und", 0.0, False, [])] * 2 and len(got) == 5
    assert [r.doc_id for r in langid.identified(docs, model).collect()] == [None]
    assert langid.languages(docs.limit(0), model).count() == langid.identified(docs.limit(0), model).count() == 0
