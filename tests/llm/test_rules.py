from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import rules as R


def test_features_by_hand():
    t = ["Hello HELLO bad bad 12", "", None, "a\nb\na\na", "É!!"]
    from loomtext.llm import kernel as K

    x = R.features(pa.array(t), np.sort(K.words(pa.array(["bad"])).hash))
    get = lambda i, name: x[i, R.FEATURES.index(name)]
    assert get(0, "n_words") == 5 and get(0, "marked_words") == 2 and get(0, "distinct_share") == 0.6 and get(0, "top_word_share") == 0.4
    assert get(0, "upper_share") == pytest.approx(6 / 22) and get(0, "digit_share") == pytest.approx(2 / 22)
    assert not x[1].any() and not x[2].any()
    assert get(3, "repeated_line_share") == 0.5 and get(4, "symbol_share") == pytest.approx(2 / 4)


def test_covering_finds_the_planted_conjunctions():
    rng = np.random.default_rng(1)
    x = rng.random((6000, len(R.FEATURES)))
    bad = (x[:, 2] > 0.8) & (x[:, 4] < 0.3) | (x[:, 5] > 0.9)
    got = R.learn(x, bad)
    y = rng.random((4000, len(R.FEATURES)))
    want = (y[:, 2] > 0.8) & (y[:, 4] < 0.3) | (y[:, 5] > 0.9)
    said = np.any([r.holds(y) for r in got], axis=0)
    assert (said == want).mean() > 0.97 and len(got) <= 8
    assert R.learn(x, np.zeros(6000)) == [] and R.learn(x[:0], bad[:0]) == []


def test_expression_agrees_with_the_rules(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, len(R.FEATURES))).round(1)
    rules = [R.Rule(((2, True, 0.8), (4, False, 0.3)), 0.9, 1), R.Rule(((0, False, 0.2),), 0.8, 1)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], R.FEATURES)
    got = [r.n for r in df.select(R.RuleList(rules, np.zeros(0, np.uint64)).number().alias("n")).collect()]
    want = [-1 if r[0] == 0 else next((i for i, q in enumerate(rules, 1) if q.holds(r[None])[0]), 0) for r in x]
    assert got == want


def test_held_out_accuracy_and_edges(spark):
    rng = np.random.default_rng(3)
    vocab = ["w" + "".join(rng.choice(list("abcdef"), 4)) for _ in range(300)]

    def make(i):
        w = list(rng.choice(vocab, 80))
        if i % 5 == 0:
            w[3] = "dolt"
            return " ".join(w), 1, 1
        if i % 5 == 1:
            return " ".join(x + "***" for x in w), 0, 0
        return " ".join(w), 1, 0

    rows = [(i, *make(i)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _, _ in rows] + [(None, rows[2][1], 1), (5000, None, 1), (5001, "", 1), (2, rows[2][1], 1)], "doc_id long, text string, rule int")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 900] + [(3, 0, 1), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = R.judged(docs, labels).collect()
    assert len(got) == 1504
    by = {r.doc_id: r for r in got}
    wrong = [i for i, _, q, x in rows if i >= 900 and by[i].keep != (q == 1 and x == 0)]
    assert len(wrong) < 6
    assert by[None].keep and by[5000].rule == by[5001].rule == -1 and not by[5000].keep and by[2].reason == "default" and by[0].p_bad > 0.8
    assert R.judged(docs.limit(0), labels).count() == 0
    assert all(r.keep for r in R.judged(docs.where("text <> ''"), labels.limit(0)).collect())


def naive_features(text, marked):
    import re

    text = text or ""
    w = re.findall(r"[0-9A-Za-z\u00c0-\u1fff]+", text.lower())
    raw = text.encode()
    n, lines = max(len(w), 1), text.split("\n")
    share = lambda ok: sum(map(ok, raw)) / max(len(raw), 1)
    symbol = lambda c: 0x20 < c < 0x7F and not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"
    counts = Counter(w)
    return [len(w), sum(len(x.encode()) for x in w) / n, share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(symbol), len(counts) / n, max(counts.values(), default=0) / n, 1 - len(set(lines)) / len(lines), sum(counts.get(x, 0) for x in marked)]


def test_verdicts_equal_a_naive_reading_of_the_list(spark):
    from loomtext.llm import kernel as K

    rng = np.random.default_rng(8)
    vocab = ["alpha", "Beta", "GAMMA", "dolt", "été", "x9", "!!", "***", "99", "a.b", "\n", "c\nc"]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 30))) for _ in range(150)] + ["", None, "word " * 100000, "tie tie tie", "tie tie tie"]
    marked = np.sort(K.words(pa.array(["dolt"])).hash)
    rules = [R.Rule(((8, True, 1.0),), 0.9, 1), R.Rule(((5, False, 0.4), (0, True, 3.0)), 0.8, 1), R.Rule(((4, True, 0.1), (2, False, 0.5)), 0.7, 1)]
    docs = spark.createDataFrame([(i, t, 7.0) for i, t in enumerate(texts)], "doc_id long, text string, n_words double")
    got = {r.doc_id: r for r in R.judged(docs, None, R.RuleList(rules, marked)).collect()}
    for i, t in enumerate(texts):
        x = np.array(naive_features(t, ["dolt"]))
        want = -1 if x[0] == 0 else next((k for k, r in enumerate(rules, 1) if all(x[f] >= c if up else x[f] < c for f, up, c in r.conditions)), 0)
        assert (got[i].rule, got[i].keep) == (want, want == 0), t
