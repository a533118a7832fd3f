import os

import pytest

from loomtext.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
TEXTS = ["", "Hello world's  end\n\n x", "Éauouon. ouè éçmentelle — naïve ﬁ 你好 мир 12345 ½  　 x", "a" * 300, "na " * 5000, "<|endoftext|> token", "😀😀 é \t\t  tab ", "  ", "The and attion to thanedble the, anea.\nTh123's'LL 'll"]


def test_counts_equal_a_whole_encoding(spark):
    import json

    from tokenizers import Tokenizer

    path = tokens.VOCABULARY.replace(".tiktoken", ".json")
    assert json.load(open(path))["model"]["type"] == "BPE"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = [(i, x, 1) for i, x in enumerate(TEXTS)] + [(99, None, 1), (None, "a b", 1), (0, TEXTS[0], 1)]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    want = [(d, None if x is None else len(t.encode(x, add_special_tokens=False).ids)) for d, x, _ in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.n_tokens is None or r.n_whole <= r.n_pretokens <= r.n_tokens


def test_proof_agrees_with_merging():
    ranks = tokens.read_ranks(tokens.VOCABULARY)
    whole = tokens.prove(ranks)
    assert len(whole) > 0.9 * len(ranks)
    toy = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5, b"abca": 6}
    # abca merges as a bc a -> abc a -> abca; abcb never comes to one token
    assert tokens.prove(toy) == {"a", "b", "c", "bc", "ab", "abc", "abca"}
    assert tokens.prove({b"a": 0, b"b": 1, b"aba": 3, b"bb": 2}) == {"a", "b", "bb"}


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
