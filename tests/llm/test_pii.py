import random

import pyarrow as pa
import pytest

from loomtext.llm import pii

CASES = [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com", "john@example.com"),
    ("john at example dot com", "email", "john at example dot com", "john@example.com"),
    ("ask a.b (at) c (dot) org", "email", "a.b (at) c (dot) org", "a.b@c.org"),
    ("jоhn@exаmple.cоm ok", "email", "jоhn@exаmple.cоm", "john@example.com"),
    ("ｊｏｅ＠ｘ．ｃｏｍ", "email", "ｊｏｅ＠ｘ．ｃｏｍ", "joe@x.com"),
    ("x jo​hn@ex​ample.com", "email", "jo​hn@ex​ample.com", "john@example.com"),
    ("call five five five one two three four five six seven!", "phone", "five five five one two three four five six seven", "5551234567"),
    ("(five five five) 123-4567", "phone", "(five five five) 123-4567", "(555) 123-4567"),
    ("tel. +1 (743) 555-3824 x", "phone", "+1 (743) 555-3824", "+1 (743) 555-3824"),
    ("nº ٥٥٥-١٢٣-٤٥٦٧", "phone", "٥٥٥-١٢٣-٤٥٦٧", "555-123-4567"),
    ("ip 10.0.0.255.", "ip", "10.0.0.255", "10.0.0.255"),
    ("DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
    ("card 4785-3805-9239-1139,", "card", "4785-3805-9239-1139", "4785-3805-9239-1139"),
    ("ssn 078-05-1120.", "ssn", "078-05-1120", "078-05-1120"),
    ('token = "24be64439e3e49cf46b2"', "secret", "24be64439e3e49cf46b2", "24be64439e3e49cf46b2"),
]
CLEAN = ["", "Anat with by of nteres atre are.", "on 2024-01-15 at noon", "one of two, three or four", "look at that dot", "1.2.3", "version 10.2.33", "It is at home. Come.", "token of love", "GB00 0000 0000 0000 0000 00", "ISBN 9783161484100", "ISBN 978-3-16-148410-0", "order 4111111111111112 of May", "no. 1234-5678-9012-3456"]


@pytest.mark.parametrize(("text", "kind", "source", "value"), CASES)
def test_found_at_its_source(text, kind, source, value):
    (k, a, b, v), = pii.identifiers(text)
    assert (k, text[a:b], v) == (kind, source, value)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert pii.identifiers(text) == []


ADJACENT = [
    ("card", ["4111111111111111", "5500005555555559"]),
    ("card", ["7536784127813050", "4845168114407329", "4111111111111111"]),
    ("card", ["4111 1111 1111 1111", "5500 0055 5555 5559"]),
    ("card", ["4111-1111-1111-1111", "3782 822463 10005", "5500005555555559"]),
    ("phone", ["555-123-4567", "555-987-6543"]),
    ("phone", ["555-123-4567", "555-987-6543", "555-222-3333", "555-444-5555"]),
    ("phone", ["555.123.4567", "555.987.6543"]),
    ("phone", ["555 123 4567", "555 987 6543"]),
    ("phone", ["06 12 34 56 78", "06 98 76 54 32"]),
    ("phone", ["+1 555 123 4567", "+1 555 987 6543"]),
    ("phone", ["5551234567", "5559876543"]),
    ("ssn", ["078-05-1120", "078-05-1121"]),
    ("iban", ["DE89 3704 0044 0532 0130 00", "ES91 2100 0418 4502 0005 1332", "DE89370400440532013000"]),
    ("iban", ["ES91 2100 0418 4502 0005 1332", "ES91 2100 0418 4502 0005 1332"]),
]


@pytest.mark.parametrize(("kind", "values"), ADJACENT)
def test_identifiers_side_by_side(kind, values):
    text = "pay " + " ".join(values) + " now"
    assert [(k, text[a:b], v) for k, a, b, v in pii.identifiers(text)] == [(kind, v, v) for v in values]
    assert pii.redact(text) == "pay " + " ".join([f"<{kind.upper()}>"] * len(values)) + " now"


def test_different_identifiers_side_by_side():
    text = "078-05-1120 4111111111111111 555-123-4567 4111 1111 1111 1111 10.0.0.1 DE89 3704 0044 0532 0130 00 555-987-6543"
    assert pii.redact(text) == "<SSN> <CARD> <PHONE> <CARD> <IP> <IBAN> <PHONE>"
    assert pii.redact("row 12345 4111 1111 1111 1111") == "row 12345 <CARD>"


def test_a_card_has_a_check_digit_or_a_name():
    assert pii.redact("visa card 4111111111111112") == "visa card <CARD>"
    assert pii.redact("parcel 4111111111111112 4111111111111111") == "parcel 4111111111111112 <CARD>"
    assert pii.redact("4451718024887799 27.65.93.188") == "<CARD> <IP>" or not pii._luhn("4451718024887799")


def finders_alone(text):
    """The identifiers by a character-by-character reading of the disguises."""
    out, src = [], []
    for i, c in enumerate(text):
        for x in pii.FOLD.get(c, c):
            out.append(x)
            src.append(i)
    return "".join(out), src


def test_folding_equals_a_naive_one():
    rnd = random.Random(12)
    keys = list(pii.FOLD)
    for _ in range(300):
        text = "".join(rnd.choice(keys) if rnd.random() < 0.5 else rnd.choice("abc 12.@") for _ in range(40))
        t = pii.folded(pii.Traced(text, pii.array("i", range(40)), pii.array("i", range(1, 41))))
        want, src = finders_alone(text)
        assert t.text == want and list(t.start) == src and list(t.end) == [i + 1 for i in src]


def test_long_texts_take_few_bytes_a_character():
    t = pii.normalised("x" * 1000000 + " joe [at] x.com")
    assert t.start.itemsize + t.end.itemsize == 8 and t.text.endswith("joe@x.com")


def test_the_trigger_misses_nothing():
    rnd = random.Random(6)
    atoms = [*(c[2] for c in CASES), *CLEAN, *"@.-()[] 0123456789", " at ", " dot ", "[at]", "(dot)", "five", "Seven ", "tres", ".com", "joe", "а", "​", "１", "key=", "+1", "abcdef12", "–", " "]
    texts = ["".join(rnd.choices(atoms, k=rnd.randint(1, 9))) for _ in range(20000)]
    hit = pii.suspects(pa.array(texts)).to_pylist()
    missed = [t for t, h in zip(texts, hit) if not h and pii.identifiers(t)]
    assert not missed
    for t in texts[:4000]:
        for _, a, b, v in pii.identifiers(t):
            assert 0 <= a < b <= len(t) and v


def test_the_trigger_misses_nothing_with_folded_and_accented_characters():
    rnd = random.Random(8)
    keys = {}
    for k, v in pii.FOLD.items():
        keys.setdefault(v, []).append(k)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    sources = [c[2] for c in CASES if c[1] != "secret"] + ["secret = 24be64439e3e", "+33 06 12 34 56 78", "card 4785 3805 9239 1139", "joe at example.com", "joe at my-site.example dot com", "one two seven.0.0.1", "555 dot 123 dot 4567 at home"]
    texts = ["jos\u00e9 at example.com", "10\u20220\u20220\u20221"]
    for t in sources:
        # each stand-in at each place it fits, alone and everywhere at once
        for c in sorted(set(t)):
            swaps = (rnd.sample(keys[c], 12) if "0" <= c <= "9" else keys.get(c, [])) + (spaces if c == " " else []) + (list("\u00e9\u00fc\u00f1\u0130\u0131\u017f\u212a") if c.isalpha() else [])
            texts += [x for k in swaps for x in (t.replace(c, k), t.replace(c, k, 1))]
        for _ in range(300):
            texts.append("".join(rnd.choice(keys.get(c, [c]) + ([rnd.choice(spaces)] if c == " " else []) + ["\u00e9"] * c.isalpha()) if rnd.random() < 0.3 else c for c in t))
    hit = pii.suspects(pa.array(texts)).to_pylist()
    assert sum(map(bool, map(pii.identifiers, texts))) > 1000
    assert not [t for t, h in zip(texts, hit) if not h and pii.identifiers(t)]


def test_frames(spark):
    rows = [(i, c[0], "x") for i, c in enumerate(CASES)] + [(100, None, "x"), (None, CASES[0][0], "x"), (0, CASES[0][0], "x"), (101, "", "x"), (102, "word " * 60000 + "a@b.com " + "word " * 60000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = pii.personal_data(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kind, r.value) for r in got) == sorted([(False, i, c[1], c[3]) for i, c in enumerate(CASES)] + [(True, 0, "email", CASES[0][3]), (False, 0, "email", CASES[0][3]), (False, 102, "email", "a@b.com")])
    assert {(r.start_char, r.end_char) for r in got if r.doc_id == 102} == {(300000, 300007)}
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    by = {r.doc_id: r.text for r in clean.where("doc_id is not null").collect()}
    assert by[0] == "mail <EMAIL> now" and by[100] is None and by[101] == "" and "a@b" not in by[102]
    counted = spark.createDataFrame([(1, "a@b.com", 7), (2, "ab", 9)], "doc_id long, text string, n_chars long")
    assert {r.n_chars for r in pii.redacted(counted).collect()} == {7, 9}
    assert pii.personal_data(docs.limit(0)).count() == 0
