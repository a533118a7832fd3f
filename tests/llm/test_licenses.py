import itertools
import random
import re

import pyarrow as pa

from loomtext.llm import licenses as L

WORDS = "an anea the of thon with reth under license licensed version public general free software copy".split()


def found(text):
    return [(n, text[a:b], c) for _, n, a, b, c, _ in L.notices(pa.array([text]), L.compiled(L.TEMPLATES))]


def test_longest_rise_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        x = rnd.sample(range(20), rnd.randint(0, 8))
        best = max((len(c) for k in range(len(x) + 1) for c in itertools.combinations(x, k) if list(c) == sorted(c)), default=0)
        got = [x[i] for i in L.longest_rise(x)]
        assert got == sorted(got) and len(got) == best


def test_alignment_is_sound_and_whole_on_equal_texts():
    rnd = random.Random(2)
    for _ in range(300):
        a = [rnd.randint(0, 12) for _ in range(rnd.randint(0, 15))]
        b = [rnd.randint(0, 12) for _ in range(rnd.randint(0, 15))]
        p = L.align(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(p))
        assert len(L.align(a, a)) == len(a)
    # recursion into the gaps: 7 is no anchor in the whole, but is between 2 and 3
    assert (3, 3) in L.align([7, 1, 2, 7, 3, 7, 9], [7, 1, 2, 7, 3, 8, 7])


def test_every_template_is_found_in_prose_also_repeated_and_edited():
    rnd = random.Random(3)
    for name, _, text in L.TEMPLATES:
        prose = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 60))) for _ in range(3)]
        doc = f"{prose[0]} qq\n{text.upper()}\nqq {text.replace(',', ' ,')} {prose[1]} zz {text}"
        assert [n for n, _, _ in found(doc)].count(name) == 3, name
        w = text.split()
        if len(w) > 20:
            for k in range(8, len(w) - 4, 25):
                w[k] = "changed"
            assert name in [n for n, _, _ in found(f"{prose[0]} {' '.join(w)} {prose[2]}")]


def test_offsets_names_and_clean_texts():
    text = "Étre ñ 你.\nLicensed under the Apache License, Version 2.0. Then MIT."
    assert found(text) == [("Apache-2.0", "Licensed under the Apache License, Version 2.0", 1.0)]
    for clean in ("", "under the license of the mit", "This work is licensed under the GNU license.", "Released " + "x " * 30 + "under the MIT License", "Licensed under the Foo License, Version 2.0"):
        assert found(clean) == []


def test_creative_commons_variants_and_versions():
    for v in ("4.0", "3.0", "2.5", "2.0", "1.0", ""):
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
            want = f"CC-{kind}-{v}".rstrip("-")
            for text in (f"an anea. Licensed under CC {kind} {v}. The thon", f"SPDX-License-Identifier: {want}", f"License: CC {kind} {v}", f"This work is licensed under a Creative Commons {L._CC[kind]} {v} International License."):
                assert [n for n, _, _ in found(text)] == [want], text


def test_near_names_are_told_apart():
    for text, want in (("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"), ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("Released under the Unlicense.", "Unlicense")):
        assert [n for n, _, _ in found(text)] == [want], text


def test_license_lines_of_the_documents_against_plain_search(spark):
    import glob

    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    if not glob.glob("/root/testdata/sf0.01/documents.parquet"):
        return
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    got, want = {}, {}
    for i, t in enumerate(texts):
        for line, name in lines.items():
            if line in t:
                want[i, name] = t.count(line)
    for i, name, *_ in L.notices(pa.array(texts), L.compiled(L.TEMPLATES)):
        got[i, name] = got.get((i, name), 0) + 1
    assert {n for _, n in want} == set(lines.values())
    assert all(got.get(k, 0) >= n for k, n in want.items())


def test_frames(spark):
    text = "x. Released under the MIT License."
    rows = [(1, text, 1.0), (1, text, 1.0), (None, text, 1.0), (2, None, 1.0), (3, "", 1.0), (4, "the license " * 50000 + text, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, coverage double")
    assert sorted(str(r.doc_id) for r in L.licenses(df).collect()) == ["1", "1", "4", "None"]
    assert L.licenses(df.limit(0)).count() == 0


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(now[j], row[j + 1]))
        row = now
    return row[-1]


def test_notices_against_a_naive_aligner():
    """No notice has more words than the longest common sequence of its stretch
    and the template, and wherever a template stands word for word one is found
    that has at least as many."""
    rnd = random.Random(14)
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    by = {}
    for name, _, text in L.TEMPLATES:
        by.setdefault(name, []).append(words(text))
    compiled = L.compiled(L.TEMPLATES)
    for _ in range(60):
        name, _, text = rnd.choice(L.TEMPLATES)
        w = text.split()
        for _ in range(rnd.randint(0, len(w) // 12)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        doc = f"{' '.join(rnd.choices(WORDS, k=20))} qq. {' '.join(w)} qq {' '.join(rnd.choices(WORDS, k=20))}"
        got = list(L.notices(pa.array([doc]), compiled))
        for _, n, a, b, c, k in got:
            part = words(doc[a:b])
            most = max(common_words(part, t) for t in by[n])
            assert k <= most and c >= L.COVERAGE
        if w == text.split():
            assert got and max(k for *_, k in got) >= len(words(text))


def test_ties_and_empty_tables(spark):
    two = [("A-1", "", "alpha beta gamma delta"), ("B-1", "", "alpha beta gamma delta")]
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta y", "l"), (2, None, "l"), (None, "alpha beta gamma delta", "l")], "doc_id long, text string, license string")
    assert sorted((str(r.doc_id), r.license) for r in L.licenses(docs, two).collect()) == [("1", "A-1"), ("None", "A-1")]
    assert L.licenses(docs.limit(0)).count() == 0
