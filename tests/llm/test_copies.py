"""Repeated passages, near copies and leaks against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, simhash, suffixes
from loomtext.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefgé", k=rnd.randint(2, 6))) for _ in range(400)]
    make = lambda k: [rnd.choice(vocab) for _ in range(k)]
    passages = [make(rnd.randint(40, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = make(rnd.choice([0, 3, 40, 120, 300]))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(passages)
        if i % 9 == 0 and rows:
            w = rows[rnd.randrange(len(rows))][1].split()
            for _ in range(len(w) // 40):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(n, rows[5][1], "en", "s", 0), (n + 1, "na " * 200, "en", "s", 0), (n + 2, None, None, None, None), (None, rows[7][1], "en", "s", 0), (n + 3, "", "", "", 0), rows[9], (n + 4, ", ".join(make(9000)), "en", "s", 0)]
    return rows


def tokens(t):
    return re.findall(r"\w+", (t or "").lower())


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit("clash")).withColumn("key", F.lit(1)).repartition(4)


def test_passages_equal_brute_force(spark, docs, rows):
    span = 50
    seen, texts = Counter(), set()
    for d, t, *_ in rows:
        if t is not None:
            texts.add((d, t))
    for _, t in texts:
        w = tokens(t)
        seen.update(tuple(w[i : i + span]) for i in range(len(w) - span + 1))
    want = set()
    for d, t in texts:
        w, cover = tokens(t), []
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i : i + span])] > 1:
                if cover and i <= cover[-1][1]:
                    cover[-1][1] = i + span
                else:
                    cover.append([i, i + span])
        want |= {(d, a, b - a) for a, b in cover}
    got = suffixes.repeated_passages(docs).collect()
    assert {(r.doc_id, r.start_word, r.n_words) for r in got} == want and len(got) == len(want)
    by = {d: t for d, t in texts}
    for r in got:
        assert len(tokens(by[r.doc_id][r.start_char : r.end_char])) == r.n_words
    # any number of batches gives the same passages
    one = suffixes.repeated_passages(docs, batches=7).collect()
    assert sorted(map(str, one)) == sorted(map(str, got))


def test_levels_merge_like_a_binary_counter(spark, docs):
    family = suffixes.SuffixFamily(spark)
    batch = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text").where("text is not null")
    ranks = []
    for i in range(5):
        family.add(batch.where(F.pmod("rid", F.lit(5)) == i))
        ranks.append([r for r, _, _ in family.levels])
        for _, t, _ in family.levels:
            assert spark.table(t).groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("n")).where("c > 1 or n > 2").count() == 0
    keys = suffixes.seeds(batch).distinct().groupBy("key").agg(F.least(F.count("*"), F.lit(2)).alias("n"))
    first = spark.table(family.levels[0][1]).select("key")
    old = suffixes.seeds(batch.where(F.pmod("rid", F.lit(5)) < 4)).select("key").distinct()
    assert first.exceptAll(old).count() == old.exceptAll(first).count() == 0 and keys.count() >= first.count()
    family.close()
    assert ranks == [[0], [1], [1, 0], [2], [2, 0]]


def test_a_family_goes_on_in_a_later_call(spark, docs, tmp_path):
    """Three batches, each by a family opened anew, give what one call gives."""
    folder = (tmp_path / "family").as_uri()
    parts = [docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(3)) == i) for i in range(3)]
    ranks = []
    for part in [*parts, parts[0]]:
        family = suffixes.SuffixFamily(spark, folder=folder)
        family.append(part)
        ranks.append([r for r, _, _ in family.levels])
        family.close()
    family = suffixes.SuffixFamily(spark, folder=folder)
    got = family.passages().collect()
    family.close()
    assert ranks == [[0], [1], [1, 0], [2]]
    assert sorted(map(str, got)) == sorted(map(str, suffixes.repeated_passages(docs).collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffix_")]
    with pytest.raises(ValueError):
        suffixes.SuffixFamily(spark, span=60, folder=folder)


def test_passages_in_very_long_texts(spark):
    words = [f"w{i}" for i in range(150000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[120000:120070])), (3, " ".join(words[:49]))]
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words) for r in got) == [(1, 120000, 70), (2, 0, 70)]


def test_near_pairs_recall_and_groups(spark, docs, rows):
    have = [(d, t) for d, t, *_ in rows if tokens(t)]
    s, _ = simhash.simhashes(pa.array([t for _, t in have]))
    parent = list(range(len(have)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(have)):
        near = simhash._near(s.T, i, np.arange(len(have)), simhash.RADIUS, simhash.VERIFY)
        for j in np.flatnonzero(near):
            parent[root(int(j))] = root(i)
    groups = {}
    for i in range(len(have)):
        groups.setdefault(root(i), []).append(have[i][0])
    want = sorted(sorted(map(str, g)) for g in groups.values() if len(g) > 1)
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r.group_id, []).append(str(r.doc_id))
        assert r.group_size > 1 and 1 <= r.n_links < r.group_size
    assert sorted(sorted(g) for g in got.values()) == want


def test_deduplication_keeps_one_of_each_group(spark, docs, rows):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    near = simhash.near_duplicates(docs).collect()
    gone = {r.doc_id for r in near if r.doc_id != r.group_id}
    assert Counter(ids) == Counter({d for d, *_ in rows} - gone)


def test_forest_recall_over_signatures(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (400, 128), dtype=np.uint8)
    s = [base]
    for d in (5, 10, 20):
        x = base.copy()
        for row in x:
            row[rng.permutation(128)[:d]] ^= 1
        s.append(x)
    packed = np.packbits(np.concatenate(s), axis=1).view(np.uint64)
    want = {(i, int(j)) for i in range(len(packed)) for j in np.flatnonzero(np.bitwise_count(packed ^ packed[i]).sum(1) <= 20) if i < j}
    nodes = spark.createDataFrame([(i, 1, *map(int, r.view(np.int64)), 0, 0) for i, r in enumerate(packed)], "nid long, n long, s0 long, s1 long, s2 long, s3 long")
    links = {i: sum(1 for p in want if i in p) for i in range(len(packed))}
    group = labels_of(want, len(packed))
    # as it is; most buckets too dense for level 0; chunks at the last level, too
    few = [simhash.level(0, depth=5), simhash.level(1, depth=8)]
    for dense, levels in ((simhash.DENSE, None), (40, few), (4, few)):
        got = simhash.forest(nodes, dense=dense, levels=levels).collect()
        have = {}
        for r in got:
            if r.b is None:
                have[r.a] = have.get(r.a, 0) + r.links
        assert all(have[i] <= links[i] for i in have) and sum(have.values()) >= 0.97 * sum(links.values())
        mine = labels_of([(r.a, r.b) for r in got if r.b is not None], len(packed))
        assert np.mean(mine == group) >= 0.97


def labels_of(pairs, n):
    label = np.arange(n)
    if pairs:
        simhash._merge(label, *map(np.array, zip(*sorted(pairs))))
    return label


def test_mixed_density_keeps_its_recall(spark):
    """A dense region beside a sparse one, each against all pairs."""
    rng = np.random.default_rng(9)
    far = rng.integers(0, 2, (500, 128), dtype=np.uint8)
    near = np.repeat(rng.integers(0, 2, (1, 128), dtype=np.uint8), 700, 0)
    near ^= rng.random((700, 128)) < 0.12
    twins = np.concatenate([far, near])[rng.permutation(1200)[:400]].copy()
    for row in twins:
        row[rng.permutation(128)[: rng.integers(1, 21)]] ^= 1
    bits = np.concatenate([far, near, twins])
    packed = np.packbits(bits, axis=1).view(np.uint64)
    want = {(i, int(j)) for i in range(len(packed)) for j in np.flatnonzero(np.bitwise_count(packed ^ packed[i]).sum(1) <= 20) if i < j}
    nodes = spark.createDataFrame([(i, 1, *map(int, r.view(np.int64)), 0, 0) for i, r in enumerate(packed)], "nid long, n long, s0 long, s1 long, s2 long, s3 long")
    counts = []
    for dense, levels in ((4096, None), (60, [simhash.level(0, depth=6), simhash.level(1, depth=11)])):
        got = simhash.forest(nodes, dense=dense, levels=levels).where("b is null").agg(F.sum("links")).first()[0]
        counts.append(got)
        assert 0.95 * 2 * len(want) <= got <= 2 * len(want)


def test_links_are_counted_once(spark):
    rows = [(i, "one two three four five six seven eight nine ten " * 4 + str(i % 3)) for i in range(9)] + [(20, "else where is nothing near to this text at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s, _ = simhash.simhashes(pa.array([t for _, t in rows]))
    want = {rows[i][0]: int(simhash._near(s.T, i, np.arange(len(rows)), simhash.RADIUS, simhash.VERIFY).sum()) - 1 for i in range(len(rows))}
    assert {r.doc_id: r.n_links for r in simhash.near_duplicates(docs).collect()} == {d: n for d, n in want.items() if n}


def test_components_of_long_paths_and_hubs(spark):
    rnd = random.Random(2)
    ids = rnd.sample(range(10**6), 600)
    edges = [(ids[i], ids[i + 1]) for i in range(99)] + [(ids[100], x) for x in ids[101:400]] + list(zip(ids[400:500], ids[500:]))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    want = {}
    for group in [ids[:100], ids[100:400], *map(list, zip(ids[400:500], ids[500:]))]:
        want |= {x: min(group) for x in group}
    assert got == want


def leaks(rows, items, least=13):
    out = set()
    for d, t, *_ in rows:
        w = tokens(t)
        for item, text in set(items):
            v = tokens(text)
            for i in range(len(w)):
                for j in range(len(v)):
                    if w[i] == v[j] and (i == 0 or j == 0 or w[i - 1] != v[j - 1]):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        if n >= least:
                            out.add((d, item, i, n))
    return out


def test_leaks_equal_brute_force(spark, rows):
    rnd = random.Random(4)
    rows = [r for r in rows if r[1] is None or len(r[1]) < 3000][:70]
    items = []
    for k in range(25):
        w = tokens(rows[rnd.randrange(len(rows))][1])
        at = rnd.randint(0, max(0, len(w) - 30))
        items.append((k, " ".join(w[at : at + rnd.randint(8, 30)]).upper()))
    items += [(25, None), (26, ""), items[3], (None, items[4][1])]
    docs = spark.createDataFrame([*rows, (900, "x " + items[2][1].replace(" ", " -- ") + " y", "", "", 0)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks([*rows, (900, "x " + items[2][1] + " y")], [(i, t) for i, t in items if t])
    for part in (32 << 20, 200):
        got = decontaminate.contaminated(docs, bench, part).collect()
        assert {(r.doc_id, r.item_id, r.n_words) for r in got} == {(d, i, n) for d, i, _, n in want}
    texts = {d: t for d, t, *_ in rows}
    for r in got:
        if r.doc_id in texts and r.doc_id is not None:
            assert len(tokens(texts[r.doc_id][r.start_char : r.end_char])) == r.n_words
    for part in (32 << 20, 200):
        kept = decontaminate.decontaminated(docs.withColumn("rid", F.lit("x")).withColumn("key", F.lit(2)), bench, part)
        assert kept.columns == [*docs.columns, "rid", "key"]
        assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, *_ in [*rows, (900,)] if d not in {x for x, *_ in want})


def test_leaks_in_very_long_texts(spark):
    words = [f"w{i}" for i in range(200000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:12])), (2, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words[150000:150040])), (8, " ".join(words[199990:]))], "item_id long, text string")
    for part in (32 << 20, 10):
        got = decontaminate.contaminated(docs, bench, part).collect()
        assert [(r.doc_id, r.item_id, r.n_words, r.item_words) for r in got] == [(1, 7, 40, 40)]
        assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, bench, part).collect()) == [2, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffixes.repeated_passages(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.deduplicated(none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for b, part in ((bench, 32 << 20), (one, 0)):
        assert decontaminate.contaminated(none, b, part).count() == decontaminate.decontaminated(none, b, part).count() == 0
