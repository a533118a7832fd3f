"""The pipeline's stages and its end against brute force over a small corpus."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import langid, packing, pii, simhash
from tests.llm.test_copies import SCHEMA, corpus, leaks, tokens
from tests.llm.test_packing import in_common_keys, little_alike, nearest_by_brute_force, nearest_of_all_pairs


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rnd = random.Random(8)
    rows = [r for r in corpus(11, 70) if r[1] is None or len(r[1]) < 20000]
    items = [(k, " ".join(tokens(rows[k * 7][1])[:25])) for k in range(4)]
    base = rows[12][1]
    rows += [(500, f"{' '.join(''.join(rnd.choices('abcdefg', k=4)) for _ in range(60))} mail me at joe [at] x [dot] com or +1 (743) 555-3824", "en", "s", 5), (501, "zq xj 12", "en", "s", 8), (502, "12 34", None, None, None)]
    rows += [(600 + k, " ".join(rnd.sample(base.split(), len(base.split()))), "en", "s", 0) for k in range(2)] + [rows[3], rows[3]]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, c in enumerate(("rid", "key", "nid", "keep", "kind", "s0", "component", "first", "n", "rows", "spans")):
        docs = docs.withColumn(c, F.lit(k))
    docs.repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows, items


def near_groups(rows):
    have = [r for r in rows if tokens(r[1])]
    s, _ = simhash.simhashes(pa.array([r[1] for r in have]))
    todo, out = set(range(len(have))), []
    while todo:
        group, queue = [], [todo.pop()]
        while queue:
            i = queue.pop()
            group.append(i)
            near = {int(j) for j in np.flatnonzero(simhash._near(s.T, i, np.arange(len(have)), simhash.RADIUS, simhash.VERIFY))} & todo
            todo -= near
            queue += near
        out.append([have[i] for i in group])
    return out


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    d, rows, items = sf_dir
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    keep = {r.doc_id: r.keep for r in langid.languages(docs).collect()}
    assert not all(keep.values())
    want = [r for r in rows if keep[r[0]]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, d)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            # one of each group: the least doc_id, null last; wordless rows stay once
            order = lambda r: (r[0] is None, r[0] or 0)
            want = [min(g, key=order) for g in near_groups(want)] + [r for r in set(want) if not tokens(r[1])]
        elif k == 2:
            bad = {x[0] for x in leaks(want, items)}
            assert bad
            want = [r for r in want if r[0] not in bad]
        elif k == 3:
            want = [(r[0], pii.redact(r[1]) if r[1] is not None else None, *r[2:]) for r in want]
        got = Counter((r.doc_id, r.text) for r in docs.collect())
        assert got == Counter((r[0], r[1]) for r in want), name
    assert any("<EMAIL>" in (r[1] or "") for r in want)
    packs = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    used = Counter()
    for r in packs:
        used[r.doc_id] += r.end_char - r.start_char
    total = Counter()
    for r in want:
        total[r[0]] += len(r[1] or "")
    assert used == +total


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    d, _, _ = sf_dir
    a = sorted(map(str, corpus_pipeline.run(spark, d).collect()))
    assert a and a == sorted(map(str, corpus_pipeline.run(spark, d).collect()))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "simhash near-dedup", "benchmark decontamination", "PII", "packing"]


def test_packing_compares_all_that_share_a_passage(spark, monkeypatch):
    """The last stage loses no neighbour where more than 256 documents share a key."""
    got = []

    def seen(nodes, **options):
        edges = neighbours(nodes, **options)
        got.append((nodes.collect(), {(r.a, r.b, r.equal) for r in edges.collect()}))
        return edges

    neighbours = packing.neighbours
    monkeypatch.setattr(packing, "neighbours", seen)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(in_common_keys())], SCHEMA)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    ((nodes, edges),) = got
    want, largest = nearest_by_brute_force(nodes)
    assert largest > 256 and edges == want
    assert sum(r.end_char - r.start_char for r in pieces) == docs.agg(F.sum("n_chars")).first()[0]


def test_packing_relates_all_that_agree_in_any_minimum(spark, monkeypatch):
    """The last stage has the neighbours of all pairs of texts, also of those that are little alike."""
    got = []

    def seen(nodes, **options):
        edges = neighbours(nodes, **options)
        got.append((nodes.collect(), {(r.a, r.b, r.equal) for r in edges.collect()}))
        return edges

    neighbours = packing.neighbours
    monkeypatch.setattr(packing, "neighbours", seen)
    texts = little_alike()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    ((nodes, edges),) = got
    assert edges == nearest_of_all_pairs(texts, nodes)
    assert sum(r.end_char - r.start_char for r in pieces) == sum(map(len, texts))
