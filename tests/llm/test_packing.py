import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.llm import packing as P
from tests.llm.test_copies import SCHEMA, corpus


def sketched(texts):
    m, n = P.minima(pa.array(texts))
    return np.ascontiguousarray(P.packed(m).T), n


def families(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    out = []
    for _ in range(n):
        base = rnd.choices(vocab, k=150)
        for _ in range(rnd.randint(1, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, 22)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            out.append(" ".join(w))
    return out


def test_resemblance_tells_shared_shingles():
    a = families(1, 40)
    s, _ = sketched(a)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(148)} for t in a]
    err = []
    for i in range(len(a)):
        for j in range(i):
            true = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            err.append(abs((int(P.equal_bins(s, i, np.array([j]))[0]) / 64 - 1 / 16) * 16 / 15 - true))
    assert np.mean(err) < 0.04 and max(err) < 0.4


def true_resemblance(texts):
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    return lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])


def graph(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    sk = P.sketches(docs)
    ids = {r.nid: r.doc_id for r in sk.select("nid", "doc_id").collect()}
    nodes = sk.groupBy("nid", "s0", "s1", "s2", "s3").agg(F.min("m").alias("m"))
    out = {}
    for r in P.neighbours(nodes, **options).collect():
        out.setdefault(ids[r.a], []).append(ids[r.b])
    return ids.values(), out


def test_recall_of_nearest_neighbours(spark):
    """Near copies, in small buckets and in ones that have to be split."""
    texts = families(2, 120)
    r = true_resemblance(texts)
    for dense in (P.DENSE, 4):
        ids, got = graph(spark, texts, dense=dense)
        want = right = 0
        for i in ids:
            best = sorted((r(i, j) for j in ids if j != i), reverse=True)[: P.NEIGHBOURS]
            have = sorted((r(i, j) for j in got.get(i, [])), reverse=True)
            assert len(have) <= P.NEIGHBOURS
            for k, x in enumerate(best):
                if x >= 0.35:
                    want += 1
                    right += k < len(have) and have[k] >= x - 0.12
        assert want > 200 and right >= 0.9 * want


def test_documents_that_share_a_passage_are_neighbours(spark):
    """What deduplication leaves: texts alike in one passage only."""
    rnd = random.Random(21)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    passages = [rnd.choices(vocab, k=40) for _ in range(60)]
    texts = []
    for i in range(240):
        w = rnd.choices(vocab, k=110)
        at = rnd.randrange(110)
        texts.append(" ".join(w[:at] + passages[i % 60] + w[at:]))
    r = true_resemblance(texts)
    ids, got = graph(spark, texts)
    best = {i: max(r(i, j) for j in ids if j != i) for i in ids}
    assert 0.1 < sum(best.values()) / len(best) < 0.35
    assert sum(any(r(i, j) >= 0.8 * best[i] for j in got.get(i, [])) for i in ids) >= 0.9 * len(best)


def in_common_keys(seed=31, n=700):
    """Texts that share one short passage and nothing else: keys that more than 256 nodes have, near only by it."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    everywhere = rnd.choices(vocab, k=30)
    return [" ".join(rnd.choices(vocab, k=20) + everywhere + rnd.choices(vocab, k=rnd.randint(5, 30))) for _ in range(n)]


def nearest_by_brute_force(rows, k=P.NEIGHBOURS):
    """(a, b, equal): the k nearest of all nodes (nid, s0..s3, m) that have one of a's keys; and the size of the largest key."""
    s = np.array([[r.s0, r.s1, r.s2, r.s3] for r in rows], dtype=np.int64).T.copy().view(np.uint64)
    nid, keys, has = [r.nid for r in rows], [set(r.m) for r in rows], {}
    for i, own in enumerate(keys):
        for key in own:
            has.setdefault(key, set()).add(i)
    want = set()
    for i, own in enumerate(keys):
        others = sorted(set().union(*(has[key] for key in own)) - {i})
        best = sorted((-int(e), nid[j]) for e, j in zip(P.equal_bins(s, i, np.array(others, dtype=np.int64)), others))[:k]
        want |= {(nid[i], b, -e) for e, b in best}
    return want, max(map(len, has.values()))


def test_neighbours_in_common_keys_equal_brute_force(spark):
    """No candidate is lost in a key of many nodes, whole or in pairs of chunks."""
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(in_common_keys())], SCHEMA)
    nodes = P.sketches(docs).groupBy("nid", "s0", "s1", "s2", "s3").agg(F.min("m").alias("m")).cache()
    want, largest = nearest_by_brute_force(nodes.collect())
    assert largest > 256
    for dense in (P.DENSE, 100, 3):
        assert {(r.a, r.b, r.equal) for r in P.neighbours(nodes, dense=dense).collect()} == want
    nodes.unpersist()


def little_alike(seed=41, n=240):
    """Texts of which every four share a passage of some 15 words: many pairs agree in one or two minima only."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    passages = [rnd.choices(vocab, k=15) for _ in range(n // 4)]
    return [" ".join(rnd.choices(vocab, k=70) + passages[i % len(passages)] + rnd.choices(vocab, k=rnd.randint(40, 70))) for i in range(n)]


def nearest_of_all_pairs(texts, rows, k=P.NEIGHBOURS):
    """(a, b, equal): the k nearest of all texts that agree in any of the minima, by the texts themselves; ``rows`` only tell the nid."""
    m, _ = P.minima(pa.array(texts))
    s = P.packed(m)
    nid = {(r.s0, r.s1, r.s2, r.s3): r.nid for r in rows}
    nid = [nid[tuple(x)] for x in s.view(np.int64).tolist()]
    want, s = set(), np.ascontiguousarray(s.T)
    for i in range(len(texts)):
        others = [j for j in np.flatnonzero((m == m[i]).any(axis=1)) if j != i]
        best = sorted((-int(e), nid[j]) for e, j in zip(P.equal_bins(s, i, np.array(others, dtype=np.int64)), others))[:k]
        want |= {(nid[i], b, -e) for e, b in best}
    return want


def test_any_minimum_in_common_makes_candidates(spark):
    """No minimum is left out: neighbours equal those of all pairs, also where a pair agrees in one minimum only."""
    texts = little_alike()
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    nodes = P.sketches(docs).groupBy("nid", "s0", "s1", "s2", "s3").agg(F.min("m").alias("m")).cache()
    want = nearest_of_all_pairs(texts, nodes.collect())
    assert len(want) > 400
    for dense in (P.DENSE, 2):
        assert {(r.a, r.b, r.equal) for r in P.neighbours(nodes, dense=dense).collect()} == want
    nodes.unpersist()


def test_every_pair_of_a_key_meets_once(spark):
    rows = [(key, nid, n) for key, n in ((1, 2), (2, 5), (3, 41)) for nid in range(n)]
    got = {}
    for r in P.chunked(spark.createDataFrame(rows, "key long, nid long, n long"), 5).collect():
        got.setdefault(r.key, []).append((r.nid, r.side))
    pairs = [(a, b) for x in got.values() for a, s in x for b, z in x if a < b and (s < 0 or s != z)]
    assert sorted(pairs) == sorted((a, b) for n in (2, 5, 41) for b in range(n) for a in range(b))
    assert len(got[1]) == 2 and len(got[2]) == 5


def test_clusters_and_parts(spark):
    edges = [(i, i + 1) for i in range(0, 3)] + [(10, 11), (20, 21), (20, 22), (20, 23)]
    label, _ = P.clusters(spark.createDataFrame(edges, "a long, b long"), rounds=4)
    by = {r.nid: r.label for r in label.collect()}
    assert len({by[i] for i in (0, 1, 2, 3)}) == len({by[10], by[11]}) == len({by[20], by[21], by[22], by[23]}) == 1 and len(set(by.values())) == 3


def test_large_buckets_equal_small_ones():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 2**63, (4, 6), dtype=np.uint64)[:, rng.integers(0, 6, 300)]
    nid = rng.permutation(300)
    got = P.nearest_in(np.zeros(300, np.int64), s, nid, 3, 20)
    for i in range(0, 300, 17):
        e = P.equal_bins(s, i, np.arange(300))
        e[i] = -1
        want = sorted((-int(e[j]), int(nid[j])) for j in range(300) if e[j] >= 20)[:3]
        assert [(-int(x), int(nid[j])) for r, j, x in zip(*got) if r == i] == want


def test_walk_starts_at_low_degree_and_keeps_to_edges():
    a, b = np.array([1, 2, 3, 4, 3]), np.array([2, 3, 4, 5, 6])
    assert P.walk(a, b, np.array([30, 30, 40, 30, 50])).tolist() == [1, 2, 3, 6, 5, 4]
    rnd = random.Random(5)
    for _ in range(50):
        n = rnd.randint(2, 20)
        e = [(rnd.randrange(n), rnd.randrange(n), rnd.randint(25, 64)) for _ in range(30)]
        e = [x for x in e if x[0] != x[1]]
        if e:
            assert P.walk(*map(np.array, zip(*e))).tolist() == naive_walk(e)


def naive_walk(edges):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, set()).add((b, w))
        near.setdefault(b, set()).add((a, w))
    degree = {x: len(v) for x, v in near.items()}
    left, out = set(near), []
    while left:
        at = min(left, key=lambda x: (degree[x], x))
        while True:
            left.discard(at)
            out.append(at)
            on = [(-w, degree[b], b) for b, w in near[at] if b in left]
            if not on:
                break
            at = min(on)[2]
    return out


def test_windows_hold_every_character_once(spark):
    rows = corpus(7, 80) + [(900, "long word " * 30000, "", "", 0), (901, "!!!", "", "", 0), (902, "two words", "", "", 0), (903, "two words", "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("nid", "m", "part", "place", "label", "shard", "length")})
    for window, shard, part in ((700, 1 << 28, 1 << 14), (5000, 20000, 10)):
        got = P.packs(docs, window, shard, part).collect()
        used, lengths, order = {}, {}, {}
        for r in got:
            assert r.start_char < r.end_char
            used.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
            lengths[r.window_id] = lengths.get(r.window_id, 0) + r.end_char - r.start_char
            order.setdefault(r.window_id, []).append(r.slot)
        want = {}
        for d, t, *_ in rows:
            if t:
                want.setdefault(d, []).append(len(t))
        assert {d: sum(b - a for a, b in x) for d, x in used.items()} == {d: sum(x) for d, x in want.items()}
        assert all(sorted(x) == list(range(len(x))) for x in order.values())
        last = {}
        for w in lengths:
            last[w >> 32] = max(last.get(w >> 32, 0), w)
        assert all(n == window or w == last[w >> 32] for w, n in lengths.items())
    near = sorted((r.window_id, r.slot, r.doc_id) for r in P.packs(docs).collect())
    place = {d: i for i, (_, _, d) in enumerate(near)}
    assert abs(place[902] - place[903]) == 1
    assert P.packs(docs.limit(0)).count() == 0
