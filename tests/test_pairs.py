import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.functions import similarity as S
from loomtext.functions import text as T
from loomtext.operators import pairs, svm


def test_blocks_equal_brute_force():
    rnd = random.Random(2)
    for chars, most in (("ab", 20), ("abcé😀\0", 70), ("abcdefgh", 150)):
        made = lambda n: ["".join(rnd.choices(chars, k=rnd.randint(0, most))) for _ in range(n)]  # noqa: B023, E731
        texts, queries = [*made(20), "", "a"], [*made(4), "", "xyz" * 30]
        texts += texts[:2] + [queries[0] + "a", queries[0][1:]]
        seen = set()
        for mine, others, which, block in S.blocks(queries, texts):
            got = block.common_substring()[:, which], block.common_subsequence()[:, which]
            for i, q in enumerate(mine):
                for j, t in enumerate(others):
                    assert [g[i, j] for g in got] == [S.common_substring(queries[q], texts[t]), S.common_subsequence(queries[q], texts[t])], (queries[q], texts[t])
                    seen.add((int(q), int(t)))
        assert len(seen) == len(queries) * len(texts)


def test_edits_of_blocks_equal_the_columns(spark):
    rnd = random.Random(5)
    made = lambda n, most: ["".join(rnd.choices("abé😀", k=rnd.randint(0, most))) for _ in range(n)]
    texts = [*made(10, 12), *made(10, 150), "", "a" * 100, "a" * 95 + "b" * 5]
    texts += [t[:-1] for t in texts[:20]] + [t[1:] + "x" for t in texts[:20]]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame([(x, y) for x in texts for y in texts if x or y], "a string, b string")
    want = {(r.a, r.b): tuple(r)[2:] for r in df.select("a", "b", T.edit_distance(a, b), F.round(T.likeliness(a, b), 9), T.alike(a, b)).collect()}
    for mine, others, which, block in S.blocks(texts, texts):
        got = [m[:, which].tolist() for m in (block.edit_distance(), block.likeliness(9), block.alike())]
        for i, q in enumerate(mine):
            for j, t in enumerate(others):
                if texts[q] or texts[t]:
                    assert tuple(g[i][j] for g in got) == want[texts[q], texts[t]], (texts[q], texts[t])


def test_every_query_meets_every_row_of_its_key_once(spark):
    rows = [(f"h{i % 3}" if i % 7 else None, i, f"text {i % 5}" if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame([*rows, rows[1]], "key string, id long, value string")
    length = lambda b: [b.lengths[:, None] + b.tree.lengths]
    x = pairs.text_search(df.where("id % 4 = 0"), df, length, "n int", most_queries=5, most_rows=20)
    ok = [r for r in [*rows, rows[1]] if r[0] is not None and r[2] is not None]
    want = sorted((q[1], r[1], len(q[2]) + len(r[2])) for q in ok if q[1] % 4 == 0 for r in ok if q[0] == r[0] and q[1] != r[1])
    assert sorted(tuple(r) for r in x.collect()) == want


@pytest.fixture(scope="module")
def one_host(spark, tmp_path_factory):
    """A folder with 6,000 pages of one host and two of others."""
    d = str(tmp_path_factory.mktemp("host"))
    url = F.concat(F.lit("http://one.example/"), F.element_at(F.array(F.lit("en"), F.lit("fr/a")), (F.col("id") % 2 + 1).cast("int")), F.lit("/"), (F.col("id") * 7919 % 100003).cast("string"), F.when(F.col("id") % 3 == 0, ".html").otherwise(""))
    url = F.when(F.col("id") < 6000, url).otherwise(F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".example/")))
    spark.range(6002).select(F.col("id").alias("page_id"), url.alias("url"), F.lit("").alias("html")).coalesce(1).write.parquet(f"{d}/pages.parquet")
    return d


def search_of_one_host(spark, d, name, value):
    """The whole search: no task has more than half of its rows, and they are right."""
    x = entry.queries()[name](spark, d).cache()
    parts = [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 300 * 5999 == x.select("a", "b").distinct().count() and max(parts) * 2 < sum(parts)
    url = {r.page_id: r.url for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    some = x.where(F.xxhash64("a", "b") % 20000 == 0).collect()
    assert len(some) > 20
    for r in some:
        assert r.a % 20 == 0 and tuple(r)[2:] == value(url[r.a], url[r.b]), (url[r.a], url[r.b])
    x.unpersist()


def test_common_lengths_of_a_large_host(spark, one_host):
    search_of_one_host(spark, one_host, "common_lengths", lambda a, b: (S.common_substring(a, b), S.common_subsequence(a, b)))


def test_common_substrings_of_a_large_host(spark, one_host):
    search_of_one_host(spark, one_host, "common_substrings", lambda a, b: (S.common_substring(a, b),))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j + 1] + 1, row[j] + 1, before[j] + (x != y)))
    return row[-1]


def test_edit_distance_pairs_of_a_large_host(spark, one_host):
    search_of_one_host(spark, one_host, "edit_distance_pairs", lambda a, b: (edits(a, b),))


def test_likeliness_pairs_of_a_large_host(spark, one_host):
    search_of_one_host(spark, one_host, "likeliness_pairs", lambda a, b: (round(1 - edits(a, b) / max(len(a), len(b)), 9),))


def test_alike_pairs_of_a_large_host(spark, one_host):
    alike = lambda a, b: a.startswith(b) or a.endswith(b) or (10 * len(a) >= 9 * len(b) and 10 * len(b) >= 9 * len(a) and edits(a, b) <= len(b) // 10)
    search_of_one_host(spark, one_host, "alike_pairs", lambda a, b: (alike(a, b),))


def test_addresses_without_a_common_character_are_no_rows(spark, tmp_path):
    spark.createDataFrame([(20, "abc"), (21, "xyz"), (22, "za"), (23, "")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in entry.queries()["common_substrings"](spark, str(tmp_path)).collect()] == [(20, 22, 1)]


def test_kernel_table_goes_to_many_tasks_and_keeps_odd_vectors(spark):
    x = np.random.default_rng(4).random((5000, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").coalesce(1)
    got = svm.kernel_table(df, df.where("id % 20 = 0"), 0.7, most_columns=100).cache()
    parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 5000 * 250 == got.select("row", "column").distinct().count() and max(parts) * 2 < sum(parts)
    k = svm.kernel_matrix(x, x[::20], svm.Parameter(gamma=0.7))
    assert all(abs(r.value - k[r.row, r.column // 20]) < 1e-12 for r in got.where("row % 50 = 7").collect())
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [1.0]), (5, []), (6, [])], "id int, features array<double>")
    pairs_ = odd.alias("x").crossJoin(odd.alias("y")).select(F.col("x.id").alias("row"), F.col("y.id").alias("column"), svm.rbf(F.col("x.features"), F.col("y.features"), 0.7).alias("value"))
    assert sorted(map(tuple, svm.kernel_table(odd, odd, 0.7).collect())) == sorted(map(tuple, pairs_.collect()))
