import numpy as np
import pytest
from pyspark.sql import types as T

from foliate.llm.topk import threshold_search, top_k

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("place", T.LongType()), T.StructField("score", T.LongType()), T.StructField("c", T.LongType())])


def brute(vectors, asked, k):
    out = []
    for q in asked:
        scores = vectors @ vectors[q]
        out.append([i for i in np.lexsort((np.arange(len(vectors)), -scores)) if i != q][:k])
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "sparse", "one_sided", "flat"])
@pytest.mark.parametrize("n", [1, 15, 900])
def test_threshold_search(kind, n):
    rng = np.random.default_rng(n)
    make = {"normal": lambda: rng.normal(0, 20, (n, 8)), "ties": lambda: rng.integers(-1, 2, (n, 3)), "sparse": lambda: rng.integers(-9, 9, (n, 30)) * (rng.random((n, 30)) < 0.1), "one_sided": lambda: rng.exponential(9, (n, 2)), "flat": lambda: np.zeros((n, 4))}
    v = np.floor(make[kind]()).astype(np.int64)
    asked = np.arange(0, n, 7)
    got = {q: i.tolist() for q, i, _ in threshold_search(v[asked], v, np.arange(n), asked, 5)}
    assert [got[i] for i in range(len(asked))] == brute(v, asked, 5)


def test_large_components_are_exact():
    v = np.array([[1 << 40, 1], [1 << 40, 2], [3, 3]], np.int64)
    (_, i, s), *_ = threshold_search(v[:1], v, np.arange(3), np.array([0]), 2)
    assert i.tolist() == [1, 2] and s.tolist() == [(1 << 80) + 2, 3 * (1 << 40) + 3]


def test_rows(spark):
    rng = np.random.default_rng(4)
    whole = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(0, 300)]
    odd = [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in whole + odd], ROWS).repartition(3)
    v = np.floor(64 * np.array([r[1] for r in whole], np.float32).astype(float)).astype(np.int64)
    for blocks in ({}, {"candidate_block": 50, "query_block": 4}):
        got = {}
        for r in top_k(df, **blocks).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        asked = list(range(0, 300, 20))
        want = {q: [(j + 1, int(i), int(v[i] @ v[q])) for j, i in enumerate(best)] for q, best in zip(asked, brute(v, asked, 20))}
        assert {q: sorted(x) for q, x in got.items()} == want


def test_repeated_short_and_few(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0], 0, 0, 0), (0, [1.0, 1.0], 0, 0, 0), (3, [1.0], 0, 0, 0), (5, [], 0, 0, 0)], ROWS)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df).collect())
    assert got == sorted([(0, 1, 0, 8192), (0, 2, 3, 4096), (0, 3, 5, 0)] * 2)
    assert top_k(spark.createDataFrame([], ROWS)).collect() == []
