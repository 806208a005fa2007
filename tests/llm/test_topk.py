import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import topk as K


def brute(ids, x, own, q, k):
    held = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    s = sorted((-held(sum(int(a) * int(b) for a, b in zip(v, q, strict=True))), int(i)) for i, v in zip(ids, x, strict=True) if i != own)
    return [(i, -s_) for s_, i in s[:k]]


@pytest.mark.parametrize("seed, scale", [(1, 3), (2, 500), (3, 1 << 40)])
def test_threshold_algorithm_against_brute_force(seed, scale):
    rng = np.random.default_rng(seed)
    ids, x = np.arange(300) * 3, np.floor(rng.normal(0, scale, (300, 7)))
    x[::17] = x[0]
    lists = K.SortedLists(ids, x)
    for q in [*x[:20], np.zeros(7), -x[3]]:
        for k in (1, 10, 400):
            found, scores = lists.search(0, q, k, step=2)
            got = list(zip(found.tolist(), map(int, scores)))
            want = [(i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for i, s in brute(ids, x, 0, q, k)]
            assert got == want


@pytest.mark.parametrize("scale", [1, 1 << 30, 1 << 45])
def test_ties_at_a_negative_kth_score(scale):
    ids, x = np.random.default_rng(4).permutation(1000), np.full((1000, 2), -2000.0) * scale
    lists = K.SortedLists(ids, x)
    for q in (np.array([2000.0, 1.0]) * scale, np.array([2000.0, 0.0]) * scale):
        assert lists.search(-1, q, 10)[0].tolist() == list(range(10))
    rng = np.random.default_rng(5)
    x = -np.floor(rng.uniform(1, 4, (2000, 3))) * scale
    lists = K.SortedLists(np.arange(2000), x)
    for q in np.floor(rng.uniform(1, 4, (20, 3))) * scale:
        got = lists.search(7, q, 10)
        assert list(zip(got[0].tolist(), map(int, got[1]))) == brute(np.arange(2000), x, 7, q, 10)


def test_stops_early_where_it_can():
    x = np.zeros((5000, 2))
    x[:, 0], x[:, 1] = np.arange(5000), 1
    met = []
    lists = K.SortedLists(np.arange(5000), x)
    score = lists._scores
    lists._scores = lambda rows, q: met.append(len(rows)) or score(rows, q)
    lists.search(-1, np.array([1.0, 0.0]), 5)
    assert sum(met) < 100


def test_search_all_with_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (7, [0.9, 0.1]), (7, [0.9, 0.1]), (8, None), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [None, 1.0]), (12, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (100, [0.5, 0.5]), (200, []), (300, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in K.search_all(df, F.col("vec_id") % 100 == 0, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == {0: [(1, 7, 943104), (2, 7, 943104), (3, 100, 524288)], 100: [(1, 0, 524288), (2, 7, 523776), (3, 7, 523776)], 200: [(1, 300, 0)], 300: [(1, 200, 0)]}
    assert K.search_all(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
