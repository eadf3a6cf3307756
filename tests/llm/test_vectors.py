"""Vector searches against brute force."""

import numpy as np
import pytest

from chronogrid.llm import ann, mtree


def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def clusters(n, d, centers, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, d)) * 3
    return (c[rng.integers(0, centers, n)] + rng.normal(size=(n, d))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def exact_best(v, ids, q, k):
    s = [int(sum(int(a) * int(b) for a, b in zip(r, v[q]))) for r in v.tolist()]
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))[:k]
    return [(ids[i], s[i]) for i in order]


def test_exact_search(spark):
    x, df = table(spark)
    v = np.vstack((np.floor(1024 * x.astype(float)), np.zeros((1, 16))))
    ids = [*range(400), 1001]
    got = {}
    for r in mtree.top_k(df, df.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 400, 20):
        assert [got[q][i + 1] for i in range(5)] == exact_best(v, ids, q, 5)
    assert mtree.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_exact_search_of_several_trees_and_levels(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PER_PIVOT", 300)
    x = clusters(4000, 12, 15)
    x[100:160] = x[3]
    df = frame(spark, x)
    v = np.floor(1024 * x.astype(float))
    root = mtree.build(np.column_stack((v, np.zeros(4000))), np.arange(4000), np.append(v[0], 0), 0.0)
    depth = lambda n: 1 + max(map(depth, n.children), default=0)
    assert depth(root) >= 2
    got = {}
    for r in mtree.top_k(df, df.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    s = v @ v.T
    for q in range(0, 4000, 100):
        s[q, q] = -np.inf
        order = np.lexsort((np.arange(4000), -s[q]))[:10]
        assert [(i, int(s[q, k])) for _, i, k in [(0, int(o), o) for o in order]] == [(i, t) for _, i, t in sorted(got[q])]


@pytest.mark.parametrize("size", [5e3, 1e6])
def test_exact_search_of_large_components(spark, size):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 64)) * size
    x[10:20] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v, got = np.floor(1024 * x), {}
    for r in mtree.top_k(df, df.where("vec_id % 10 = 0"), 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 60, 10):
        want = [(i, max(-(1 << 63), min((1 << 63) - 1, s))) for i, s in exact_best(v, list(range(60)), q, 7)]
        assert [got[q][i + 1] for i in range(7)] == want


def test_repeated_ids_take_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (2, [0.1, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id = 2"), 10).collect())
    assert got == [(1, 1, 102 * 2048), (2, 0, 102 * 1024), (3, 0, 102 * 1024), (4, 1, 102 * 512)]
    assert [r.vec_id for r in ann.search(df, df.where("vec_id = 2"), 10).orderBy("rank").collect()] == [1, 0, 0, 1]


def test_approximate_search(spark):
    x, df = table(spark)
    x = x.astype(float)
    hit = total = 0
    got = ann.search(df, df.where("vec_id % 20 = 0"), 5).collect()
    for q in range(0, 400, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.sort(s)[-5]
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == 5 and all(r.vec_id < 400 for r in mine)
        hit += sum(r.score >= best - 1e-9 for r in mine)
        total += 5
    assert hit >= 0.9 * total
    assert ann.search(df.limit(0), df.limit(0), 5).count() == 0


def test_approximate_search_of_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 300)
    monkeypatch.setattr(ann, "LEAST", 200)
    x = clusters(6000, 24, 30)
    df = frame(spark, x)
    got, y = {}, x.astype(float)
    for r in ann.search(df, df.where("vec_id % 100 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 6000, 100):
        s = y @ y[q]
        s[q] = -np.inf
        assert len(got[q]) == 20 and all(abs(s[i] - t) < 1e-9 * abs(t) + 1e-9 for i, t in got[q])
        hit += len({i for i, _ in got[q]} & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.9 * 60 * 20
