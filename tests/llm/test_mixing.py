"""Mixing: the dual against a brute-force solution, copies, odd tables."""

import random

import numpy as np
import pytest

from chronogrid.llm import mixing


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, __size string, __s int, copies int")


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.8))), rng.choice("aaaaabbcd"), "keep", 7, -1) for i in range(600)]
    rows += [(700, None, "a", None, None, None), (701, "", None, "x", 1, 2), (702, "w " * 3_000, "a", "x", 1, 2), (5, rows[5][1], rows[5][2], "keep", 7, -1), (None, "w w w", None, "q", 1, 1)]
    return rows


def test_dual_solution(spark, table):
    """Brute force: the whole dual with its full Hessian, over documents."""
    decided, sources = mixing.mix(docs_of(spark, table))
    got = {r["__s"]: r for r in sources.collect()}
    names = sorted(got)
    size = np.array([len((t or "").split()) for _, t, *_ in table], float)
    a = np.array([[float(("n" if s is None else "s" + s) == k) for k in names] for _, _, s, *_ in table])
    target = np.array([got[k].target for k in names])
    l = np.zeros(len(names))
    for _ in range(200):
        mass = size * np.exp(a @ l)
        l -= np.linalg.solve(a.T @ (a * mass[:, None]), a.T @ mass - target)
    for k, x in zip(names, l):
        assert got[k].rate == pytest.approx(np.exp(x), rel=1e-9)
    taken = {}
    for r in decided.collect():
        assert 0 <= r.copies <= 3
        taken[r["__s"]] = taken.get(r["__s"], 0) + r.copies * r["__size"]
    for k in names:
        assert taken[k] == pytest.approx(got[k].target, rel=0.02, abs=20)


def test_many_sizes_are_decided_in_blocks(spark):
    rows = [(i, "w " * (i + 1), "a" if i % 3 else "b", "", 0, 0) for i in range(1200)]
    decided, sources = mixing.mix(docs_of(spark, rows))
    taken = {}
    for r in decided.collect():
        taken[r["__s"]] = taken.get(r["__s"], 0) + r.copies * r["__size"]
    for r in sources.collect():
        assert taken[r["__s"]] == pytest.approx(r.target, rel=1e-3)


def test_clashing_columns_and_reruns(spark, table):
    docs = docs_of(spark, table)
    got = mixing.mix_sources(docs)
    assert got.columns == docs.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert set(rows) <= set(map(tuple, docs.collect()))
    assert rows == sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect()), key=str)


def test_empty_tables(spark, table):
    docs = docs_of(spark, table)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    blank = docs_of(spark, [(1, None, "a", "", 0, 0), (2, " ", None, "", 0, 0)])
    assert mixing.mix(blank)[0].count() == 2
