"""Line dedup: short places for ids of 32 bits, wide ones else; marks of many lines."""

import random

from chronogrid.llm import line_dedup as L

SCHEMA = "doc_id long, text string"


def _rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    line = lambda: " ".join(rng.sample(words, rng.randint(4, 9)))
    old = [line() for _ in range(40)]
    some = lambda: rng.choice(["", " \t", line(), line(), rng.choice(old), " ".join(rng.choice(old).split()[1:] + ["w1"])])
    return [(i, "\n".join(some() for _ in range(n))) for i, n in [(-3, 5), (-2, 64), (-1, 65), (0, 200), (1, 63), (2, 1), (7, 130), (9, 1)]]


def test_wide_and_short_places_agree(spark, monkeypatch):
    rows = _rows()
    kinds = []
    classes = L._classes
    monkeypatch.setattr(L, "_classes", lambda *a: kinds.append(dict((out := classes(*a)).dtypes)["at"]) or out)
    lines = [(i, k, set(s.split())) for i, t in rows for k, s in enumerate(t.split("\n"))]
    gone = {(i, k) for n, (i, k, a) in enumerate(lines) if a and any(100 * len(a & b) >= 80 * len(a | b) for _, _, b in lines[:n])}
    want = {i: "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    for shift in (0, 1 << 40, -(1 << 50)):
        docs = spark.createDataFrame([(i + shift, t) for i, t in rows], SCHEMA)
        assert {(r.doc_id - shift, r.line_no) for r in L.removed_lines(docs).collect()} == gone
        assert {r.doc_id - shift: r.text for r in L.dedup_lines(docs).collect()} == want
    assert len(gone) >= 100 and kinds[0] == kinds[1] == "bigint" and all(k.startswith("decimal") for k in kinds[2:])


def test_the_ends_of_short_places(spark):
    rows = [(-(1 << 31), "a b c d"), ((1 << 31) - 1, "a b c d\ne f g h\n\nh g f e"), (0, "d c b a\ni")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, L.removed_lines(docs).collect())) == [(0, 0), ((1 << 31) - 1, 0), ((1 << 31) - 1, 3)]


def test_postings_are_dealt_once(spark):
    docs = L._keyed(spark.createDataFrame(_rows(), SCHEMA))
    classes = L._classes(L._sets(L._hashed(docs), L._array([0] * L.BUCKETS, "int"), 80), L._NARROW)
    met = L._involved(L.cut(classes, "test-classes"), 80)
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ReusedExchange") == 1
