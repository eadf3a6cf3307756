"""Line dedup splits and hashes words once; lines of few and many words compare exactly."""

import random

from chronogrid.llm import line_dedup as L


def _lines(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for k in range(160):  # a line, and another of a size on the other side of FOLD or not
        base = rng.sample(words, rng.randint(L.FOLD - 6, L.FOLD + 6))
        other = [w for w in base if rng.random() > 0.08] + rng.sample(words, rng.randint(0, 8))
        out += [" ".join(base), " ".join(rng.sample(other, len(other)))]
    rng.shuffle(out)
    return out


def test_lines_around_the_folded_size(spark):
    lines = _lines(spark)
    sets = [set(x.split()) for x in lines]
    want = {i for i, a in enumerate(sets) if any(100 * len(a & b) >= 80 * len(a | b) for b in sets[:i])}
    sizes = {len(a) <= L.FOLD for a in sets}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id for r in L.removed_lines(docs).collect()} == want and sizes == {True, False} and 40 < len(want) < 160


def test_folded_places_never_exceed_what_differs(spark):
    lines = _lines(spark)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = L._sets(L._hashed(docs), L._array([0] * L.BUCKETS, "int"), 80)
    far = sets.alias("x").crossJoin(sets.alias("y")).selectExpr("x.doc_id", "y.doc_id", f"{L._far('x', 'y')} as far").collect()
    words = [set(x.split()) for x in lines]
    assert all(f <= len(words[a] ^ words[b]) for a, b, f in far)


def test_words_are_split_once(spark, monkeypatch):
    made = []
    cut = L.cut
    monkeypatch.setattr(L, "cut", lambda df, name: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df, name))
    before = spark.conf.get(L._FAST_MAP)
    L._marks(L._keyed(spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")), 80).collect()
    plans = dict(made)
    assert "split" in plans["lines-hashes"] and "split" not in plans["lines-classes"]
    assert spark.conf.get(L._FAST_MAP) == before
