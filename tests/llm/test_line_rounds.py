"""Line dedup verifies all partners of a class that has few in one go, and those of others afterwards."""

import random

from chronogrid.llm import line_dedup as L


def _docs(spark):
    """Families of similar lines, unlike ones among them, in shuffled order."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    lines = []
    for _ in range(30):
        base = rng.sample(words, rng.randint(10, 24))
        for _ in range(12):
            out = [w for w in base if rng.random() > 0.1]
            lines.append(" ".join(out + rng.sample(words, rng.randint(0, 2))))
    rng.shuffle(lines)
    sets = [set(x.split()) for x in lines]
    want = {i for i, a in enumerate(sets) if any(100 * len(a & b) >= 80 * len(a | b) for b in sets[:i])}
    return spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), want


def test_rounds(spark, monkeypatch):
    docs, want = _docs(spark)
    made = []
    cut = L.cut
    monkeypatch.setattr(L, "cut", lambda df, name: made.append(name) or cut(df, name))
    monkeypatch.setattr(L, "LEADERS", 1)
    assert {r.doc_id for r in L.removed_lines(docs).collect()} == want and 60 < len(want) < 350
    assert made.count("lines-similar") == 2  # the nearest of the first, all others
    made.clear()
    monkeypatch.setattr(L, "TRIED", 1)  # some have more partners than are tried
    assert {r.doc_id for r in L.removed_lines(docs).collect()} == want
    assert made.count("lines-similar") == 3


def test_hashes_are_written_as_plain_lists(spark, monkeypatch):
    seen = {}
    cut = L.cut
    monkeypatch.setattr(L, "cut", lambda df, name: seen.setdefault(name, spark.conf.get(L._PLAIN_LISTS)) and cut(df, name))
    L._marks(L._keyed(spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")), 80).collect()
    assert seen["lines-hashes"] == "true" and seen["lines-classes"] == "false" == spark.conf.get(L._PLAIN_LISTS)
