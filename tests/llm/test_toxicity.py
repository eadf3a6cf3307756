"""The toxicity grammar: machines, composition, flips, held-out rows, odd tables."""

import itertools

import pytest

from chronogrid.llm import toxicity as T


def bare():
    return T.Model(T.Lexicon({}, {}, set()), dict(T.PRIOR), T.BASE, T.MANY)


def test_composition_equals_one_machine_after_the_other():
    machines = [T.reporting(), T.negating(), T.aiming(), T.threatening(), T.weighing(T.PRIOR)]
    whole = T.grammar(T.PRIOR)
    for n in range(6):
        for symbols in itertools.product(T.CLASSES, repeat=n):
            tape, total = list(symbols), 0.0
            for m in machines:
                tape, w = m.run(tape)
                total += w
            assert whole.run(symbols) == (tape, pytest.approx(total))


def test_small_machines_compose():
    a = T.Transducer(0, {(0, "x"): (1, "y", 1.0), (1, "x"): (0, "z", 2.0)})
    b = T.Transducer("p", {("p", "y"): ("q", "Y", 10.0), ("q", "z"): ("p", "Z", 20.0)})
    both = T.compose(a, b, "x")
    assert both.run("xxx") == (["Y", "Z", "Y"], 44.0) and len(both.arcs) == 2


@pytest.mark.parametrize(
    "toxic, clean",
    [
        ("you are an idiot", "you are not an idiot"),
        ("you are an idiot", "he said you are an idiot"),
        ("i will kill you", "i will kill time"),
        ("i will kill you", "i will never kill you"),
        ("du bist ein trottel", "du bist kein trottel"),
        ("tu es un imbécile", "il dit tu es un imbécile"),
    ],
)
def test_context_flips_the_label(toxic, clean):
    m = bare()
    assert m.score(toxic) >= 0.5 > m.score(clean)
    flat = T.Model(m.lexicon, {p: T.PRIOR[T.plain(p)] for p in T.PATTERNS}, T.BASE, T.MANY)
    if "time" not in clean:  # without the marking machines nothing flips
        assert flat.score(clean) >= 0.5


def test_marks_end_with_the_clause():
    m = bare()
    assert m.score("not today. you idiot") >= 0.5 and m.score("i could kill. you") < 0.5


def test_held_out_rows_and_machines(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = T.fit(docs, labels)
    assert all(w >= 0 for w in model.weights.values())
    assert all(model.weights[p] <= T.DAMPED * model.weights[T.plain(p)] + 1e-9 for p in T.PATTERNS if p != T.plain(p))
    mine = labels.where(T.held_out()).join(docs.select("doc_id", "text"), "doc_id").select("toxic", "text").collect()
    rows = [(r.toxic, model.score(r.text)) for r in mine]
    bad, good = [s for t, s in rows if t == 1], [s for t, s in rows if t == 0]
    auc = sum((x > y) + 0.5 * (x == y) for x in bad for y in good) / (len(bad) * len(good))
    assert auc >= 0.95 and sum(s >= 0.5 for s in good) <= 0.02 * len(good)
    for word in ("idiot", "moron"):
        assert model.score(f"you are an {word}") >= 0.5 > model.score(f"you are not an {word}")
        assert model.score(f"she said you are an {word}") < 0.5


def test_odd_tables(spark):
    m = bare()
    rows = [(1, None, "a", 1.0), (2, "", None, None), (3, "you idiot", "b", 2.0), (3, "you idiot", "b", 2.0), (None, "idiot " * 50_000, "c", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted double")
    got = sorted((str(r.doc_id), r.predicted) for r in T.score_texts(docs, m).collect())
    assert got == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("None", 1)]
    kept = T.keep_clean(docs, m)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert T.score_texts(docs.limit(0), m).count() == 0 and T.keep_clean(docs.limit(0), m).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.fit(docs, empty).score("you idiot") >= 0.5
