"""The pipeline's stages: brute force, kept columns, odd and empty tables."""

import random

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_removed int, __size string, __s int, r string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = [a + b for a in ("ka", "lo", "mi", "tu", "re") for b in ("ra", "se", "no", "vi", "pe", "du")]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(12))
    texts = ["\n".join(line() for _ in range(4)) for _ in range(20)]
    texts += [texts[0], texts[1] + " extra", None, "", " \n", "you are an idiot", texts[2].split("\n")[0] + "\n" + line(), "x" * 30_000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "mine", 5, "a", 1, "z") for i, t in enumerate(texts)]
    rows += [rows[3], (None, line(), None, None, None, None, None, None, None, None)]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 0, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(path / "empty" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(path / "empty" / "labels.parquet"))
    return path


def same_but_text(before, after):
    """All columns but text and n_chars are as they were."""
    cut = lambda df: sorted(map(str, df.drop("text", "n_chars").collect()))
    have = cut(before)
    return all(r in have for r in cut(after)) and before.columns == after.columns


def test_stages(spark, folder):
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    clean = P.drop_toxic(spark, docs, str(folder))
    assert same_but_text(docs, clean) and clean.count() == docs.count() - 1
    lined = P.drop_lines(spark, clean, str(folder))
    assert same_but_text(clean, lined)
    ids = [r.doc_id for r in lined.collect()]
    assert 20 not in ids and 23 in ids and 22 in ids  # a copy goes, blank and null texts stay
    assert ids.count(3) == 2 and all(r.n_chars == len(r.text) for r in lined.where("text is not null").collect())
    assert lined.where("doc_id = 26").first().text.count("\n") == 0
    once = P.drop_copies(spark, lined, str(folder))
    assert same_but_text(lined, once) and [r.doc_id for r in once.collect()].count(3) == 1
    direct = {r.doc_id for r in P.drop_copies(spark, docs, str(folder)).collect()}
    assert {20, 21}.isdisjoint(direct) and {0, 1, 2, 22, 23, None} <= direct
    mixed = P.mix(spark, once, str(folder))
    assert same_but_text(once, mixed)
    ids = P.encode(spark, mixed, str(folder))
    assert ids.count() == mixed.count()


def test_run(spark, folder):
    assert P.run(spark, str(folder)).where("doc_id in (20, 25)").count() == 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]


def test_empty(spark, folder):
    assert P.run(spark, str(folder / "empty")).count() == 0
