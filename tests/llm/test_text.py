"""Text operators against brute force, on small and awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from chronogrid.llm import bpe, language, line_dedup, mixing, near_dedup, token_files, toxicity, url_filter
from chronogrid.llm.shared import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, extra int, n_lines string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = [a + b for a in ("ka", "lo", "mi", "tu") for b in ("ra", "se", "no", "vi", "pe")]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    texts = [None, "", "  ", "\n\n", "a", "A\tb", "x" * 5000, "same line\nsame line"]
    for b in base:
        w = b.split(" ")
        texts += [b, b, "\n".join((b, rng.choice(base)))]
        w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    out = [(i, t, "en", f"s{i % 5}" if i % 7 else None, 1, "z") for i, t in enumerate(texts)]
    return [*out, (3, "repeated id", "en", None, None, None), (None, base[0], None, "s1", 2, "q")]


def test_line_dedup(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs).collect()}
    lines = [(i if i is not None else (1 << 63) - 1, k, frozenset(line.lower().split())) for i, t, *_ in rows if t is not None for k, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    want = {(i, k) for i, k, s in lines if any((a, b) < (i, k) and 100 * len(s & u) >= 80 * len(s | u) for a, b, u in lines)}
    assert got == want
    out = line_dedup.dedup_lines(docs)
    assert out.count() == len(rows) and out.columns[:3] == ["doc_id", "text", "lang"]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_near_dedup(spark, rows):
    plain = [r for r in rows if r[0] is not None and r[1] != "repeated id"]
    got = {r.doc_id: r for r in near_dedup.link_components(spark.createDataFrame(rows, SCHEMA), width=4).collect() if r.doc_id is not None and r.doc_id != 3}
    sets = {}
    for i, t, *_ in plain:
        w = words(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[b] = min(comp[a], comp[b])
        if all(comp[comp[i]] == comp[i] for i in comp):
            break
    for i, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), comp[i], comp[i] == i), i


def test_mixing(spark, rows):
    decided, sources = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    table = {r["__s"]: r for r in sources.collect()}
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    size = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    fixed, total = {}, sum(size.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        unit = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    taken = {}
    for r in decided.collect():
        assert 0 <= r.copies <= 3
        taken[r["__s"]] = taken.get(r["__s"], 0) + r.copies * r["__size"]
    for s in names:
        key = "n" if s is None else "s" + s
        target = fixed.get(s, unit * weight[s])
        assert table[key].source_size == size[s] and table[key].target == pytest.approx(target)
        assert taken[key] == pytest.approx(target, rel=0.1, abs=20)


def test_tokenizers(spark, rows):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(rows, SCHEMA).where("doc_id is not null")
    hard = [(900, "It's <|endoftext|> ÉÀ é́ ΑΣ aaaaaa ..,, . x.\ny, z", "en", "s", 1, "q")]
    docs = docs.unionByName(spark.createDataFrame(hard, SCHEMA))
    path = bpe.vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    want = sorted((i, hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()) for i, t in text for e in [lib.encode(t or "", add_special_tokens=False).ids])
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path).collect()) == want
    path = bpe.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    folder = scratch_path(spark, "test-tokens")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, folder, token_files.write_tokens(docs, folder, path)).collect())
    start = 0
    for s, i, n, crc in got:
        assert s == start
        start += n
        options = [lib.encode(t or "", add_special_tokens=False).ids + [0] for k, t in text if k == i]
        assert any((len(e), zlib.crc32(np.array(e, "<u4").tobytes())) == (n, crc) for e in options)
    assert [i for _, i, *_ in got] == sorted(i for _, i, *_ in got) and len(got) == docs.count()


def test_backtracking_is_exact():
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = bpe.WordTokenizer(f.read())
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice("aabcdeéth'. ,") for _ in range(rng.randint(0, 25)))
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://net/", "http://xnet/", "http://a.net", "x://b.example.com/de/#f", "http://w.org/fr/", "http://w.org/en/", "http://net?/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got[3] == ("example.net/en/", "allow") and got[4] == ("net/", "block") and got[5] == (None, "allow") and got[6] == (None, "allow")
    assert got[7] == ("example.com/de/", "block") and got[8] == ("org/fr/", "allow") and got[9] == (None, "allow") and got[0] == (None, "allow") and got[10] == (None, "allow")


def test_language_and_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    got = language.predict(docs.withColumnRenamed("lang", "score"), *model)
    right = got.join(docs, "doc_id").where("lang_pred = lang").count()
    assert right >= 0.95 * docs.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string")
    assert {r.lang_pred for r in language.predict(odd, *model).collect()} == {"und"}
    assert language.predict(odd, *language.fit(docs.limit(0))).count() == 3
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fitted = toxicity.fit(docs, labels)
    scored = toxicity.score_texts(docs, fitted).join(labels, "doc_id")
    assert scored.where("predicted = toxic").count() >= 0.93 * scored.count()
    assert toxicity.score_texts(odd, fitted).count() == 3


def test_every_code_point():
    """Each code point between letters, before a mark, and alone."""
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = bpe.WordTokenizer(f.read())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}, {chr(c)}{chr(c)}." for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    want = lib.encode_batch_fast(texts, add_special_tokens=False)
    for t, w in zip(texts, want):
        assert own.encode(t).tolist() == w.ids
    for c in points[:0x800]:  # one by one, where most texts lie
        t = f"a{chr(c)}b {chr(c)}, {chr(c)}{chr(c)}."
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, hex(c)


def test_long_words_take_linear_time():
    import time

    with open(bpe.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        own = bpe.WordTokenizer(f.read())
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    assert own.encode(word[:50_000]).tolist() == lib.encode(word[:50_000], add_special_tokens=False).ids
    took = []
    for n in (100_000, 400_000):
        t = time.process_time()
        own.encode(word[:n])
        took.append(time.process_time() - t)
    assert took[1] < 10 * max(took[0], 0.05), took


def test_language_held_out(spark):
    """Accuracy on rows that the model may not learn from; the sparse product
    against gathering row by row; odd tables."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = language.fit(docs)
    unseen = docs.where(language.held_out())
    got = language.predict(unseen, langs, table).join(unseen, "doc_id")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count() > 0
    rows = [language.counts(language.codes(t)) for t in ("hello there", "über", "x")]
    for (at, n), total in zip(rows, language.multiply(rows, table)):
        assert total == pytest.approx((table[np.repeat(at, n)].astype(float)).sum(axis=0))
    odd = spark.createDataFrame([(1, "the and of", "zz", 1), (1, "the and of", "zz", 1), (None, "the " * 60_000, None, 2)], "doc_id long, text string, lang_pred string, score int")
    assert language.predict(odd, langs, table).count() == 3
    assert language.predict(odd.limit(0), langs, table).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5, "x", "y", "z"), (1, "a b c d e", 5, "x", "y", "z"), (None, None, None, None, None, None)], "doc_id long, text string, ids int, n_shingles string, component_id string, kept string")
    none = docs.limit(0)
    path = bpe.vocabulary("word_bpe_49k.json")
    encoded = bpe.encode(docs, path)
    assert sorted(map(str, (r.doc_id for r in encoded.collect()))) == ["1", "1", "None"]
    back = [r.text for r in bpe.decode(encoded, path).collect()]
    assert sorted(back) == ["", "a</w> b</w> c</w> d</w> e</w>", "a</w> b</w> c</w> d</w> e</w>"]
    assert bpe.digests(none, path).count() == 0 and bpe.decode(bpe.encode(none, path), path).count() == 0
    kept = near_dedup.dedup_near(docs)
    assert kept.columns == docs.columns and kept.count() == 2 and kept.where("kept = 'z'").count() == 1
    assert near_dedup.link_components(none).count() == 0 and near_dedup.dedup_near(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.drop_redundant(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, host string, verdict int")
    assert url_filter.judge_urls(pages).count() == 0
    folder = scratch_path(spark, "no-tokens")
    byte = bpe.vocabulary("byte_bpe_50k.json")
    assert token_files.read_tokens(spark, folder, token_files.write_tokens(none, folder, byte)).count() == 0


def test_hot_words_are_dealt(spark, monkeypatch):
    """Postings of frequent words go to several keys, with the same result."""
    rng = random.Random(6)
    vocab = [a + b for a in ("ka", "lo", "mi") for b in ("ra", "se", "no")]
    rows = [(i, " ".join(rng.sample(vocab, 6)), "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = sorted(map(tuple, line_dedup.removed_lines(docs).collect()))
    monkeypatch.setattr(line_dedup, "HOT", 16)
    assert sorted(map(tuple, line_dedup.removed_lines(docs).collect())) == plain
    sets = [(i, frozenset(t.split())) for i, t, _ in rows]
    assert plain == sorted((i, 0) for i, s in sets if any(j < i and 100 * len(s & u) >= 80 * len(s | u) for j, u in sets))
