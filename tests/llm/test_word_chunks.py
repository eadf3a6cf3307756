"""Words of letters go to the library already split, those of many texts in one call."""

import json
import random
import string

from chronogrid.llm import bpe, token_files
from chronogrid.llm.token_files import Encoder


def _spec() -> str:
    with open(bpe.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def _texts() -> list[str | None]:
    rng = random.Random(11)
    letters = string.ascii_letters + "".join(c for c in map(chr, range(0xA1, 0x200)) if c.isalpha())
    signs = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    tail = lambda: "".join(rng.choice(signs) for _ in range(rng.randint(1, 3)))
    chunk = lambda: rng.choice([word, word, lambda: word() + tail(), lambda: word() + tail() + word(), lambda: str(rng.randint(0, 10**6)), lambda: rng.choice(["don't", "we'll", "it's", "x'", "'s", "a_b", "<|endoftext|>", "²³", "naïve"])])()
    text = lambda: "".join(chunk() + rng.choice([" ", " ", " ", ", ", ". ", "\n", "  "]) for _ in range(rng.randint(0, 40)))
    return [text().strip() if rng.random() < 0.8 else text() for _ in range(400)] + [None, "", "\x01 a", "a\x03b", "日本 a", ", a", "a,"]


def test_many_texts_are_encoded_as_by_the_library(monkeypatch):
    texts = _texts()
    for chars in (1, 1000, 1 << 18):  # texts in groups, by their size
        monkeypatch.setattr(token_files, "GROUP_CHARS", chars)
        e = Encoder(_spec(), 0)
        assert e.encode_all(texts) == [(e._all([t])[0] if t else b"") + e.end for t in texts]
        assert e.encode_all([]) == []


def test_words_of_letters_take_one_call_for_many_texts():
    e = Encoder(_spec(), 0)
    calls = []
    words, library = e.words, e.library

    class Counting:
        def __init__(self, of, name):
            self.of, self.name = of, name

        def encode_batch_fast(self, texts, **how):
            calls.append(self.name)
            return self.of.encode_batch_fast(texts, **how)

    e.words, e.library = Counting(words, "words"), Counting(library, "library")
    texts = [f"x and wordy{a} some{b} b" for a in "abcdef" for b in "ghij"]
    assert e.encode_all(texts) == [Encoder._bytes(e, library.encode(t, add_special_tokens=False).ids) + e.end for t in texts]
    assert calls.count("words") == 1 and calls.count("library") <= 1  # the texts' first words


def test_other_tokenizers_take_the_plain_way():
    parts = json.loads(_spec())
    parts["pre_tokenizer"]["add_prefix_space"] = True
    odd = Encoder(json.dumps(parts), 0)
    assert odd.words is None
