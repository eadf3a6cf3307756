"""Backtracking BPE encoder and offset-table decoder.

A sequence of vocabulary tokens is the exact result of the merge rules if and
only if every two neighbours are compatible: the merges of their joint text
give just these two.  So a word is cut into longest matches by an Aho-Corasick
automaton; where two neighbours are not compatible, the encoder tries shorter
tokens and steps back, never visiting a position twice once it is ruled out.
Compatibility is looked up in a table that fills as pairs occur; each entry is
found from the merges at the two tokens' touching ends.

Decoding copies byte ranges of one table of all token texts by their offsets.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .chunks import RUNS, Chunks
from .shared import need_columns, small_batches

#: Added to a word's last symbol: tokens that end a word are other tokens.
_LAST = 0x2000
#: Ids that are decoded at once.
_SLICE = 1 << 17


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeEncoder:
    """Exact BPE of single words, from a vocabulary and ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        fold = lambda t: t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + _LAST) if suffix and t.endswith(suffix) else t
        self.text = {i: fold(t) for t, i in vocab.items()}
        self.find = ahocorasick.Automaton()
        for i, t in self.text.items():
            self.find.add_word(t, i)
        self.find.make_automaton()
        self.longest = max(map(len, self.text.values()))
        self.ids = {t: i for i, t in self.text.items()}
        self.rank, self.parts, self.birth = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = r
            self.parts[z] = x, y
            self.birth[z] = r
            if max(self.birth.get(x, -1), self.birth.get(y, -1)) >= r:
                raise ValueError("a merge comes before its parts")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cuts: dict[int, int | None] = {}
        self.suffix = suffix

    def _edge(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """The tokens at one end of ``token`` while it is merged: each with the
        rank that makes it and the rank that takes it up."""
        out, taken = [], float("inf")
        while True:
            born = self.birth.get(token, -1)
            out.append((token, born, taken))
            if born < 0:
                return out
            token, taken = self.parts[token][side], born

    def compatible(self, a: int, b: int) -> bool:
        """Do the merges leave the joint text of a and b as just a, b?  Among
        merges of one rank the leftmost comes first."""
        if (known := self.pairs.get((a, b))) is not None:
            return known
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        right = self._edge(b, 0)
        good = not any(
            (r := self.rank.get((x, y))) is not None and r < x_end and r <= y_end for x, _, x_end in self._edge(a, 1) for y, _, y_end in right
        )
        self.pairs[a, b] = good
        return good

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.cuts:
            t = self.text[token]
            self.cuts[token] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), None)
        return self.cuts[token]

    def word(self, s: str) -> list[int]:
        """The ids of a word, given as the symbols of its bytes."""
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + _LAST)
        found = [i for _, i in self.find.iter_long(s)]
        if all(map(self.compatible, found, found[1:])):
            return found
        open_at = bytearray(b"\1") * (len(s) + 1)
        out: list[int] = []
        at, token = 0, found[0]
        while at < len(s):
            end = at + len(self.text[token])
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < len(s):
                    token = next(self.find.iter_long(s[at : at + self.longest]))[1]
            elif (less := self._shorter(token)) is not None:
                token = less
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(self.text[token])
        return out


class WordTokenizer:
    """What a tokenizer file with NFC, lower case, a splitting pattern and byte
    symbols does.

    ``spec`` is the file's JSON text.  Special tokens in a text are found before
    normalisation, as the file's library does by default.
    """

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        kinds = [n["type"] for n in d["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or d.get("decoder"):
            raise ValueError("not the kind of tokenizer file that this encoder reads")
        # normalisation and splitting into words are the library's own, but for
        # chunks of characters that are in no doubt; the merges are not
        self.split, self.symbols = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), byte_symbols()
        library = Tokenizer.from_str(json.dumps(d | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.bpe = MergeEncoder(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = OffsetTable([names.get(i, "") + " " for i in range(max(names) + 1)])
        self.digits = OffsetTable([f"{i} " for i in range(max(names) + 1)])
        each = lambda words: [self._plain(w) for w in words]
        self.bare = Chunks(each, {"": b""} | {m: self._normal(m) for m in ",."}, True)
        self.whole = Chunks(each, {"": b""}, False, self.bare)

    def _plain(self, chunk: str) -> bytes:
        """Of a chunk that ``chunks.plain`` lets through: NFC changes nothing there,
        and lower case goes by character."""
        ids: list[int] = []
        for w in self.split.findall(chunk.lower()):
            ids += self.bpe.word(w.encode().decode("latin-1").translate(self.symbols))
        return np.array(ids, "<u4").tobytes()

    def _normal(self, text: str) -> bytes:
        ids: list[int] = []
        for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)):
            ids += self.bpe.word(w)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text (null: none)."""
        if not text:
            return np.zeros(0, "<u4")
        spaced = text.replace("\n", " ") + " "
        got = None
        if not any(two in spaced for two in RUNS):
            got = self.bare.get(spaced.replace(", ", " , ").replace(". ", " . ").split(" "))
        if got is None:
            got = self.whole.get(spaced.split(" "))
        if got is None:
            parts = self.specials.split(text)
            got = b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._normal(p) for i, p in enumerate(parts))
        return np.frombuffer(got, "<u4")

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The text of ``ids`` in pieces: token texts with a space between."""
        return self.names.pieces(ids)


class OffsetTable:
    """Texts, laid end to end, each ending in one space."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.all = np.frombuffer(b"".join(raw), np.uint8)

    def pieces(self, ids: np.ndarray) -> Iterator[bytes]:
        for i in range(0, len(ids), _SLICE):
            part = ids[i : i + _SLICE]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            where = np.repeat(self.starts[part] - ends + sizes, sizes) + np.arange(ends[-1])
            out = self.all[where].tobytes()
            yield out[:-1] if i + _SLICE >= len(ids) else out


_made: dict[str, WordTokenizer] = {}


def _tokenizer(spec) -> WordTokenizer:
    """One for each Python worker and file."""
    key = hashlib.sha256(spec.value.encode()).hexdigest()
    if key not in _made:
        _made[key] = WordTokenizer(spec.value)
    return _made[key]


def _broadcast(spark: SparkSession, path: str):
    """The tokenizer file, a few MB whatever the corpus, sent to all workers."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of each whole text; a null or empty text has none."""
    need_columns(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    spec = _broadcast(docs.sparkSession, path)

    def run(batches):
        t = _tokenizer(spec)
        for b in batches:
            ids = [t.encode(x).view(np.int32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row of ids; the inverse of encode up to what its
    normalisation loses (case, white space)."""
    spec = _broadcast(encoded.sparkSession, path)

    def run(batches):
        t = _tokenizer(spec)
        for b in batches:
            text = [b"".join(t.decode(np.asarray(x or [], np.int64))).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if wanted: encode
    and decode at once."""
    need_columns(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    spec = _broadcast(docs.sparkSession, path)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def sha(pieces: Iterator[bytes]) -> str:
        h = hashlib.sha256()
        for p in pieces:
            h.update(p)
        return h.hexdigest()

    def run(batches):
        t = _tokenizer(spec)
        for b in batches:
            n, a, d, all_ids = [], [], [], []
            for x in b.column(1):
                ids = t.encode(x.as_py())
                n.append(len(ids))
                all_ids.append(ids.view(np.int32) if with_ids else None)
                a.append(sha(t.digits.pieces(ids)))
                d.append(sha(t.decode(ids)))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(all_ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the word-level vocabulary."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))
