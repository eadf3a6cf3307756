"""Token ids in binary files, each document compressed on its own.

A set of files is a folder with one dictionary and numbered shards.

``dictionary.zdict``: a zstandard dictionary, trained on serialized id arrays.

A shard: magic ``CGTOKEN1``, the dictionary's xxhash64 and the id width in bytes
(unsigned 64-bit each); then one zstandard frame for each document; then the
index, three arrays of signed 64-bit integers for all documents: doc_id, the
frame's end, the number of ids; then the number of documents and the magic.  All
integers are little-endian.  A reader of one document needs the index and one
frame.  Null doc_ids come last and read as the largest integer.

Documents are in ascending order of doc_id over the shards in order of number.
Shards are written under a name of their own for each task attempt and then
renamed, so that a repeated task leaves one whole file.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary
from .chunks import RUNS, Chunks
from .shared import cut, discard, need_columns, scratch_path, small_batches

MAGIC = b"CGTOKEN1"
#: The dictionary is trained on at most about so many documents, chosen by a
#: hash of doc_id, none of them longer than SAMPLE_CHARS characters.
SAMPLE_DOCS, SAMPLE_CHARS = 1000, 20_000
DICTIONARY_BYTES = 64 << 10
NO_ID = (1 << 63) - 1
#: Bytes of a shard that are read at once; bytes of a shard, at most about.
READ_BYTES, SHARD_BYTES = 8 << 20, 256 << 20
#: In the cache only: a comma and a full stop at a chunk's end, a chunk after a
#: line feed, and a text's first chunk.
_COMMA, _STOP, _LINE, _FIRST = "\x01", "\x02", "\x03", "\x04"
#: Chunks kept by a Python worker; a full cache is emptied, which costs only time.
LIMIT = 1_200_000
#: Characters of the texts that are encoded together, at most about.
GROUP_CHARS = 1 << 18
#: What the library's byte level writes for a space.
_SPACE = "\u0120"
_LETTERS = string.ascii_letters
#: ASCII letters, then signs: two pieces of the library's.
_SIGNED = re.compile(r"[A-Za-z]+[!-/:-@\[-^`{-~]+").fullmatch


def _byte_level() -> dict[int, str]:
    """For ``str.translate``: what the library's byte level writes for each
    letter that `chunks.plain` lets through, a character for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0x80, 0x200)}


def _words_only(spec: str):
    """The library with the same merges for words that are split already and in
    the byte level's letters; None, if the tokenizer is not one of plain bytes."""
    from tokenizers import Tokenizer

    parts = json.loads(spec)
    split, model = parts.get("pre_tokenizer") or {}, parts["model"]
    odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")]
    plain_split = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if model.get("type") != "BPE" or any(odd) or not plain_split or parts.get("normalizer") or any("<|" not in t["content"] for t in parts.get("added_tokens", [])):
        return None
    return Tokenizer.from_str(json.dumps(parts | {"pre_tokenizer": None, "post_processor": None, "truncation": None, "padding": None, "added_tokens": []}))


class Encoder:
    """The tokenizers library with a cache of the chunks that it has encoded."""

    def __init__(self, spec: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 65536 and end_id < 65536 else 4
        self.code = "H" if self.width == 2 else "I"
        self.end = self._bytes([end_id])
        marks = {_COMMA: self._all([","])[0], _STOP: self._all(["."])[0]}
        self.bare = Chunks(self._chunks, marks, True, ragged=True, limit=LIMIT)
        self.whole = Chunks(self._chunks, {}, False, self.bare)
        self.line = np.frombuffer(self._all(["\n"])[0], f"<u{self.width}")
        self.words = _words_only(spec)
        self.byte_level = _byte_level()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith(_SPACE)]] = True

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _all(self, words: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _lines(self, groups: list[tuple[str, list[str]]]) -> list[list[bytes]]:
        """The ids of each word after its group's lead, from one text for each
        group with a word a line: a line feed between other characters is one
        token by itself."""
        out = []
        texts = [lead + f"\n{lead}".join(words) for lead, words in groups]
        for (lead, words), e in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, f"<u{self.width}")
            ends = np.flatnonzero(ids == self.line[0]) if len(self.line) == 1 else ()
            if len(ends) != len(words) - 1:  # not so with this vocabulary
                out.append(self._all([lead + w for w in words]))
                continue
            raw = ids.tobytes()
            starts = [0, *((ends + 1) * self.width).tolist()]
            out.append([raw[i:j] for i, j in zip(starts, [*(ends * self.width).tolist(), len(raw)])])
        return out

    def _letters(self, words: list[str]) -> list[bytes] | None:
        """The ids of a space and each word, letters with or without signs after
        them: the library splits between these only, and no token but a word's
        first begins with a space."""
        shown = []
        for w in words:
            if not w.isalpha():
                tail = w.lstrip(_LETTERS)
                shown += (_SPACE + w[: -len(tail)], tail)
            else:
                shown.append(_SPACE + (w if w.isascii() else w.translate(self.byte_level)))
        ids = np.array(self.words.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids, f"<u{self.width}")
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(words):  # not so with this vocabulary
            return None
        raw, at = ids.tobytes(), (starts * self.width).tolist()
        return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)])]

    def _chunks(self, words: list[str]) -> list[bytes]:
        mine = [w.isalpha() or _SIGNED(w) is not None for w in words] if self.words else []
        got = self._letters(list(compress(words, mine))) if any(mine) else None
        if got is None:
            return self._others(words)
        if len(got) == len(words):
            return got
        letters, others = iter(got), iter(self._others([w for w, x in zip(words, mine) if not x]))
        return [next(letters) if x else next(others) for x in mine]

    def _others(self, words: list[str]) -> list[bytes]:
        signed = [w for w in words if w[0] <= _FIRST]
        if not signed:
            return self._lines([(" ", words)])[0]
        kinds = [(_LINE, self.line.tobytes()), (_FIRST, b"")]
        parts = [(before, "", [w for w in signed if w[0] == sign], 1) for sign, before in kinds]
        parts = [p for p in [*parts, (b"", " ", [w for w in words if w[0] > _FIRST], 0)] if p[2]]
        out: dict[str, bytes] = {}
        for (before, _, mine, _), got in zip(parts, self._lines([(lead, [w[skip:] for w in mine] if skip else mine) for _, lead, mine, skip in parts])):
            out.update(zip(mine, [before + x for x in got] if before else got))
        return [out[w] for w in words]

    def _cached(self, texts: list[str]) -> list[bytes | None]:
        """By chunks, where a space before a character that is not white space
        and a line feed between such characters are always token boundaries."""
        out: list[bytes | None] = [None] * len(texts)
        whole: dict[int, str] = {}
        bare: dict[int, list[str]] = {}
        for k, text in enumerate(texts):
            if any(c in text for c in (_COMMA, _STOP, _LINE, _FIRST)):
                continue
            whole[k] = text = _FIRST + text.replace("\n", " " + _LINE)
            if not any(two in text for two in RUNS):
                split = text.replace(", ", f" {_COMMA} ").replace(". ", f" {_STOP} ")
                if split.endswith(".") and split[-2].isalnum():
                    split = f"{split[:-1]} {_STOP}"
                bare[k] = split.split(" ")
        for k, got in zip(bare, self.bare.get_all(list(bare.values()))):
            out[k] = got
        rest = {k: text.split(" ") for k, text in whole.items() if out[k] is None}
        for k, got in zip(rest, self.whole.get_all(list(rest.values()))):
            out[k] = got
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text, then the end id, as little-endian integers."""
        out = []
        group: list[str] = []
        size = 0
        for k, text in enumerate(texts):
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS or k + 1 == len(texts):
                for whole, got in zip(group, self._cached(group)):
                    if not whole:
                        got = b""
                    elif got is None:
                        got = self._all([whole])[0]
                    out.append(got + self.end)
                group, size = [], 0
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_made: dict = {}


def _encoder(spec, end_id: int) -> Encoder:
    key = (xxhash.xxh64_intdigest(spec.value), end_id)
    if key not in _made:
        _made[key] = Encoder(spec.value, end_id)
    return _made[key]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for ``samples``; where they are too few to train on, their
    own bytes (an empty table: no dictionary)."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if len(s) >= 8], threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _load(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _frame(raw: bytes, packer: zstandard.ZstdCompressor) -> bytes:
    return packer.compress(raw)


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> DataFrame:
    """Encode every whole text and write the files; the manifest as a table:
    shard, docs, tokens.

    A null or empty text has only the end id, and a text of any length is one
    frame.  Rows that repeat a doc_id are all written, in the order of their ids'
    bytes.  An empty table gives empty shards.
    """
    need_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")

    def ids_only(batches):
        e = _encoder(spec, end_id)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(e.encode_all(b.column(0).to_pylist()), pa.binary())], names=["ids"])

    total = docs.count()
    part = min(1.0, SAMPLE_DOCS / max(total, 1))
    chosen = docs.where((F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(part * (1 << 30))) & (F.length("text") <= SAMPLE_CHARS))
    samples = [bytes(r[0]) for r in chosen.select("text").mapInArrow(ids_only, "ids binary").collect()]
    dictionary = train_dictionary(samples)
    fs, root = _files(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def frames(batches):
        e = _encoder(spec, end_id)
        packer = zstandard.ZstdCompressor(level=3, dict_data=_load(shared.value))
        for b in batches:
            raw = e.encode_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(r) // e.width for r in raw], pa.int64()), pa.array([_frame(r, packer) for r in raw], pa.binary())], names=["doc_id", "n", "frame"]
            )

    def shard(batches):
        at = TaskContext.get().partitionId()
        width = _encoder(spec, end_id).width
        fs, root = _files(folder)
        mine = f"{root}/.{at}-{uuid.uuid4().hex}"
        ids, ends, sizes, end = array("q"), array("q"), array("q"), 24
        with fs.open_output_stream(mine) as out:
            out.write(MAGIC + np.array([xxhash.xxh64_intdigest(shared.value), width], "<u8").tobytes())
            for b in batches:
                for f in b.column(2):
                    f = f.as_py()
                    out.write(f)
                    end += len(f)
                    ends.append(end)
                ids.extend(b.column(0).to_pylist())
                sizes.extend(b.column(1).to_pylist())
            out.write(b"".join(np.asarray(x, "<i8").tobytes() for x in (ids, ends, sizes)) + np.array([len(ids)], "<i8").tobytes() + MAGIC)
        fs.move(mine, f"{root}/shard-{at:08d}")
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["shard", "docs", "tokens"])

    packed = cut(docs.mapInArrow(frames, "doc_id bigint, n bigint, frame binary"), "token-frames")
    size = packed.agg(F.sum(F.length("frame"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = packed.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "n", "frame")
    manifest = cut(ordered.mapInArrow(shard, "shard bigint, docs bigint, tokens bigint"), "token-manifest")
    discard(packed)
    return manifest


class Shard:
    """A shard opened for reading: its index, and single documents."""

    def __init__(self, folder: str, number: int):
        fs, root = _files(folder)
        with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
            dictionary = f.read()
        self.file = fs.open_input_file(f"{root}/shard-{number:08d}")
        head, size = self.file.read_at(24, 0), self.file.size()
        tail = self.file.read_at(16, size - 16)
        seal, self.width = np.frombuffer(head[8:], "<u8").tolist()
        if head[:8] != MAGIC or tail[8:] != MAGIC:
            raise ValueError("not a whole token file")
        if seal != xxhash.xxh64_intdigest(dictionary):
            raise ValueError("the file was written with another dictionary")
        count = int(np.frombuffer(tail[:8], "<i8")[0])
        index = np.frombuffer(self.file.read_at(24 * count, size - 16 - 24 * count), "<i8").reshape(3, count)
        self.doc_ids, self.ends, self.sizes = index
        self.starts = np.concatenate((np.array([24], np.int64), self.ends))[:count]
        self.unpack = zstandard.ZstdDecompressor(dict_data=_load(dictionary))

    def _ids(self, frame: bytes, k: int) -> np.ndarray:
        raw = self.unpack.decompress(frame, max_output_size=int(self.sizes[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def ids(self, k: int) -> np.ndarray:
        """The ids of the shard's document number k, by one read."""
        return self._ids(self.file.read_at(int(self.ends[k] - self.starts[k]), int(self.starts[k])), k)

    def all(self) -> Iterator[np.ndarray]:
        """The ids of all documents in order, by few large reads."""
        k = 0
        while k < len(self.ends):
            first = int(self.starts[k])
            last = max(k + 1, int(np.searchsorted(self.ends, first + READ_BYTES, side="right")))
            block = self.file.read_at(int(self.ends[last - 1]) - first, first)
            for i in range(k, last):
                yield self._ids(block[int(self.starts[i]) - first : int(self.ends[i]) - first], i)
            k = last


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    counts = sorted((r.shard, r.docs, r.tokens) for r in manifest.collect())  # one row for each shard
    base, todo = 0, []
    for number, docs, tokens in counts:
        if docs:
            todo.append((number, base))
        base += tokens
    files = spark.createDataFrame(todo, "shard bigint, base bigint").repartition(max(1, len(todo)), "shard") if todo else spark.createDataFrame([], "shard bigint, base bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(folder, number)
                crc = pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for ids in s.all()], pa.int64())
                starts = base + np.cumsum(s.sizes) - s.sizes
                ids = pa.array(s.doc_ids, mask=s.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(s.sizes), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' byte-level BPE ids to files and read them back."""
    folder = scratch_path(spark, "token-files")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, vocabulary("byte_bpe_50k.json"))
    return read_tokens(spark, folder, manifest)
