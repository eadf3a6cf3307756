"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is read as code points, lower-cased, with every run of other characters
than letters as breaks.  Its n-grams of the lengths in ``SIZES`` are hashed to
``BUCKETS`` buckets.  The matrix of log probabilities, whose size depends on the
number of languages only, is broadcast; a batch becomes a sparse matrix of
counts, documents by buckets, which is multiplied by it.

The model is fitted on a hash sample of about ``SAMPLE_DOCS`` of the rows that
it may learn from; held-out rows are never among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import need_columns, small_batches

SIZES = (2, 3)
BUCKETS = 1 << 15
#: Documents that the model is fitted on, at most about.
SAMPLE_DOCS = 20_000
#: Code points that are hashed at once; counts of a sparse matrix, at most about.
BLOCK, COUNTS = 1 << 19, 1 << 20
UNKNOWN = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)
_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """The lower-case letter of each code point; a space for all others."""
    if not _table:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _table.append(out)
    return _table[0]


def codes(text: str) -> np.ndarray:
    """The code points of a text as letters and breaks, one break at each end."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.concatenate((np.full(1, 32, np.uint32), _letters()[raw], np.full(1, 32, np.uint32)))
    return own[(own != 32) | np.concatenate((np.ones(1, bool), own[:-1] != 32))]


def grams(c: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of the n-grams that start in each block of ``c``."""
    for i in range(0, len(c), BLOCK):
        part = c[i : i + BLOCK + max(SIZES) - 1].astype(np.uint64)
        for n in SIZES:
            m = min(BLOCK, len(part) - n + 1)
            if m > 0:
                h = np.full(m, n, np.uint64)
                for j in range(n):
                    h = (h ^ part[j : j + m]) * _MIX[j]
                    h ^= h >> np.uint64(15)
                yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64) & (BUCKETS - 1)


def held_out(part: int = 2, of: int = 4) -> Column:
    """Whether crc32 of doc_id as text leaves ``part``; a null doc_id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == part, F.lit(False))


def hash_sample(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """About ``most`` of the rows (all, if fewer), by a hash of doc_id."""
    share = min(1.0, most / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and a matrix of log probabilities (buckets x languages)
    whose last row holds the priors."""
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = hash_sample(known.select("doc_id", "text", "lang"), SAMPLE_DOCS, 11)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                mine = seen.setdefault(lang.as_py(), np.zeros(BUCKETS + 1, np.int64))
                mine[BUCKETS] += 1
                for g in grams(codes(text.as_py())):
                    mine[:BUCKETS] += np.bincount(g, minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = chosen.select("text", "lang").mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # buckets x languages at most
    langs = sorted(got["lang"].unique())
    n = np.zeros((BUCKETS + 1, len(langs)))
    n[got["bucket"].to_numpy(np.int64), np.searchsorted(np.array(langs, object), got["lang"].to_numpy(object))] = got["n"].to_numpy(float)
    grams_of = n[:BUCKETS] + 0.1
    out = np.log(grams_of / grams_of.sum(axis=0)) if langs else grams_of
    priors = np.log(n[BUCKETS:] / max(n[BUCKETS].sum(), 1)) if langs else n[BUCKETS:]
    return langs, np.concatenate((out, priors)).astype(np.float32)


def counts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs."""
    n = np.zeros(BUCKETS, np.int64)
    for g in grams(c):
        n += np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def multiply(rows: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray) -> np.ndarray:
    """The product of a sparse matrix, given by the places and counts of each
    row (none of them empty), and ``table``."""
    starts = np.cumsum([0] + [len(at) for at, _ in rows[:-1]])
    at, n = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    return np.add.reduceat(table[at].astype(np.float64) * n[:, None], starts, axis=0)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score: the likeliest language of every whole text and
    its posterior probability.

    A null text and a text without letters get ``und`` and score 0, and so do
    all texts if nothing could be learned.  Of equally likely languages the
    first by name counts.  Repeated rows are judged alike, other columns are not
    read, and an empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            pred, score = [UNKNOWN] * len(b), [0.0] * len(b)
            rows, places, held = [], [], 0

            def settle() -> None:
                if rows:
                    total = multiply(rows, table) + table[BUCKETS]
                    best = total.argmax(axis=1)
                    sure = 1 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(axis=1)
                    for i, k, p in zip(places, best.tolist(), sure.tolist()):
                        pred[i], score[i] = langs[k], p
                rows.clear()
                places.clear()

            for i, text in enumerate(b.column(1)):
                c = codes(text.as_py() or "")
                if langs and (c != 32).any():
                    rows.append(counts(c))
                    places.append(i)
                    held += len(rows[-1][0])
                    if held > COUNTS:
                        settle()
                        held = 0
            settle()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, *fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
