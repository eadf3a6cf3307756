"""MinHash near-dedup with odd sketches, confirmed on full shingle sets.

Two documents are linked if the Jaccard similarity of their word-shingle sets
is at least ``percent`` / 100.  Components are those of the link graph.

1. Every document gets MinHash samples, band hashes of them, and an odd sketch:
   a parity bitmap into which all samples are folded.  The population count of
   the XOR of two sketches estimates a high similarity closely.
2. Documents with equal sets form a class; its smallest doc_id stands for it.
3. Documents that share a band hash are candidates.  In each bucket all are
   first held against the smallest and the largest doc_id only, then, where a
   bucket still has several components, all pairs of different components whose
   sketches are near enough.  So a group of n copies costs a multiple of n, and
   a link between different components is never skipped.
4. Candidates are confirmed on their full sets.

A pair at the threshold shares no band with probability (1 - 0.8**6)**48 =
5e-7, and its sketches differ by more than the limit with about 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, discard, need_columns, small_batches, with_ids
from .shingles import scramble, sets_of

PERCENT = 80
#: Words of a shingle where no contract says otherwise.
WIDTH = 5
ROWS, BANDS, SAMPLES, BITS = 6, 48, 512, 1024
#: Standard deviations by which a sketch distance may exceed its expected value.
SLACK = 4.5
_MULT = np.random.default_rng(99).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def far(percent: int) -> int:
    """The largest distance of two sketches that still may be similar enough."""
    t = percent / 100
    near = lambda d: BITS / 2 * (1 - np.exp(-2 * d / BITS))
    mid = 2 * SAMPLES * (1 - t)
    spread = 2 * np.sqrt(SAMPLES * t * (1 - t)) * np.exp(-2 * mid / BITS)
    chance = np.sqrt(BITS / 4 * (1 - np.exp(-4 * mid / BITS)))
    return int(near(mid) + SLACK * np.hypot(spread, chance))


def _parity(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes, and the odd sketches of the samples and of the set itself, of
    a nonempty set, as int64 arrays."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i : i + 512, None] * _MULT).min(axis=0), out=low)
    mixed = scramble(low + _SALT)
    bands = mixed[: ROWS * BANDS].reshape(BANDS, ROWS)
    keys = scramble((bands * _MULT[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64), np.concatenate((_parity(mixed), _parity(s)))


_SKETCH = "doc_id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>, odd array<bigint>"


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2, bands, odd = [], [], [], [], []
            for s in sets_of(b.column(1), width):
                n.append(len(s))
                s1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(np.bitwise_xor.reduce(scramble(s + np.uint64(1))).view(np.int64)) if len(s) else 0)
                x, y = sketch(s) if len(s) else (None, None)
                bands.append(x)
                odd.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["doc_id", "n", "s1", "s2", "bands", "odd"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in sets_of(b.column(1), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return run


def _near(percent: int) -> str:
    """SQL: may the sets of x and y be similar enough, by sizes and sketches?

    The distance of the sets' own parity bitmaps never exceeds their symmetric
    difference, so that part drops no link at all.
    """
    longs = BITS // 64
    apart = lambda at: "+".join(f"bit_count(x.odd[{i}] ^ y.odd[{i}])" for i in range(at, at + longs))
    both = f"(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"
    return (
        f"{percent} * x.n <= 100 * y.n and {percent} * y.n <= 100 * x.n"
        f" and {apart(longs)} <= x.n + y.n - 2 * {both} and {apart(0)} <= {far(percent)}"
    )


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs u, v whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = with_ids(docs, ids).join(ids, "doc_id", "left_semi").mapInArrow(_full_sets(width), "id bigint, set array<bigint>")
    a, b = sets.select(F.col("id").alias("u"), F.col("set").alias("a")), sets.select(F.col("id").alias("v"), F.col("set").alias("b"))
    both = pairs.select("u", "v").join(b, "v").join(a, "u").withColumn("i", F.size(F.array_intersect("a", "b")))
    return both.where(f"100 * i >= {percent} * (size(a) + size(b) - i)").select("u", "v").distinct()


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    component_id is the smallest doc_id that links reach, itself included; kept
    marks that document.  A null text and a text without words have no shingles
    and no links.  A row with a null doc_id takes no part: its component_id is
    null and it is kept.  Rows that repeat a doc_id are one node of the graph
    (the links of either join both), each with its own n_shingles.
    """
    need_columns(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = cut(docs.mapInArrow(_sketches(width), _SKETCH), "near-sketches")
    some = all_rows.where("n > 0 and doc_id is not null")
    classes = cut(some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows")), "near-classes")
    heads = some.join(classes.select("n", "s1", "s2", F.col("id").alias("doc_id")), ["n", "s1", "s2", "doc_id"], "left_semi")
    entries = heads.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "h")).select("id", F.xxhash64("band", "h").alias("key"))
    ends = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    entries = cut(entries.join(ends, "key"), "near-buckets")
    facts = heads.select(F.col("doc_id").alias("id"), "n", "odd")
    near = _near(percent)
    star = entries.select(F.col("id").alias("u"), F.explode(F.array("lo", "hi")).alias("v")).where("u <> v").distinct()
    x, y = (facts.select(F.col("id").alias(k), F.col("n"), F.col("odd")).alias(t) for k, t in (("u", "x"), ("v", "y")))
    star = cut(star.join(y, "v").select("u", "v", F.struct("n", "odd").alias("y")).join(x.select("u", F.struct("n", "odd").alias("x")), "u").where(near).select("u", "v"), "near-star")
    edges = [cut(_confirm(docs, star, width, percent), "near-links")]
    found = components(edges[0])
    # what different components may still share: only buckets with several of them
    label = found.select(F.col("u").alias("id"), F.col("v").alias("c"))
    named = entries.select("key", "id").join(label, "id", "left").withColumn("c", F.coalesce("c", "id"))
    mixed = named.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key")
    rest = cut(named.join(mixed, "key", "left_semi").join(facts, "id"), "near-rest")
    pairs = rest.alias("x").join(rest.alias("y"), F.expr(f"x.key = y.key and x.c <> y.c and x.id < y.id and {near}")).select(F.col("y.id").alias("u"), F.col("x.id").alias("v")).distinct()
    pairs = cut(pairs.join(star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), ["u", "v"], "left_anti"), "near-pairs")
    if not pairs.isEmpty():
        more = cut(_confirm(docs, pairs, width, percent), "near-links")
        if not more.isEmpty():
            found = components(found.union(more))
    final = classes.join(found.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").select("n", "s1", "s2", F.coalesce("c", "id").alias("c"))
    out = all_rows.select("doc_id", "n", "s1", "s2").join(final, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    # rows that repeat a doc_id take the smallest component of them
    twice = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1").select("doc_id", "c")
    out = out.join(twice, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "component_id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    discard(entries, rest, star)
    return out


def dedup_near(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, one document of each component, with
    all their columns.

    Of rows that repeat a doc_id and its text one stays; rows with a repeated
    doc_id and other texts stay or go together.  Rows without a doc_id, with a
    null text or without words stay; an empty table gives an empty table.
    """
    gone = link_components(docs, width, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.select(F.struct("*").alias("r")).join(gone.hint("shuffle_hash"), F.col("r.doc_id") == F.col("__gone"), "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice"))
    if not twice.isEmpty():
        marked = kept.join(twice, F.col("r.doc_id") == F.col("__twice"), "left")
        many = marked.where("__twice is not null")
        first = many.groupBy("__twice", F.xxhash64("r.text").alias("h")).agg(F.first("r").alias("r")).select("r")
        kept = marked.where("__twice is null").select("r").union(first)
    return kept.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-dedup of all documents over 4-word shingles at 80 %."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
