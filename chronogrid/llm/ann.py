"""Approximate nearest neighbours by adaptive dimension scan in inverted lists.

Nearness is the inner product.  With one more component, sqrt(M^2 - |x|^2) for
the largest norm M (queries have 0 there), its order is that of Euclidean
distance: |q|^2 + M^2 - 2 q.x.

Vectors are rotated at random and stored, in blocks of columns, in lists by
nearest centroid; k-means is fitted on a bounded sample, and every vector is
assigned.  A query probes the lists with the nearest centroids; how many, is
measured on a bounded sample of queries whose true neighbours are found by brute
force.  The nearest of these lists, as few as hold LEAST candidates, are scanned
first; they bound the k-th best for the scan of the others.  Within a list one
block is read after the other: after each block a hypothesis test on the partial distance abandons the
candidates that are, with high confidence, farther than the best k so far (a
partial distance over d of D random directions, scaled by D / d, exceeds the
true one by more than 1 + EPSILON / sqrt(d) only rarely).  What is left is
scored on the original vectors in double precision.

Long lists are dealt into parts of bounded size, and so are the queries of a
list, so that no task holds more than one part of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, need_columns, small_batches
from .vectors import best, matrix, top, usable

#: Vectors that k-means is fitted on, at most about; its rounds.
SAMPLE, ROUNDS = 20_000, 8
#: One list for so many vectors; lists at most.
PER_LIST, MOST_LISTS = 2000, 16384
#: A query probes so many lists that a sample of at most TRIALS queries finds this
#: share of its true neighbours; its lists hold LEAST candidates, if there are.
TARGET, TRIALS, LEAST = 0.98, 96, 1500
#: Vectors of a part of a list.
PART = 4096
#: Rows that are tested together.
GROUP = 2048
#: Columns of a block; confidence of the test; what single precision may be off.
BLOCK, EPSILON, SINGLE = 16, 2.1, 1e-5
#: Share of rows that ask: every vec_id divisible by this.
ASK = 20


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded choice of rows."""
    rng = np.random.default_rng(5)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(ROUNDS):
        near = assign(x, c)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def assign(x: np.ndarray, c: np.ndarray, probes: int = 1) -> np.ndarray:
    """The nearest centroids of each row, nearest first."""
    out = np.zeros((len(x), min(probes, len(c))), np.int64)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), 1024):
        d = half - x[i : i + 1024] @ c.T
        out[i : i + 1024] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def scan(query: np.ndarray, blocks: list[np.ndarray], k: int, bound: float, off: float = 0.0) -> np.ndarray:
    """The rows that may be among the k nearest and within ``bound`` (a squared
    distance), by adaptive dimension scan; ``off`` is what squared distances may
    be off.

    ``blocks`` hold the columns of all rows, block by block.  Rows come in
    groups, each read block by block and tested after each; the k best so far
    tighten the bound for the next group.
    """
    dims = sum(b.shape[1] for b in blocks)
    near = np.full(k, bound)
    kept = [np.zeros(0, np.int64)]
    for start in range(0, len(blocks[0]), GROUP):
        alive = np.arange(start, min(start + GROUP, len(blocks[0])))
        part, seen = np.zeros(len(alive)), 0
        for b in blocks:
            block = b[alive] - query[seen : seen + b.shape[1]]
            part = part + np.einsum("ij,ij->i", block, block)
            seen += b.shape[1]
            slack = (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < dims else 1 + 1e-9
            stay = part * (dims / seen) <= near[-1] * slack + off + 1e-12
            alive, part = alive[stay], part[stay]
        kept.append(alive)
        near = np.sort(np.concatenate((near, part)))[:k]
    return np.concatenate(kept)


def _probes(placed: DataFrame, asking: DataFrame, k: int, order) -> int:
    """How many lists hold TARGET of the true neighbours of a few queries."""
    trials = asking.orderBy(F.xxhash64("vec_id", F.lit(4))).limit(TRIALS).toPandas()
    if not len(trials):
        return 1
    who, q = trials["vec_id"].to_numpy(np.int64), np.stack(trials["v"].to_numpy()).astype(np.float64)
    shared = placed.sparkSession.sparkContext.broadcast((who, q))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, q = shared.value
        for b in batches:
            if not len(b):
                continue
            ids, lists = b.column(0).to_numpy(), b.column(2).to_numpy()
            scores = q @ matrix(b.column(1)).T
            for i in range(len(who)):
                pick = top(np.where(ids == who[i], -np.inf, scores[i]), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([who[i]] * len(pick)), pa.array(ids[pick]), pa.array(lists[pick]), pa.array(scores[i][pick])], names=["query_id", "vec_id", "list", "score"])

    found = placed.select("vec_id", "v", "list").mapInArrow(measure, "query_id bigint, vec_id bigint, list bigint, score double")
    near = best(found, k, "list").where("score > double('-Infinity')").collect()  # TRIALS * k rows at most
    place = {w: np.argsort(o) for w, o in zip(who.tolist(), order(q))}
    ranks = np.sort([place[r.query_id][r["list"]] for r in near])
    return int(ranks[min(len(ranks) - 1, int(TARGET * len(ranks)))]) + 1 if len(ranks) else 1


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all
    other rows, nearest first, ties to the smaller vec_id.

    ``queries`` are rows of ``vectors`` (vec_id, embedding).  What takes no part
    is said in ``usable``.  A query gets fewer rows only if there are not k other
    rows.
    """
    need_columns(vectors, "vec_id", "embedding")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = cut(usable(vectors, zero=False), "ann-vectors")
    total, norm, dims = rows.agg(F.count(F.lit(1)), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)")), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    norm *= 1 + 1e-12
    share = min(1.0, SAMPLE / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30)) < max(int(share * (1 << 30)), 1)).select("vec_id", "v").toPandas().sort_values("vec_id")
    seen = np.stack(sample["v"].to_numpy()).astype(np.float64) if len(sample) else np.zeros((1, dims))
    turn = np.linalg.qr(np.random.default_rng(17).normal(size=(dims + 1, dims + 1)))[0]

    def lifted(x: np.ndarray, data: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0)) if data else np.zeros(len(x))
        return np.column_stack((x, extra)) @ turn

    lists = int(min(MOST_LISTS, max(1, total // PER_LIST)))
    centers = spark.sparkContext.broadcast(kmeans(lifted(seen, True), lists))

    edges = list(range(0, dims + 1, BLOCK))
    names = [f"b{i}" for i in range(len(edges))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turned = lifted(matrix(b.column(1)), True) if len(b) else np.zeros((0, dims + 1))
            near = assign(turned, centers.value)[:, 0] if len(b) else np.zeros(0, np.int64)
            blocks = [turned[:, i : i + BLOCK].astype(np.float32) for i in edges]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32())) for x in blocks]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near), *lists], names=["vec_id", "v", "list", *names])

    vector = dict(rows.dtypes)["v"]
    stored = "".join(f", {n} array<float>" for n in names)
    placed = cut(rows.mapInArrow(place, f"vec_id bigint, v {vector}, list bigint{stored}"), "ann-lists")
    sizes = np.zeros(len(centers.value), np.int64)
    for r in placed.groupBy("list").count().collect():  # MOST_LISTS rows at most
        sizes[r["list"]] = r["count"]
    parts = np.maximum(1, -(-sizes // PART))

    wanted = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asking = rows.join(wanted, "vec_id", "left_semi")
    probes = _probes(placed, asking, k, lambda q: assign(lifted(q, False), centers.value, len(centers.value)))
    least = max(LEAST, 2 * (k + 1))

    def probe(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centers.value
            for b in batches:
                order = assign(lifted(matrix(b.column(1)), False), c, len(c)) if len(b) else np.zeros((0, len(c)), np.int64)
                who, where, part = [], [], []
                for i, lists in enumerate(order):
                    need = int(np.searchsorted(np.cumsum(sizes[lists]), least)) + 1
                    for x in lists[:need] if first else lists[need : max(probes, need)]:
                        n = int(parts[x]) if sizes[x] else 0
                        who += [i] * n
                        where += [x] * n
                        part += range(n)
                at = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(where, pa.int64()), pa.array(part, pa.int64())], names=["query_id", "q", "list", "part"])

        return run

    count = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(parts) if n > 1] or [(-1, 1)], "list bigint, n bigint")
    dealt = placed.join(F.broadcast(count), "list", "left").select("list", F.pmod(F.xxhash64("vec_id"), F.coalesce("n", F.lit(1))).alias("part"), "vec_id", "v", *names)
    kind = "query_id bigint, vec_id bigint, score double"

    def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, who = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(ids) and len(who):
            x, q, blocks = matrix(left["v"]), matrix(right["q"]), [matrix(left[n]).astype(np.float32) for n in names]
            asks, least = lifted(q, False), right["least"].to_numpy()
            for i in range(len(who)):
                low = -np.inf if np.isnan(least[i]) else least[i]
                size = (q[i] * q[i]).sum() + norm
                own = int((ids == who[i]).sum())
                near = scan(asks[i].astype(np.float32), blocks, k + own, (size - 2 * low) * (1 + 1e-9) + 1e-9, 4 * SINGLE * size)
                near = near[ids[near] != who[i]]
                scores = (x[near] * q[i]).sum(axis=1)
                near, scores = near[scores >= low], scores[scores >= low]
                pick = top(scores, ids[near], k)
                out[0].append(np.full(len(pick), who[i]))
                out[1].append(ids[near][pick])
                out[2].append(scores[pick])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    def visit(first: bool, bounds: DataFrame | None) -> DataFrame:
        asked = asking.mapInArrow(probe(first), f"query_id bigint, q {vector}, list bigint, part bigint")
        asked = asked.join(bounds, "query_id", "left") if bounds else asked.withColumn("least", F.lit(None).cast("double"))
        return dealt.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(look, kind)

    home = cut(best(visit(True, None), k), "ann-first")
    bounds = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    return best(home.select("query_id", "vec_id", "score").union(visit(False, bounds)), k)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vec_id divisible by 20, among all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where(f"vec_id % {ASK} = 0"), 20)
