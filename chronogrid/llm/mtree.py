"""Exact top-k search by inner product in a forest of M-trees.

Vectors become integers, floor(scale * x).  With one more component that lifts
all squared norms to the largest one, the order of inner products is that of
Euclidean distances, so that a metric tree applies.  Bounds are widened by what
double arithmetic may be off; where inner products may pass 2**53, what is left
is scored in whole numbers of any length.

Vectors are dealt to pivots (rows of a bounded sample) by nearest pivot; each
pivot's vectors, in parts of bounded size, form an M-tree, which is built once and
written to the shared folder: pages of entries,
each with its distance to the page's routing object, under nodes with covering
radii and distances to their parents.  A query visits nodes best first, by the
least distance that the covering radius allows; the stored parent distances and
the triangle inequality rule out nodes and entries without computing their
distances.

First each query searches the tree of its nearest pivot, which bounds its k-th
best; then, with that bound, all parts whose ball can hold something better.
Only these get the query.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, need_columns, small_batches
from .vectors import best, matrix, top, usable

SCALE = 1024
#: Rows that pivots are chosen from, at most about; one pivot for so many rows;
#: pivots at most.
SAMPLE, PER_PIVOT, MOST_PIVOTS = 20_000, 2048, 4096
#: Vectors of a part; entries of a page; children of an inner node.
PART, PAGE, FANOUT = 8192, 512, 16
#: Roots of exact integers are off by less.
MARGIN = 1e-9
#: Scores are ordered exactly below this.
MOST = 10**38
ASK = 100


class Node:
    """A routing object with its covering radius and distance to the parent's
    routing object; either children, or a page of entries."""

    __slots__ = ("center", "radius", "to_parent", "children", "rows", "dists", "centers", "radii", "parents")

    def __init__(self, center: np.ndarray, to_parent: float):
        self.center, self.to_parent = center, to_parent
        self.radius, self.children, self.rows, self.dists = 0.0, [], None, None


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """From each row of x to y; the squares are exact."""
    d = x - y
    return np.sqrt((d * d).sum(axis=1))


def build(x: np.ndarray, rows: np.ndarray, center: np.ndarray, to_parent: float) -> Node:
    """An M-tree over some rows: inner nodes share them out among routing objects
    far from each other, until they fit a page."""
    node = Node(center, to_parent)
    dist = distances(x[rows], center)
    node.radius = float(dist.max()) if len(rows) else 0.0
    if len(rows) <= PAGE or node.radius == 0:
        order = np.argsort(dist, kind="stable")
        node.rows, node.dists = rows[order], dist[order]
        return node
    picks, low = [int(dist.argmax())], np.full(len(rows), np.inf)
    owner = np.zeros(len(rows), np.int64)
    while True:
        d = distances(x[rows], x[rows[picks[-1]]])
        closer = d < low
        owner[closer], low[closer] = len(picks) - 1, d[closer]
        if len(picks) == FANOUT or low.max() == 0:
            break
        picks.append(int(low.argmax()))
    for i, p in enumerate(picks):
        mine = rows[owner == i]
        if len(mine):
            node.children.append(build(x, mine, x[rows[p]], float(dist[p])))
    node.centers = np.stack([c.center for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    node.parents = np.array([c.to_parent for c in node.children])
    return node


def search_tree(root: Node, query: np.ndarray, k: int, bound: float, measure, slack: float = 0.0) -> tuple[np.ndarray, int]:
    """Rows that may be among the k nearest of ``query`` and no farther than
    ``bound``, where computed distances may be off by ``slack``; how many
    distances were computed."""
    margin = MARGIN + 2 * slack
    found = np.zeros(0)  # the k least distances
    kept: list[np.ndarray] = []
    d = float(np.sqrt(((root.center - query) ** 2).sum()))
    heap, tick, computed = [(max(0.0, d - root.radius), 0, d, root)], 0, 1
    limit = bound
    while heap:
        least, _, d, node = heapq.heappop(heap)
        if least > limit * (1 + MARGIN) + margin:
            break
        if node.rows is not None:
            near = np.abs(node.dists - d) <= limit * (1 + MARGIN) + margin
            rows = node.rows[near]
            if len(rows):
                dist = measure(rows)
                computed += len(rows)
                stay = dist <= limit * (1 + MARGIN) + margin
                kept.append(rows[stay])
                found = np.sort(np.concatenate((found, dist[stay])))[:k]
                if len(found) == k:
                    limit = min(limit, float(found[-1]))
            continue
        at = np.flatnonzero(np.abs(d - node.parents) - node.radii <= limit * (1 + MARGIN) + margin)
        if len(at):
            e = distances(node.centers[at], query)
            computed += len(at)
            for i, far in zip(at.tolist(), e.tolist()):
                least = max(0.0, far - node.radii[i])
                if least <= limit * (1 + MARGIN) + margin:
                    tick += 1
                    heapq.heappush(heap, (least, tick, far, node.children[i]))
    return np.concatenate(kept) if kept else np.zeros(0, np.int64), computed


def exact(rows: np.ndarray, query: np.ndarray, large: bool) -> np.ndarray:
    """The inner products of integer-valued rows; whole numbers of any length if
    doubles cannot hold them."""
    if not large:
        return (rows * query).sum(axis=1).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in rows], object).reshape(rows.shape)
    return (whole * np.array([int(v) for v in query], object)).sum(axis=1) if len(rows) else np.zeros(0, object)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: exactly the k highest integer inner products
    of each query with the other rows, ties to the smaller vec_id.

    What takes no part is said in ``usable``; zero vectors do take part.  A score
    that a long cannot hold becomes the nearest that it can.  Rows that repeat a
    vec_id are candidates each; as queries they share one result.
    """
    need_columns(vectors, "vec_id", "embedding")
    spark = vectors.sparkSession
    small_batches(spark)
    whole = usable(vectors, zero=True)
    rows = cut(whole, "tree-vectors")
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    square = F.expr(f"aggregate(v, 0D, (a, x) -> a + (cast(x as double) * {scale}) * (cast(x as double) * {scale}))")
    total, norm, dims = rows.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], empty)
    # floor moves each component by less than one
    norm = float(np.ceil((np.sqrt(norm) + np.sqrt(dims)) ** 2))
    large = bool(norm >= 1 << 50)
    slack = float(np.sqrt(norm * dims * 2.0**-50)) if large else 0.0
    share = min(1.0, SAMPLE / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 30)) < max(int(share * (1 << 30)), 1)).select("vec_id", "v").toPandas().sort_values("vec_id")

    def integers(column) -> np.ndarray:
        return np.floor(matrix(column) * scale) if len(column) else np.zeros((0, dims))

    def lifted(x: np.ndarray, data: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0)) if data else np.zeros(len(x))
        return np.column_stack((x, extra))

    seen = lifted(np.floor(np.stack(sample["v"].to_numpy()).astype(np.float64) * scale), True) if len(sample) else np.zeros((1, dims + 1))
    wanted = int(min(MOST_PIVOTS, max(1, total // PER_PIVOT)))
    pivots = [0]
    low = distances(seen, seen[0])
    while len(pivots) < wanted and low.max() > 0:  # farthest first
        pivots.append(int(low.argmax()))
        low = np.minimum(low, distances(seen, seen[pivots[-1]]))
    centers = spark.sparkContext.broadcast(seen[pivots])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centers.value
        for b in batches:
            x = lifted(integers(b.column(1)), True)
            near = np.zeros(len(x), np.int64)
            dist = np.full(len(x), np.inf)
            for i, y in enumerate(c):
                d = distances(x, y)
                better = d < dist
                near[better], dist[better] = i, d[better]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near), pa.array(dist)], names=["vec_id", "v", "pivot", "dist"])

    vector = dict(rows.dtypes)["v"]
    placed = cut(rows.mapInArrow(place, f"vec_id bigint, v {vector}, pivot bigint, dist double"), "tree-placed")
    facts = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()  # MOST_PIVOTS rows at most
    parts = {r.pivot: -(-r.n // PART) for r in facts}
    radius = {r.pivot: r.r for r in facts}
    count = spark.createDataFrame([(int(p), int(n)) for p, n in parts.items()], "pivot bigint, n bigint")
    dealt = placed.join(F.broadcast(count), "pivot").select("pivot", F.pmod(F.xxhash64("vec_id"), "n").alias("part"), "vec_id", "v")

    def grow(key, rows):
        ids = rows["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], integers(rows["v"])[order]
        x = lifted(own, True)
        tree = pickle.dumps((ids, own, build(x, np.arange(len(x)), x[0], 0.0)), protocol=5)
        return pa.table({"pivot": pa.array([key[0].as_py()]), "part": pa.array([key[1].as_py()]), "tree": pa.array([tree], pa.binary())})

    trees = cut(dealt.groupBy("pivot", "part").applyInArrow(grow, "pivot bigint, part bigint, tree binary"), "tree-pages")
    asked = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    names = ["query_id", "q", "bound", "pivot", "part"]
    kind = f"query_id bigint, q {vector}, bound double, pivot bigint, part bigint"

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centers.value
            own = np.array(sorted(parts))
            radii = np.array([radius[p] for p in own.tolist()])
            for b in batches:
                q = lifted(integers(b.column(1)), False)
                bounds = np.full(len(q), np.inf) if first else b.column(2).to_numpy(zero_copy_only=False)
                who, pivot, part = [], [], []
                for i in range(len(q)):
                    d = distances(c[own], q[i])
                    home = int(d.argmin())
                    far = d - radii <= bounds[i] * (1 + MARGIN) + MARGIN + 2 * slack
                    far[home] = False
                    for p in [int(own[home])] if first else own[far].tolist():
                        who += [i] * parts[p]
                        pivot += [p] * parts[p]
                        part += range(parts[p])
                at = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(bounds[np.array(who, np.int64)], pa.float64()), pa.array(pivot, pa.int64()), pa.array(part, pa.int64())], names=names)

        return run

    def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        if len(left) and len(right):
            ids, own, root = pickle.loads(left["tree"][0].as_py())
            who, q = right["query_id"].to_numpy(), integers(right["q"])
            ask, bounds = lifted(q, False), right["bound"].to_numpy()
            for i in range(len(who)):
                square = (q[i] * q[i]).sum() + norm

                def measure(rows: np.ndarray, i: int = i, square: float = square) -> np.ndarray:
                    # exact integers under the root, so that ties stay ties
                    return np.sqrt(np.maximum(square - 2 * (own[rows] * q[i]).sum(axis=1), 0))

                near, _ = search_tree(root, ask[i], k + int((ids == who[i]).sum()), float(bounds[i]), measure, slack)
                near = near[ids[near] != who[i]]
                scores = exact(own[near], q[i], large)
                pick = top(scores, ids[near], k)
                out[0].append(np.full(len(pick), who[i]))
                out[1].append(ids[near][pick])
                out[2].extend(scores[pick].tolist())
        scores = [Decimal(min(max(s, 1 - MOST), MOST - 1)) for s in out[2]] if large else out[2]
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": pa.array(scores, pa.decimal128(38, 0) if large else pa.int64())})

    def visit(asks: DataFrame) -> DataFrame:
        return trees.groupBy("pivot", "part").cogroup(asks.groupBy("pivot", "part")).applyInArrow(look, f"query_id bigint, vec_id bigint, score {'decimal(38,0)' if large else 'bigint'}")

    home = cut(best(visit(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).mapInArrow(route(True), kind)), k), "tree-home")
    worst = home.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n"))
    size = F.expr(f"aggregate(v, 0D, (a, x) -> a + cast(floor(cast(x as double) * {scale}) as double) * cast(floor(cast(x as double) * {scale}) as double))")
    sure = (F.col("n") >= k) & (F.abs(F.col("s").cast("double")) < (1e37 if large else 1e18))
    bound = F.when(sure, F.sqrt(F.greatest(size + F.lit(float(norm)) - 2 * F.col("s").cast("double"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    again = asked.join(worst, asked["vec_id"] == worst["query_id"], "left").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), bound.alias("bound"))
    rest = visit(again.mapInArrow(route(False), kind))
    found = best(home.select("query_id", "vec_id", "score").union(rest), k)
    low, high = -(1 << 63), (1 << 63) - 1
    return found.withColumn("score", F.expr(f"cast(greatest(least(score, {high}BD), {low}BD) as bigint)")) if large else found


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest scores of every vec_id divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where(f"vec_id % {ASK} = 0"), 10)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {ASK} = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 10
"""
