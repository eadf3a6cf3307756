"""What the vector searches share: clean input, metric form, top-k tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Components from here on have no place in double arithmetic on squares.
LARGEST = 1e140


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id, v array<double>: the rows that can take part.

    Rows with a null vec_id, a null or empty vector, a null or non-finite
    component or one of LARGEST or more, or a length other than the commonest (of
    equally common ones the largest; vectors of different lengths have no inner
    product) take no part; nor do zero vectors unless ``zero``.  Rows that repeat
    a vec_id all take part, each with its own vector.
    """
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    rows = rows.where(f"vec_id is not null and size(v) > 0 and forall(v, x -> not isnull(x) and not isnan(x) and abs(cast(x as double)) < {LARGEST}D)")
    if not zero:
        rows = rows.where("exists(v, x -> x <> 0)")
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (top.d if top else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a two-dimensional array of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best(found: DataFrame, k: int, *more: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score", *more)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best, by score downwards, then id upwards."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
