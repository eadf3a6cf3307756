"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """u, v for every node u that is linked to a smaller one: v is the smallest
    node of its component.

    ``edges`` has columns u, v of type long.  Alternating large and small stars:
    each round links nodes to their smallest neighbour; edges never multiply,
    and nothing but their number and a checksum reaches the driver.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small).distinct()
        new = cut(new, "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
        discard(now)
        if state == seen:
            return new
        now, seen = new, state
