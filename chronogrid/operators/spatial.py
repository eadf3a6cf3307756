"""Grids, folds, areas, containment and alignment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..series import checkpointed

# Fixed value: the radius, in km, of the sphere with the area of WGS84.
EARTH_RADIUS_KM = 6371.0072


def hash_order(seed: int, *keys: str) -> Column:
    """A seeded order of rows that does not depend on partitions."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def blocks(pixels: DataFrame, size: int, width: int) -> DataFrame:
    """Adds block_row, block_col, block_id of square blocks of cells."""
    if size < 1:
        raise ValueError("a block has at least one cell")
    across = math.ceil(width / size)
    out = pixels.withColumns({"block_row": F.expr(f"cast(row div {size} as int)"), "block_col": F.expr(f"cast(col div {size} as int)")})
    return out.withColumn("block_id", F.col("block_row") * across + F.col("block_col"))


def block_folds(pixels: DataFrame, size: int, width: int, n_folds: int, seed: int = 42) -> DataFrame:
    """Adds fold: whole blocks, in seeded hash order, dealt to folds in turn.

    Blocks are far fewer than pixels; their numbering is the only global step.
    Fewer blocks than folds raise.
    """
    placed = blocks(pixels, size, width)
    ids = placed.select("block_id").distinct()
    if len(ids.limit(n_folds).collect()) < n_folds:
        raise ValueError(f"fewer blocks than {n_folds} folds")
    order = Window.orderBy(hash_order(seed, "block_id"))
    folds = ids.select("block_id", ((F.row_number().over(order) - 1) % n_folds).alias("fold"))
    return placed.join(folds, "block_id")


def buffered_training(samples: DataFrame, fold: int, buffer: int) -> DataFrame:
    """Training samples of a fold whose block is farther than ``buffer`` blocks
    (in the larger of rows and columns) from every test block.

    Test blocks are spread over their neighbourhood, so that the anti-join is by
    equality of blocks.
    """
    train, test = samples.where(F.col("fold") != fold), samples.where(F.col("fold") == fold)
    if buffer <= 0:
        return train
    around = test.select("block_row", "block_col").distinct().select(
        F.explode(F.sequence(F.col("block_row") - buffer, F.col("block_row") + buffer)).alias("block_row"), "block_col"
    ).select("block_row", F.explode(F.sequence(F.col("block_col") - buffer, F.col("block_col") + buffer)).alias("block_col")).distinct()
    return train.join(around, ["block_row", "block_col"], "left_anti")


def buffer_separation(samples: DataFrame, fold: int) -> DataFrame:
    """One row: the least distance, in blocks, of a train block from a test block."""
    train = samples.where(F.col("fold") != fold).select(F.col("block_row").alias("r"), F.col("block_col").alias("c")).distinct()
    test = samples.where(F.col("fold") == fold).select("block_row", "block_col").distinct()
    far = F.greatest(F.abs(F.col("r") - F.col("block_row")), F.abs(F.col("c") - F.col("block_col")))
    extent = train.agg(F.max("r") - F.min("r"), F.max("c") - F.min("c")).first()
    most = test.agg(F.max(F.abs("block_row")), F.max(F.abs("block_col"))).first()
    end, reach = 2 * (sum(x or 0 for x in extent) + sum(x or 0 for x in most) + 1), 1
    while True:  # blocks within ``reach`` of each other lie in neighbouring cells of that size
        cell = lambda c: F.floor(F.col(c) / reach)  # noqa: E731, B023
        near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))  # noqa: E731, B023
        spread = test.withColumn("u", near("block_row")).withColumn("v", near("block_col"))
        found = train.withColumns({"u": cell("r"), "v": cell("c")}).join(spread, ["u", "v"]).agg(F.min(far).alias("minimum_block_distance"))
        least = found.first()[0]
        if (least is not None and least <= reach) or reach > end:
            return found
        reach *= 2


def pixel_area(pixels: DataFrame, top: float, step: float, geographic: bool = True) -> DataFrame:
    """Adds area_km2: of the spherical quadrangle of a cell of ``step`` degrees in
    its row below ``top``, or of a square cell of ``step`` metres."""
    if not geographic:
        return pixels.withColumn("area_km2", F.lit(step * step / 1e6))
    edge = lambda k: f"sin(radians({top}D - {step}D * (row + {k})))"
    return pixels.withColumn("area_km2", F.expr(f"{EARTH_RADIUS_KM}D * {EARTH_RADIUS_KM}D * radians({step}D) * abs({edge(0)} - {edge(1)})"))


def area_statistics(cells: DataFrame, label: str, ignore: tuple = ()) -> DataFrame:
    """label, n_pixels, area_km2, fraction of the area of all valid cells."""
    valid = cells.where(F.col(label).isNotNull())
    valid = valid.where(~F.col(label).isin(*ignore)) if ignore else valid
    total = valid.agg(F.sum("area_km2").alias("total"))
    sums = valid.groupBy(label).agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("area_km2").alias("area_km2"))
    return sums.join(F.broadcast(total)).select(label, "n_pixels", "area_km2", (F.col("area_km2") / F.col("total")).alias("fraction"))


def polygon_edges(spark: SparkSession, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """ring, edge, x1, y1, x2, y2 of closed rings; a ring needs 4 positions, all
    finite, the last equal to the first."""
    rows = []
    for i, ring in enumerate(rings):
        if len(ring) < 4 or ring[0] != ring[-1] or not all(math.isfinite(v) for p in ring for v in p):
            raise ValueError("a ring needs at least 4 finite positions and must be closed")
        rows += [(i, j, *map(float, a), *map(float, b)) for j, (a, b) in enumerate(zip(ring, ring[1:]))]
    return spark.createDataFrame(rows, "ring int, edge int, x1 double, y1 double, x2 double, y2 double")


def inside_polygon(points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds inside, by the parity of edges right of the point (holes count).

    The edges, bounded by the boundary file, travel as one broadcast array, so
    that points are neither multiplied nor shuffled.
    """
    packed = edges.agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    crossing = f"filter(_edges, e -> (e.y1 > {y}) <> (e.y2 > {y}) and {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1)"
    return points.join(F.broadcast(packed)).withColumn("inside", F.expr(f"size({crossing}) % 2 = 1")).drop("_edges")


def regrid(cells: DataFrame, target: DataFrame, scale: float, shift: float, method: str = "bilinear") -> DataFrame:
    """row, col, value of target cells, from source cells of the same reference.

    A target cell (row, col) has its centre at source position
    (row + 0.5) * scale + shift - 0.5, likewise for columns.  nearest takes one
    source cell; bilinear weighs four, leaving out missing ones.
    """
    at = lambda c: f"(({c} + 0.5D) * {scale}D + {shift}D - 0.5D)"
    source = cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    placed = target.select("row", "col", F.expr(at("row")).alias("pr"), F.expr(at("col")).alias("pc"))
    if method == "nearest":
        near = placed.select("row", "col", F.expr("cast(floor(pr + 0.5D) as int)").alias("sr"), F.expr("cast(floor(pc + 0.5D) as int)").alias("sc"))
        return near.join(source, ["sr", "sc"], "left").select("row", "col", "value")
    corners = placed.select("row", "col", "pr", "pc", F.explode(F.expr("array(0, 1)")).alias("dr")).select("*", F.explode(F.expr("array(0, 1)")).alias("dc"))
    near = corners.selectExpr(
        "row", "col", "cast(floor(pr) + dr as int) as sr", "cast(floor(pc) + dc as int) as sc",
        "if(dr = 0, 1 - (pr - floor(pr)), pr - floor(pr)) * if(dc = 0, 1 - (pc - floor(pc)), pc - floor(pc)) as w",
    )
    met = near.join(source, ["sr", "sc"], "left")
    weight = F.sum(F.when(F.col("value").isNotNull(), F.col("w")))
    return met.groupBy("row", "col").agg(F.when(weight > 1e-12, F.sum(F.col("w") * F.col("value")) / weight).alias("value"))


def grid_alignment(a: dict, b: dict, tolerance: float = 1e-6) -> list[str]:
    """What differs between two grids (crs, a to f of the transform, height,
    width); an empty list for grids that are aligned."""
    out = []
    if a["crs"] != b["crs"]:
        out.append("crs")
    if abs(abs(a["a"]) - abs(b["a"])) > tolerance or abs(abs(a["e"]) - abs(b["e"])) > tolerance:
        out.append("resolution")
    if (a["height"], a["width"]) != (b["height"], b["width"]):
        out.append("dimensions")
    if any(abs(g[k]) > tolerance for g in (a, b) for k in "bd"):
        out.append("rotation")
    if abs(a["c"] - b["c"]) > tolerance or abs(a["f"] - b["f"]) > tolerance:
        out.append("origin")
        dx, dy = (a["c"] - b["c"]) / a["a"], (a["f"] - b["f"]) / a["e"]
        if abs(dx - round(dx)) > 1e-3 or abs(dy - round(dy)) > 1e-3:
            out.append("fraction of a pixel")
    edges = lambda g: (g["c"], g["f"], g["c"] + g["a"] * g["width"], g["f"] + g["e"] * g["height"])
    if any(abs(x - y) > max(tolerance, 1e-9) for x, y in zip(edges(a), edges(b))):
        out.append("extent")
    return out


def temporal_alignment(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: lengths of two label records (t, label), how many labels differ,
    whether the second lags or leads by one step, whether the first is in order."""
    a, b = first.select("t", F.col("label").cast("string").alias("a")), second.select("t", F.col("label").cast("string").alias("b"))
    order = Window.orderBy("t")  # a time axis, not data: few rows
    both = a.join(b, "t", "full").withColumns({"b_next": F.lead("b").over(order), "a_next": F.lead("a").over(order)})
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(
        F.count("a").alias("n_first"), F.count("b").alias("n_second"), n(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differ"),
        (n(F.col("a").isNotNull() & F.col("a_next").isNotNull() & ~F.col("a").eqNullSafe(F.col("b_next"))) == 0).alias("second_lags"),
        (n(F.col("b").isNotNull() & F.col("b_next").isNotNull() & ~F.col("a_next").eqNullSafe(F.col("b"))) == 0).alias("second_leads"),
        (n(F.col("a") > F.col("a_next")) == 0).alias("ascending"),
    )


def snapped_grid(west: float, south: float, east: float, north: float, resolution: float) -> dict:
    """A grid over bounds, its origin on a whole multiple of the resolution."""
    if resolution <= 0:
        raise ValueError("resolution must be positive")
    west, south = math.floor(west / resolution) * resolution, math.floor(south / resolution) * resolution
    east, north = math.ceil(east / resolution) * resolution, math.ceil(north / resolution) * resolution
    return {"a": resolution, "b": 0.0, "c": west, "d": 0.0, "e": -resolution, "f": north, "width": max(round((east - west) / resolution), 1), "height": max(round((north - south) / resolution), 1)}


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def unflatten(values: DataFrame, height: int, width: int) -> DataFrame:
    """row, col, value of every cell of a grid; cells without a row are null."""
    grid = values.sparkSession.range(height * width).select(F.col("id").alias("pixel_id"), F.expr(f"cast(id div {width} as int)").alias("row"), F.expr(f"cast(id % {width} as int)").alias("col"))
    return grid.join(values.select("pixel_id", "value"), "pixel_id", "left").select("row", "col", "value")


def connected_regions(cells: DataFrame, label: str) -> DataFrame:
    """row, col, label, region: cells of one label that touch by an edge share the
    smallest cell number of their region.

    In each round a cell takes the smallest region among its neighbours', and then
    that region's own region, so that rounds grow with the logarithm of a region's
    length; a checkpoint ends each round's lineage.
    """
    own = checkpointed(cells.where(F.col(label).isNotNull()).select("row", "col", label, F.struct("row", "col").alias("region")))
    while True:
        moved = own.select(F.explode(F.expr("array(struct(row - 1 as row, col as col), struct(row + 1 as row, col as col), struct(row as row, col - 1 as col), struct(row as row, col + 1 as col))")).alias("n"), label, "region")
        near = moved.select("n.row", "n.col", label, "region").groupBy("row", "col", label).agg(F.min("region").alias("other"))
        step = own.join(near, ["row", "col", label], "left").select("row", "col", label, F.col("region").alias("was"), F.least("region", "other").alias("region"))
        jump = own.select(F.struct("row", "col").alias("region"), F.col("region").alias("further"))
        new = step.join(jump, "region").select("row", "col", label, "was", F.least("region", "further").alias("region"))
        new = checkpointed(new)
        done = new.where("region < was").isEmpty()
        own = new.select("row", "col", label, "region")
        if done:
            return own.select("row", "col", label, F.col("region.row").alias("region_row"), F.col("region.col").alias("region_col"))


def align_to_reference(cells: DataFrame, target: DataFrame, scale: float, shift: float, kind: str = "continuous") -> DataFrame:
    """The cells on the target grid: continuous values by bilinear weights,
    categories by the nearest cell, so that no class is invented."""
    methods = {"continuous": "bilinear", "categorical": "nearest"}
    if kind not in methods:
        raise ValueError(f"kind must be one of {sorted(methods)}")
    return regrid(cells, target, scale, shift, methods[kind])


def require_alignment(a: dict, b: dict, tolerance: float = 1e-6) -> None:
    """Raises with all problems, if two grids do not match."""
    if problems := grid_alignment(a, b, tolerance):
        raise ValueError(f"the grids differ: {', '.join(problems)}")
