"""Row generators for tile plans, tile order, mosaic offsets and coordinates.

A plan is a DataFrame ``south_row, col, min_x, min_y, max_x, max_y, width, height``; rows count
from the south as tiles are planned, ``tile_row`` counts from the north as arrays are laid out.
Plans are made on the executors from two short sequences, so a plan of any size is a narrow,
lazy stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidRequestError
from ..model import BBox, positive_pair, resolution_pair


def _axis(n: Column, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1)).alias(name)


def grid_plan_of(boxes: DataFrame, chunk: tuple[int, int], grid: tuple[int, int]) -> DataFrame:
    """An equal split of each row's box (min_x, min_y, max_x, max_y, other columns kept); last edges are the box's own."""
    width, height = positive_pair(chunk, "chunk_size")
    rows, cols = positive_pair(grid, "grid_shape")
    step_x, step_y = (F.col("max_x") - F.col("min_x")) / cols, (F.col("max_y") - F.col("min_y")) / rows
    cells = boxes.withColumn("south_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    x0, y0 = F.col("min_x") + F.col("col") * step_x, F.col("min_y") + F.col("south_row") * step_y
    x1 = F.when(F.col("col") == cols - 1, F.col("max_x")).otherwise(F.col("min_x") + (F.col("col") + 1) * step_x)
    y1 = F.when(F.col("south_row") == rows - 1, F.col("max_y")).otherwise(F.col("min_y") + (F.col("south_row") + 1) * step_y)
    kept = [c for c in boxes.columns if c not in ("min_x", "min_y", "max_x", "max_y")]
    return cells.select(*kept, "south_row", "col", x0.alias("min_x"), y0.alias("min_y"), x1.alias("max_x"), y1.alias("max_y"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def box_frame(spark: SparkSession, box: BBox) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in zip(("min_x", "min_y", "max_x", "max_y"), box.bounds, strict=True)))


def grid_plan(spark: SparkSession, box: BBox, chunk: tuple[int, int], grid: tuple[int, int] = (1, 1)) -> DataFrame:
    """A plan of ``grid`` (rows, cols) tiles of ``chunk`` (width, height) pixels each."""
    return grid_plan_of(box_frame(spark, box), chunk, grid)


def _edges(low: Column, high: Column, pixels: int, res: float, slack: float) -> Column:
    """Accumulated tile edges; planning stops within ``slack`` of the far side."""
    most = F.ceil((high - low) / F.lit(pixels * res)).cast("int") + 1
    return F.aggregate(
        F.sequence(F.lit(0), most),
        F.array(low),
        lambda acc, _: F.when(F.element_at(acc, -1) < high - F.lit(slack), F.array_append(acc, F.least(high, F.element_at(acc, -1) + F.lit(pixels * res)))).otherwise(acc),
    )


def resolution_edges(low: float, high: float, pixels: int, res: float, least_res: float) -> list[float]:
    """The same edges on the driver, for the shape of one request."""
    edges, step = [low], pixels * res
    while edges[-1] < high - least_res / 10:
        edges.append(min(high, edges[-1] + step))
    return edges


def resolution_plan(spark: SparkSession, box: BBox, chunk: tuple[int, int], resolution: float | tuple[float, float]) -> DataFrame:
    """A plan from the south-west corner in steps of chunk times resolution, clipped at the far edges.

    A clipped tile has as many pixels as its span needs, at least one.
    """
    width, height = positive_pair(chunk, "chunk_size")
    rx, ry = resolution_pair(resolution)
    slack = min(rx, ry) / 10
    edges = box_frame(spark, box).select(_edges(F.col("min_x"), F.col("max_x"), width, rx, slack).alias("xs"), _edges(F.col("min_y"), F.col("max_y"), height, ry, slack).alias("ys"))
    pairs = lambda e: F.zip_with(F.slice(e, F.lit(1), F.size(e) - 1), F.slice(e, F.lit(2), F.size(e) - 1), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    cells = edges.select("xs", F.posexplode(pairs(F.col("ys"))).alias("south_row", "y")).select("south_row", "y", F.posexplode(pairs(F.col("xs"))).alias("col", "x"))
    count = lambda span, res: F.greatest(F.lit(1), F.ceil(span / F.lit(res)).cast("int"))
    return cells.select("south_row", "col", F.col("x.lo").alias("min_x"), F.col("y.lo").alias("min_y"), F.col("x.hi").alias("max_x"), F.col("y.hi").alias("max_y"), count(F.col("x.hi") - F.col("x.lo"), rx).alias("width"), count(F.col("y.hi") - F.col("y.lo"), ry).alias("height"))


def inferred_grid(span_x: Column, span_y: Column, chunk: tuple[int, int], resolution: tuple[float, float]) -> tuple[Column, Column]:
    """Rows and columns of chunks that cover spans, at least one each."""
    rows = F.greatest(F.lit(1), F.ceil(span_y / F.lit(chunk[1] * resolution[1])).cast("int"))
    return rows, F.greatest(F.lit(1), F.ceil(span_x / F.lit(chunk[0] * resolution[0])).cast("int"))


def aligned_plan(spark: SparkSession, box: BBox, tile: tuple[int, int], origin: tuple[float, float], units_per_pixel: float) -> DataFrame:
    """Tiles of a fixed grid from ``origin`` that cover a box; an extension, indices may be negative."""
    width, height = positive_pair(tile, "tile_size")
    if units_per_pixel <= 0:
        raise InvalidRequestError("resolution is positive")
    sx, sy = width * units_per_pixel, height * units_per_pixel
    c0, c1 = math.floor((box.min_x - origin[0]) / sx), math.ceil((box.max_x - origin[0]) / sx)
    r0, r1 = math.floor((box.min_y - origin[1]) / sy), math.ceil((box.max_y - origin[1]) / sy)
    cells = spark.range(r0, r1).withColumnRenamed("id", "south_row").select(F.col("south_row").cast("int").alias("south_row"), F.explode(F.sequence(F.lit(c0), F.lit(c1 - 1))).alias("col"))
    x, y = F.lit(origin[0]) + F.col("col") * F.lit(sx), F.lit(origin[1]) + F.col("south_row") * F.lit(sy)
    return cells.select("south_row", "col", x.alias("min_x"), y.alias("min_y"), (F.lit(origin[0]) + (F.col("col") + 1) * F.lit(sx)).alias("max_x"), (F.lit(origin[1]) + (F.col("south_row") + 1) * F.lit(sy)).alias("max_y"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def organised(plan: DataFrame, rows: int) -> DataFrame:
    """The plan with ``tile_row`` (from the north) and ``tile_col``: arithmetic on its own indices, no global sort."""
    return plan.withColumn("tile_row", F.lit(rows - 1) - F.col("south_row")).withColumn("tile_col", F.col("col"))


def organised_by_place(tiles: DataFrame, rows: int, cols: int) -> DataFrame:
    """``tile_row`` and ``tile_col`` of tiles without plan indices, north to south, then west to east.

    Ranks come from the distinct edges of each axis, of which there are rows and cols, so no window or sort
    sees all tiles; a set that is no full matrix is an error.
    """
    ys, xs = tiles.select("max_y").distinct(), tiles.select("min_x").distinct()
    found = tiles.agg(F.count(F.lit(1)).alias("n"), F.count("max_y").alias("boxes")).first()
    if found["boxes"] != found["n"]:
        raise InvalidRequestError("a tile has no box")
    edges, places = (ys.count(), xs.count()), tiles.select("max_y", "min_x").distinct().count()
    if edges != (rows, cols) or not found["n"] == places == rows * cols:
        raise InvalidRequestError(f"{found['n']} tiles don't make a matrix of {rows} x {cols}")
    rank = lambda order: (F.row_number().over(Window.orderBy(order)) - 1).cast("int")
    placed = tiles.join(ys.withColumn("tile_row", rank(F.desc("max_y"))), "max_y").join(xs.withColumn("tile_col", rank(F.asc("min_x"))), "min_x")
    return placed.select(*tiles.columns, "tile_row", "tile_col")


def mosaic_offsets(plan: DataFrame, rows: int) -> DataFrame:
    """Pixel offsets of every tile of an organised plan.

    The running sums are over the heights of the rows and the widths of the columns, of which there are
    rows + cols; tiles get them by two joins on their indices.
    """
    placed = organised(plan, rows)

    def before(index: str, size: str, name: str) -> DataFrame:
        order = Window.orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
        lines = placed.select(index, size).distinct()
        return lines.select(index, F.coalesce(F.sum(size).over(order), F.lit(0)).cast("long").alias(name))

    return placed.join(before("tile_row", "height", "row_off"), "tile_row").join(before("tile_col", "width", "col_off"), "tile_col").select(*placed.columns, "row_off", "col_off")


def coordinate(low: Column, high: Column, n: Column, index: Column, *, descending: bool = False, centre: bool = False) -> Column:
    """The label of a pixel: evenly from ``low`` to ``high``, both included; or pixel centres."""
    at = n - 1 - index if descending else index
    if centre:
        return low + (at + F.lit(0.5)) * ((high - low) / n)
    return F.when(n == 1, low).when(at == n - 1, high).otherwise(at * ((high - low) / (n - 1)) + low)
