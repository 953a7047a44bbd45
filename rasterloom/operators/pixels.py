"""Operators on pixels.

``tile_pixels`` has a row for each tile, ``values`` in row-major order from the north-west
corner; ``pixels`` has a row for each pixel. Missing samples are NaN, NULL only after a
reduction; integer pixels use NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequestError

#: Spark types of pixel types; unsigned ones are widened, as Spark has none.
DTYPES = {"float32": "float", "float64": "double", "int8": "byte", "int16": "short", "int32": "int", "int64": "long", "uint8": "short", "uint16": "int", "uint32": "long"}


def clean(value: Column) -> Column:
    """NaN for what is not finite or beyond 1e20 in size, the usual fill values."""
    return F.when(F.isnan(value) | (F.abs(value) > 1e20), F.lit(float("nan"))).otherwise(value)


def or_nan_tile(success: Column, values: Column, width: Column, height: Column) -> Column:
    """A tile's samples, or NaN of its size where it could not be had."""
    return F.when(success, values).otherwise(F.array_repeat(F.lit(float("nan")).cast("float"), (width * height).cast("int")))


def as_dtype(value: Column, dtype: str) -> Column:
    """Samples in a pixel type; NaN and what doesn't fit become NULL in whole-number types."""
    if dtype not in DTYPES:
        raise InvalidRequestError(f"unknown pixel type: {dtype}")
    if dtype.startswith("float"):
        return value.cast(DTYPES[dtype])
    return F.when(~F.isnan(value), value.try_cast(DTYPES[dtype]))


def pixels_of(tiles: DataFrame, *keys: str) -> DataFrame:
    """A row for each sample: ``keys``, r, c, value."""
    return tiles.select(*keys, "width", F.posexplode("values").alias("pos", "value")).select(*keys, F.expr("pos div width").cast("int").alias("r"), (F.col("pos") % F.col("width")).cast("int").alias("c"), "value")


def block_mean(tiles: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """Tiles downsampled to (width, height) by the plain mean of each block; one NaN makes its block NaN.

    A tile that is smaller, or no whole multiple, is an error. It stays one row a tile, without a
    shuffle: blocks are folded inside the row's array.
    """
    if width <= 0 or height <= 0:
        raise InvalidRequestError("the target size is positive")
    fits = (F.col("width") >= width) & (F.col("height") >= height) & (F.col("width") % width == 0) & (F.col("height") % height == 0)
    checked = tiles.withColumn("values", F.when(fits, F.col("values")).otherwise(F.raise_error(F.lit(f"a tile can't be downsampled to {width} x {height}")).cast("array<float>")))
    # Other names, as the result's own width and height would be taken inside the lambdas below.
    checked = checked.select(*keys, F.col("width").alias("__w"), F.col("height").alias("__h"), "values")
    fx, fy, w, v = F.expr(f"__w div {width}"), F.expr(f"__h div {height}"), F.col("__w"), F.col("values")

    def block(i: Column) -> Column:
        top, left = F.floor(i / width) * fy, (i % width) * fx
        line = lambda dy: F.aggregate(F.slice(v, ((top + dy) * w + left + 1).cast("int"), fx.cast("int")), F.lit(0.0), lambda a, x: a + x)
        return F.aggregate(F.sequence(F.lit(0).cast("long"), (fy - 1).cast("long")), F.lit(0.0), lambda a, dy: a + line(dy)) / (fx * fy)

    means = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: block(i).cast("float"))
    return checked.select(*keys, F.lit(width).alias("width"), F.lit(height).alias("height"), F.when((w == width) & (F.col("__h") == height), v.cast("array<float>")).otherwise(means).alias("values"))


def nan_mean(value: Column) -> Column:
    """Mean of the samples that aren't NaN."""
    return F.avg(F.when(~F.isnan(value), value.cast("double")))


def nan_count(value: Column) -> Column:
    """Number of NaN samples."""
    return F.coalesce(F.sum(F.isnan(value).cast("long")), F.lit(0).cast("long"))


def any_invalid(value: Column) -> Column:
    """Whether a sample is not finite or beyond 1e20 in size."""
    return F.coalesce(F.bool_or(F.isnan(value) | (F.abs(value) > 1e20)), F.lit(False))


def mosaic(tiles: DataFrame, offsets: DataFrame) -> DataFrame:
    """``y_idx, x_idx, value`` of the whole array: each sample's place in its tile, plus the tile's offsets.

    ``offsets`` is a plan and has one row a tile, like ``tiles``; both are joined on the tile's place.
    """
    joined = tiles.join(offsets.select("tile_row", "tile_col", "row_off", "col_off"), ["tile_row", "tile_col"])
    samples = joined.select("row_off", "col_off", "width", F.posexplode("values").alias("pos", "value"))
    return samples.select((F.col("row_off") + F.expr("pos div width")).cast("long").alias("y_idx"), (F.col("col_off") + F.col("pos") % F.col("width")).cast("long").alias("x_idx"), "value")
