"""Predicates on boxes and time spans, and a join on intersecting boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Crs

BOUNDS = ("min_x", "min_y", "max_x", "max_y")


def intersects(a: str, b: str) -> Column:
    """Open overlap of the boxes under two column prefixes; touching edges don't count."""
    col = lambda p, n: F.col(f"{p}{n}")
    return (col(a, "min_x") < col(b, "max_x")) & (col(a, "max_x") > col(b, "min_x")) & (col(a, "min_y") < col(b, "max_y")) & (col(a, "max_y") > col(b, "min_y"))


def valid_bbox() -> Column:
    """A box with an area."""
    return (F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y"))


def valid_period(start: Column, end: Column) -> Column:
    """No end before its start; open ends are fine."""
    return F.coalesce(end >= start, F.lit(True))


def in_crs(geometries: DataFrame, crs: Crs) -> DataFrame:
    """Geometries as they are; one whose column ``crs`` names another system is an error when it is read."""
    other = F.raise_error(F.concat(F.lit(f"expected {crs.value}, found "), F.col("crs"))).cast("string")
    return geometries.withColumn("crs", F.when(F.col("crs") == crs.value, F.col("crs")).otherwise(other))


def intersecting(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of intersecting boxes, all columns of both sides.

    Both sides are entered in the cells of a grid that they touch, and joined on the cell. A pair
    is made only in the cell with the lower left corner of its overlap, so it comes once and no
    distinct is needed. ``cell`` should be about the size of a box: a box is entered
    ``(width / cell + 2) * (height / cell + 2)`` times at most.
    """
    low = lambda p, n: F.floor(F.col(f"{p}{n}") / F.lit(cell)).cast("long")

    def entered(df: DataFrame, p: str) -> DataFrame:
        own = df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns)).filter(F.col(f"{p}min_x").isNotNull() & F.col(f"{p}min_y").isNotNull())
        return own.withColumn(f"{p}cx", F.explode(F.sequence(low(p, "min_x"), low(p, "max_x")))).withColumn(f"{p}cy", F.explode(F.sequence(low(p, "min_y"), low(p, "max_y"))))

    a, b = entered(left, "a_"), entered(right, "b_")
    corner = lambda n: F.floor(F.greatest(f"a_{n}", f"b_{n}") / F.lit(cell)).cast("long")
    pairs = a.join(b, (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")) & intersects("a_", "b_"))
    return pairs.filter((F.col("a_cx") == corner("min_x")) & (F.col("a_cy") == corner("min_y"))).drop("a_cx", "a_cy", "b_cx", "b_cy")
