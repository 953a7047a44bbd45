"""The entry points: a service, a box and a grid in; one labelled two-dimensional array out."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidRequestError, UnknownServiceError
from .model import ArrayRequest, ServiceConfig, ServiceType
from .operators.pixels import as_dtype, mosaic, nan_count, nan_mean
from .plans.tiles import coordinate, grid_plan, mosaic_offsets, resolution_plan
from .sources.coverage import load_tiles
from .sources.decode import Decoder, resolve_decoder
from .sources.services import get_service
from .sources.transport import Transport


class CoverageArray:
    """A lazy array with dimensions (y, x); tiles are fetched when a result is asked for.

    Each result fetches the tiles anew, unless they are in the cache folder or kept by ``persist``.
    """

    dims = ("y", "x")

    def __init__(self, spark: SparkSession, request: ArrayRequest, tiles: DataFrame, attrs: dict[str, str], dtype: str):
        self._spark, self.request, self._tiles, self.attrs, self.dtype = spark, request, tiles, attrs, dtype
        plan = resolution_plan(spark, request.bbox, request.chunk_size, request.resolution) if request.resolution else grid_plan(spark, request.bbox, request.chunk_size, request.grid_shape)
        self._plan = mosaic_offsets(plan, request.grid_shape[0])
        self._shape: tuple[int, int] | None = None

    @property
    def shape(self) -> tuple[int, int]:
        """(height, width) in pixels; from the plan alone."""
        if self._shape is None:
            self._shape = tuple(self._plan.agg(F.max(F.col("row_off") + F.col("height")), F.max(F.col("col_off") + F.col("width"))).first())
        return self._shape

    @property
    def chunks(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Heights of the tile rows, from the north, and widths of the columns."""
        rows = self._plan.select("tile_row", "height").distinct().orderBy("tile_row").collect()
        cols = self._plan.select("tile_col", "width").distinct().orderBy("tile_col").collect()
        return tuple(r[1] for r in rows), tuple(c[1] for c in cols)

    def get_shape(self) -> tuple[int, int]:
        return self.shape

    def get_dtype(self) -> str:
        return self.dtype

    def persist(self) -> CoverageArray:
        """Keep the tiles on the executors after the first result; ``unpersist`` lets them go."""
        self._tiles = self._tiles.persist()
        return self

    def unpersist(self) -> CoverageArray:
        self._tiles = self._tiles.unpersist()
        return self

    def set_data(self, tiles: DataFrame) -> CoverageArray:
        """This array with other samples: a row for each tile of the plan, with the columns of ``tiles``."""
        missing = set(self._tiles.columns) - set(tiles.columns)
        if missing:
            raise InvalidRequestError(f"tiles without {sorted(missing)}")
        return CoverageArray(self._spark, self.request, tiles.select(*self._tiles.columns), self.attrs, self.dtype)

    def tiles(self) -> DataFrame:
        """A row for each tile, with its samples."""
        return self._tiles

    def pixels(self, *, compat_y: bool = False, centre: bool = False) -> DataFrame:
        """``y_idx, x_idx, y, x, value``; y falls with y_idx, or rises with ``compat_y``."""
        height, width = self.shape
        box = self.request.bbox
        y = coordinate(F.lit(box.min_y), F.lit(box.max_y), F.lit(height), F.col("y_idx"), descending=not compat_y, centre=centre)
        x = coordinate(F.lit(box.min_x), F.lit(box.max_x), F.lit(width), F.col("x_idx"), centre=centre)
        return mosaic(self._tiles, self._plan).select("y_idx", "x_idx", y.alias("y"), x.alias("x"), as_dtype(F.col("value"), self.dtype).alias("value"))

    def agg(self, *aggregates: Any) -> DataFrame:
        """Aggregates over the column ``value``."""
        return self._tiles.select(F.explode("values").alias("value")).agg(*aggregates)

    def mean(self) -> float | None:
        """Mean of the samples that aren't NaN."""
        return self.agg(nan_mean(F.col("value"))).first()[0]

    def null_count(self) -> int:
        """Number of NaN samples."""
        return self.agg(nan_count(F.col("value"))).first()[0]

    def process(self, what: str) -> float | None:
        """``mean``, ``min``, ``max`` or ``sum`` of the samples that aren't NaN."""
        functions = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
        if what not in functions:
            raise ValueError(f"unknown process: {what}")
        return self.agg(functions[what](F.when(~F.isnan("value"), F.col("value").cast("double")))).first()[0]

    def compute(self) -> np.ndarray:
        """The whole array on the driver; for arrays that fit there."""
        out = np.full(self.shape, np.nan, np.float32)
        places = {(r["tile_row"], r["tile_col"]): (r["row_off"], r["col_off"]) for r in self._plan.collect()}
        for tile in self._tiles.toLocalIterator():
            y, x = places[tile["tile_row"], tile["tile_col"]]
            out[y : y + tile["height"], x : x + tile["width"]] = np.array(tile["values"], np.float32).reshape(tile["height"], tile["width"])
        return out if self.dtype == "float32" else out.astype(self.dtype)


def create_array(spark: SparkSession, service: str | ServiceConfig, bbox: Any, crs: Any = None, *, service_type: ServiceType | str | None = None, dtype: str = "float32", tile_decoder: Decoder | None = None, transport: Transport | None = None, validate: bool = False, **options: Any) -> CoverageArray:
    """A lazy array of a service's coverage over a box.

    ``options``: chunk_size (width, height), grid_shape (rows, cols), resolution, output_format,
    cache_dir, coverage_id, and whatever the service's requests take. The decoder is resolved here,
    before any fetch; ``validate`` asks the service for its description first.
    """
    if isinstance(service, ServiceConfig) and service_type and service.service_type and ServiceType(service_type) is not service.service_type:
        raise UnknownServiceError("the configuration is for another type of service")
    request = ArrayRequest.of(service, bbox, crs, **options)
    own = get_service(service, service_type, coverage_id=request.coverage_id, transport=transport)
    decoder = resolve_decoder(request.output_format or getattr(own, "output_format", None), tile_decoder)
    if validate:
        own.validate(spark)
    tiles = load_tiles(own.tile_requests(spark, request), cache_dir=request.cache_dir, decoder=decoder, transport=transport)
    return CoverageArray(spark, request, tiles, request.attributes(own.service_type), dtype)


def load_array(spark: SparkSession, *args: Any, **options: Any) -> np.ndarray:
    """``create_array``, computed at once."""
    return create_array(spark, *args, **options).compute()
