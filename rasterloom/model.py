"""Records of requests and tiles, their validation, and their Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

from .errors import InvalidRequestError


class Crs(str, Enum):
    """Coordinate reference systems that can be planned in and reprojected between."""

    WGS84 = "EPSG:4326"
    WEB_MERCATOR = "EPSG:3857"
    UTM_33N = "EPSG:32633"
    BRITISH_GRID = "EPSG:27700"

    @classmethod
    def of(cls, value: Crs | str | int) -> Crs:
        """From a member, ``EPSG:n`` in any case, ``"n"`` or n."""
        if isinstance(value, cls):
            return value
        text = str(value).strip().upper()
        try:
            return cls(text if text.startswith("EPSG:") else f"EPSG:{int(text)}")
        except ValueError as e:
            raise InvalidRequestError(f"unsupported CRS: {value!r}") from e


class Format(str, Enum):
    """Image formats of tiles."""

    TIFF = "image/tiff"
    PNG = "image/png"
    JPEG = "image/jpeg"

    @classmethod
    def of(cls, value: Format | str) -> Format:
        try:
            return cls(value)
        except ValueError as e:
            raise InvalidRequestError(f"unsupported format: {value!r}") from e

    @classmethod
    def of_or_none(cls, value: Any) -> Format | None:
        try:
            return cls(value)
        except ValueError:
            return None


class ServiceType(str, Enum):
    """Kinds of services that can be told from a URL."""

    WCS = "WCS"
    WMS = "WMS"
    WMTS = "WMTS"


@dataclass(frozen=True)
class BBox:
    """An axis-aligned box; x is longitude, easting or the like in every CRS."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float
    crs: Crs = Crs.WGS84

    def __post_init__(self) -> None:
        object.__setattr__(self, "crs", Crs.of(self.crs))
        for name in ("min_x", "min_y", "max_x", "max_y"):
            object.__setattr__(self, name, float(getattr(self, name)))
        if not (self.min_x < self.max_x and self.min_y < self.max_y):
            raise InvalidRequestError(f"box without area: {self.bounds}")

    @classmethod
    def of(cls, value: BBox | tuple[float, float, float, float], crs: Crs | str | int = Crs.WGS84) -> BBox:
        if isinstance(value, cls):
            return value
        if len(value) != 4:
            raise InvalidRequestError("a box has four numbers")
        return cls(*value, crs=Crs.of(crs))

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.min_x, self.min_y, self.max_x, self.max_y

    def intersects(self, other: BBox) -> bool:
        """Open overlap: boxes that only touch don't intersect. CRSs are not compared."""
        return self.min_x < other.max_x and self.max_x > other.min_x and self.min_y < other.max_y and self.max_y > other.min_y


def positive_pair(value: Any, name: str) -> tuple[int, int]:
    """Two positive whole numbers."""
    if not isinstance(value, (tuple, list)) or len(value) != 2:
        raise InvalidRequestError(f"{name} is a pair, not {value!r}")
    pair = int(value[0]), int(value[1])
    if min(pair) <= 0:
        raise InvalidRequestError(f"{name} is positive, not {value!r}")
    return pair


def resolution_pair(value: Any) -> tuple[float, float] | None:
    """One positive number for both axes, or two."""
    if value is None:
        return None
    pair = (float(value), float(value)) if isinstance(value, (int, float)) else tuple(map(float, value))
    if len(pair) != 2 or min(pair) <= 0:
        raise InvalidRequestError(f"resolution is positive, not {value!r}")
    return pair


@dataclass(frozen=True)
class ServiceConfig:
    """What is known of a service; unset values fall through to the request's or the built-in ones."""

    base_url: str
    service_type: ServiceType | None = None
    crs: Crs | None = None
    output_format: Format | None = None
    headers: dict[str, str] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)
    chunk_size: tuple[int, int] | None = None
    grid_shape: tuple[int, int] | None = None
    cache_dir: str | None = None
    resolution: tuple[float, float] | float | None = None
    coverage_id: str | None = None
    version: str = "2.0.1"

    @classmethod
    def from_url(cls, url: str, **values: Any) -> ServiceConfig:
        return cls(base_url=url, **values)

    def tile_options(self) -> dict[str, Any]:
        """The set values that go into each tile's request."""
        found = {"crs": self.crs, "output_format": self.output_format, "headers": self.headers, "params": self.params, "resolution": self.resolution, "coverage_id": self.coverage_id, "version": self.version}
        return {k: v for k, v in found.items() if v}


DEFAULT_CHUNK = (256, 256)


@dataclass(frozen=True)
class ArrayRequest:
    """A logical query for one labelled array; chunk sizes are (width, height)."""

    service_url: str
    bbox: BBox
    crs: Crs
    chunk_size: tuple[int, int]
    grid_shape: tuple[int, int]
    resolution: tuple[float, float] | None
    output_format: Format | None
    cache_dir: str | None
    coverage_id: str | None
    options: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, service: str | ServiceConfig, bbox: Any, crs: Any = None, *, chunk_size: Any = None, grid_shape: Any = None, resolution: Any = None, output_format: Any = None, cache_dir: str | None = None, coverage_id: str | None = None, **options: Any) -> ArrayRequest:
        """Explicit values first, then the configuration's, then the built-in ones.

        A configuration in another CRS than the array's is an error rather than a silent relabelling.
        """
        from .functions.crs import reproject_bbox

        config = service if isinstance(service, ServiceConfig) else ServiceConfig(base_url=service)
        target = Crs.of(crs or config.crs or Crs.WGS84)
        if config.crs and Crs.of(config.crs) != target:
            raise InvalidRequestError(f"the service is configured for {config.crs}, the array for {target.value}")
        box = BBox.of(bbox, target)
        box = box if box.crs == target else reproject_bbox(box, target)
        chunk = positive_pair(chunk_size or config.chunk_size or DEFAULT_CHUNK, "chunk_size")
        res = resolution_pair(resolution or config.resolution)
        wanted = grid_shape or config.grid_shape
        from .plans.tiles import resolution_edges

        if res:
            planned = len(resolution_edges(box.min_y, box.max_y, chunk[1], res[1], min(res))) - 1, len(resolution_edges(box.min_x, box.max_x, chunk[0], res[0], min(res))) - 1
            grid = positive_pair(wanted, "grid_shape") if wanted else planned
            if grid != planned:
                raise InvalidRequestError(f"grid_shape {grid} disagrees with the {planned} that the resolution gives")
        else:
            grid = positive_pair(wanted or (1, 1), "grid_shape")
        fmt = output_format or config.output_format
        cache = cache_dir or config.cache_dir
        merged = config.tile_options() | options
        return cls(config.base_url.rstrip("/?"), box, target, chunk, grid, res, Format.of(fmt) if fmt else None, str(Path(cache).expanduser()) if cache else None, coverage_id or config.coverage_id or options.get("layer_id"), merged)

    def attributes(self, service_type: ServiceType) -> dict[str, str]:
        """Attributes of the array: those that are always known, and format and coverage where set."""
        found = {"crs": self.crs.value, "service_url": self.service_url, "service_type": service_type.value, "output_format": self.output_format and self.output_format.value, "coverage_id": self.coverage_id}
        return {k: v for k, v in found.items() if v}

    def with_options(self, **options: Any) -> ArrayRequest:
        return replace(self, options=self.options | options)


BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("min_x", "min_y", "max_x", "max_y")] + [T.StructField("crs", T.StringType())])
TILE_REQUEST = T.StructType([T.StructField("tile_row", T.IntegerType()), T.StructField("tile_col", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("output_format", T.StringType()), T.StructField("bbox", BBOX), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("cache_key", T.StringType())])
TILE_RESPONSE = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("content_type", T.StringType()), T.StructField("status_code", T.IntegerType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("url", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("error_message", T.StringType())])
PIXELS = T.StructType([T.StructField("y_idx", T.LongType()), T.StructField("x_idx", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.DoubleType()), T.StructField("value", T.FloatType())])
