"""Loading tiles in tasks, and coverages as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..errors import DecodeError, InvalidRequestError
from ..functions.requests import plain_cache_key, plain_params
from ..model import BBox, Format, positive_pair
from . import cache
from .decode import Decoder, resolve_decoder
from .transport import Request, Transport, fetch

TILE_PIXELS = "tile_row int, tile_col int, width int, height int, success boolean, error_message string, values array<float>"


def downsample(array: np.ndarray, width: int, height: int) -> np.ndarray:
    """Block means of a larger array; its sides must be whole multiples of the target's."""
    if array.ndim != 2:
        raise DecodeError(f"a tile has two dimensions, not {array.ndim}")
    if array.shape == (height, width):
        return array
    h, w = array.shape
    if h < height or w < width or h % height or w % width:
        raise DecodeError(f"a tile of {w} x {h} can't be downsampled to {width} x {height}")
    return array.reshape(height, h // height, width, w // width).mean(axis=(1, 3), dtype=np.float64).astype(np.float32)


def load_tile(request: Request, key: str, cache_dir: str | None, decode: Decoder, transport: Transport | None = None) -> tuple[bool, str | None, np.ndarray]:
    """Cache, else fetch; decode; downsample. A tile that can't be had or read is NaN of the planned size, and isn't cached."""
    data = cache.read(cache_dir, key) if cache_dir else None
    cached, error = data is not None, None
    if not cached:
        got = fetch(request, transport)
        data, error = got.data, None if got.success else got.error_message
    if error is None:
        try:
            array = downsample(np.asarray(decode(data), np.float32), request.width, request.height)
        except DecodeError as e:
            error = f"Decode error: {e}"
    if error is not None:
        return False, error, np.full((request.height or 0, request.width or 0), np.nan, np.float32)
    if cache_dir and data and not cached:
        cache.write(cache_dir, key, data)
    return True, None, array


def _rows(found: list[tuple[dict, tuple[bool, str | None, np.ndarray]]]) -> pa.RecordBatch:
    """``TILE_PIXELS`` of loaded tiles."""
    tiles, loaded = zip(*found, strict=True)
    whole = [pa.array([t[c] for t in tiles], pa.int32()) for c in ("tile_row", "tile_col", "width", "height")]
    samples = pa.array([array.ravel() for _, _, array in loaded], pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([*whole, pa.array([ok for ok, _, _ in loaded]), pa.array([e for _, e, _ in loaded], pa.string()), samples], [f.split()[0] for f in TILE_PIXELS.split(", ")])


def load_tiles(requests: DataFrame, *, cache_dir: str | None = None, decoder: Decoder | None = None, transport: Transport | None = None, retries: int = 3, timeout: float = 30.0, backoff: float = 0.0, tiles_per_task: int = 16) -> DataFrame:
    """``tile_pixels`` of tile requests. Each Arrow batch leaves as soon as its tile is there.

    The requests are dealt round-robin over tasks, as fetching, not reading the plan, takes the time.
    """
    n = requests.count()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                box = row["bbox"]
                request = Request(row["url"], dict(row["params"]), dict(row["headers"] or {}), row["output_format"], (box["min_x"], box["min_y"], box["max_x"], box["max_y"]), row["width"], row["height"], timeout, retries, backoff)
                yield _rows([(row, load_tile(request, row["cache_key"], cache_dir, resolve_decoder(row["output_format"], decoder), transport))])

    return requests.repartition(max(1, -(-n // tiles_per_task))).mapInArrow(load, TILE_PIXELS)


@dataclass
class _Grid:
    """The tiles of a box, by place alone."""

    url: str
    coverage_id: str
    box: BBox
    rows: int
    cols: int
    width: int
    height: int
    fmt: str
    version: str

    def tile(self, row: int, col: int) -> tuple[dict, Request, str]:
        box, south = self.box, self.rows - 1 - row
        dx, dy = (box.max_x - box.min_x) / self.cols, (box.max_y - box.min_y) / self.rows
        own = (box.min_x + col * dx, box.min_y + south * dy, box.max_x if col == self.cols - 1 else box.min_x + (col + 1) * dx, box.max_y if row == 0 else box.min_y + (south + 1) * dy)
        params = plain_params(self.coverage_id, own, box.crs, self.fmt, self.width, self.height, self.version)
        key = plain_cache_key(self.url, params, self.fmt, own, self.width, self.height)
        return {"tile_row": row, "tile_col": col, "width": self.width, "height": self.height}, Request(self.url, params, {}, self.fmt, own, self.width, self.height), key


@dataclass
class _Part(InputPartition):
    """Tiles ``first`` to ``last`` of the wanted rows times the wanted columns."""

    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, grid: _Grid, cache_dir: str | None, tiles_per_task: int):
        self.grid, self.cache_dir, self.tiles_per_task = grid, cache_dir, tiles_per_task
        self.decode = resolve_decoder(grid.fmt)
        self.wanted = {"tile_row": range(grid.rows), "tile_col": range(grid.cols)}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of ``tile_row`` and ``tile_col`` with numbers; other tiles are never asked for."""
        tests = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            name = f.attribute[0] if type(f) in (*tests, IsNotNull) and len(f.attribute) == 1 else None
            if name not in self.wanted:
                yield f
            elif type(f) is not IsNotNull:
                self.wanted[name] = [i for i in self.wanted[name] if tests[type(f)](i, f.value)]

    def partitions(self) -> list[InputPartition]:
        n = len(self.wanted["tile_row"]) * len(self.wanted["tile_col"])
        return [_Part(at, min(n, at + self.tiles_per_task)) for at in range(0, n, self.tiles_per_task)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows, cols = self.wanted["tile_row"], self.wanted["tile_col"]
        for at in range(partition.first, partition.last):
            tile, request, key = self.grid.tile(rows[at // len(cols)], cols[at % len(cols)])
            yield _rows([(tile, load_tile(request, key, self.cache_dir, self.decode))])


class CoverageSource(DataSource):
    """``spark.read.format("coverage")``: some tiles a partition, in Arrow batches.

    Options: url, coverage_id, bbox (four numbers with commas), crs, rows, cols, width, height,
    format, version, cache_dir, tiles_per_task. Filters on ``tile_row`` and ``tile_col`` reach the source.
    """

    @classmethod
    def name(cls) -> str:
        return "coverage"

    def schema(self) -> str:
        return TILE_PIXELS

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        for needed in ("url", "bbox", "coverage_id"):
            if not o.get(needed):
                raise InvalidRequestError(f"option {needed} is needed")
        box = BBox.of(tuple(map(float, o["bbox"].split(","))), o.get("crs", "EPSG:4326"))
        rows, cols, width, height, per_task = (int(o.get(k, d)) for k, d in (("rows", 1), ("cols", 1), ("width", 256), ("height", 256), ("tiles_per_task", 4)))
        positive_pair((rows, cols), "grid_shape")
        positive_pair((width, height), "chunk_size")
        grid = _Grid(o["url"].rstrip("/?"), o["coverage_id"], box, rows, cols, width, height, Format.of(o.get("format", "image/tiff")).value, o.get("version", "2.0.1"))
        return _Reader(grid, o.get("cache_dir"), max(1, per_task))


def register(spark: SparkSession) -> None:
    """Make ``coverage`` a format of the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CoverageSource)
