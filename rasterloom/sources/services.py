"""Services: a registry of types, and the coverage service with its metadata and request plans."""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequestError, MetadataError, UnknownServiceError
from ..functions.requests import cache_key, plain_params, request_params
from ..model import ArrayRequest, BBox, Crs, Format, ServiceConfig, ServiceType
from ..plans.tiles import grid_plan, organised, resolution_plan
from . import metadata
from .transport import Request, Response, Transport, fetch


class Service(Protocol):
    """What a service has to offer: the requests of an array's tiles, one row each."""

    service_type: ServiceType

    def tile_requests(self, spark: SparkSession, request: ArrayRequest) -> DataFrame: ...


_REGISTRY: dict[ServiceType, Callable[..., Any]] = {}


def register_service(kind: ServiceType) -> Callable[[type], type]:
    """Class decorator: make a class the service of a type."""

    def register(cls: type) -> type:
        _REGISTRY[kind] = cls
        return cls

    return register


def detect_service_type(url: str, fallback: ServiceType | None = None) -> ServiceType:
    """By the ``service`` parameter, else the path, else the fallback; without any it is an error."""
    parts = urllib.parse.urlparse(url.lower())
    for name in urllib.parse.parse_qs(parts.query).get("service", []):
        if name.upper() in ServiceType.__members__:
            return ServiceType[name.upper()]
    for kind in (ServiceType.WCS, ServiceType.WMS, ServiceType.WMTS):
        if kind.value.lower() in parts.path:
            return kind
    if fallback is None:
        raise UnknownServiceError(f"can't tell the type of service of {url}")
    return fallback


def get_service(service: str | ServiceConfig, kind: ServiceType | str | None = None, **options: Any) -> Service:
    """The registered service for a URL or configuration; a type that contradicts the configuration is an error."""
    config = service if isinstance(service, ServiceConfig) else ServiceConfig(base_url=service)
    wanted = ServiceType(kind) if kind else None
    if wanted and config.service_type and wanted is not config.service_type:
        raise UnknownServiceError(f"{wanted.value} was asked for, the service is configured as {config.service_type.value}")
    found = wanted or config.service_type or detect_service_type(config.base_url)
    if found not in _REGISTRY:
        raise UnknownServiceError(f"no service is registered for {found.value}")
    return _REGISTRY[found](config, **options)


@register_service(ServiceType.WCS)
class CoverageService:
    """A coverage service: metadata, one-shot coverages and tile requests."""

    service_type = ServiceType.WCS

    def __init__(self, config: ServiceConfig | str, *, coverage_id: str | None = None, layer_id: str | None = None, output_format: Format | str | None = None, crs: Crs | str | int | None = None, transport: Transport | None = None, **options: Any):
        config = config if isinstance(config, ServiceConfig) else ServiceConfig(base_url=config)
        self.config, self.options, self.transport = config, options, transport
        self.base_url = re.sub(r"[/?]+$", "", config.base_url)
        self.coverage_id = coverage_id or config.coverage_id or layer_id
        self.output_format = Format.of(output_format or config.output_format or Format.TIFF)
        self.crs = Crs.of(crs or config.crs or Crs.WGS84)

    @classmethod
    def from_url(cls, url: str, **options: Any) -> CoverageService:
        return cls(ServiceConfig(base_url=url), **options)

    def _id(self, coverage_id: str | None = None) -> str:
        found = coverage_id or self.coverage_id
        if not found:
            raise InvalidRequestError("a coverage id is needed")
        return found

    def _document(self, params: dict[str, Any]) -> str:
        got = fetch(Request(self.base_url, {k: [str(v)] for k, v in params.items()}, dict(self.config.headers)), self.transport)
        if not got.success:
            raise MetadataError(f"no metadata: {got.error_message}")
        return got.data.decode("utf-8")

    def get_capabilities(self, spark: SparkSession, **params: Any) -> DataFrame:
        """The service's record; one row."""
        xml = self._document({"service": "WCS", "version": self.config.version, "request": "GetCapabilities"} | params)
        return metadata.capabilities(spark.createDataFrame([(xml,)], "xml string"), service_url=self.base_url, strict=True)

    def describe_coverage(self, spark: SparkSession, coverage_id: str | None = None, **params: Any) -> DataFrame:
        """A coverage's record; one row."""
        xml = self._document({"service": "WCS", "version": self.config.version, "request": "DescribeCoverage", "coverageId": self._id(coverage_id)} | params)
        return metadata.coverage_descriptions(spark.createDataFrame([(xml,)], "xml string"), strict=True)

    def get_coverage(self, coverage_id: str, bbox: BBox, width: int, height: int, *, output_format: Any = None, crs: Any = None, **params: Any) -> Response:
        """One image in one attempt; failures are values."""
        system, fmt = Crs.of(crs or bbox.crs), Format.of(output_format or self.output_format)
        found = plain_params(self._id(coverage_id), bbox.bounds, system, fmt.value, width, height, self.config.version)
        found |= {k: [str(v)] for k, v in params.items()}
        return fetch(Request(self.base_url, found, dict(self.config.headers), fmt.value, bbox.bounds, width, height, retries=0), self.transport)

    def validate(self, spark: SparkSession) -> None:
        """Ask the service for its coverage's description; an error if it has none."""
        self.describe_coverage(spark).collect()

    def tile_requests(self, spark: SparkSession, request: ArrayRequest) -> DataFrame:
        """A row for each tile, as ``TILE_REQUEST`` has it."""
        coverage = self._id(request.options.get("coverage_id") or request.coverage_id)
        plan = resolution_plan(spark, request.bbox, request.chunk_size, request.resolution) if request.resolution else grid_plan(spark, request.bbox, request.chunk_size, request.grid_shape)
        rows = request.grid_shape[0]
        box = tuple(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
        fmt, crs = F.lit((request.output_format or self.output_format).value), F.lit(request.crs.value)
        params = request_params(F.lit(coverage), box, crs, fmt, F.col("width"), F.col("height"), version=request.options.get("version") or self.config.version, extra=request.options.get("params"))
        headers = request.options.get("headers") or {}
        header_map = F.create_map(*(F.lit(str(x)) for kv in headers.items() for x in kv)) if headers else F.create_map().cast("map<string,string>")
        placed = organised(plan, rows).withColumn("params", params)
        return placed.select("tile_row", "tile_col", F.lit(self.base_url).alias("url"), "params", header_map.alias("headers"), fmt.alias("output_format"), F.struct(*box, crs.alias("crs")).alias("bbox"), "width", "height", cache_key(F.lit(self.base_url), F.col("params"), fmt, box, F.col("width"), F.col("height")).alias("cache_key"))
