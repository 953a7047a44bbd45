"""Service URLs, request parameters and their texts, as column expressions.

What a task or a data source needs without a session is there a second time in plain Python
(``plain_params``, ``plain_cache_key``), with the same texts.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Crs, Format, ServiceType


def number_text(value: Column) -> Column:
    """A double in plain decimals, as short as it is exact, for magnitudes in [1e-4, 1e16).

    Where a cast gives plain decimals it is used, as the general form costs some ten times as much.
    """
    size = F.abs(value)
    return F.when((size >= 1e-3) & (size < 1e7), value.cast("string")).otherwise(F.call_function("format_number", value, F.lit("0.0" + "#" * 20)))


def plain_number(value: float) -> str:
    """``number_text`` of one number."""
    text = format(Decimal(repr(float(value))), "f")
    return text if "." in text else text + ".0"


def plain_axes(crs: Crs) -> tuple[str, str]:
    """``axis_labels`` of one system."""
    return {Crs.BRITISH_GRID: ("E", "N"), Crs.WEB_MERCATOR: ("X", "Y")}.get(crs, ("Long", "Lat"))


def plain_params(coverage_id: str, box: tuple[float, float, float, float], crs: Crs, fmt: str, width: int, height: int, version: str = "2.0.1") -> dict[str, list[str]]:
    """``request_params`` of one tile."""
    x, y = plain_axes(crs)
    low_x, low_y, high_x, high_y = map(plain_number, box)
    one = {"service": "WCS", "version": version, "request": "GetCoverage", "coverageId": coverage_id, "format": fmt, "width": str(width), "height": str(height), "subsettingCRS": crs.value}
    return {k: [v] for k, v in one.items()} | {"subset": [f"{x}({low_x},{high_x})", f"{y}({low_y},{high_y})"]}


def plain_cache_key(url: str, params: dict[str, list[str]], fmt: str, box: tuple[float, float, float, float], width: int, height: int) -> str:
    """``cache_key`` of one tile."""
    entries = "&".join(sorted(f"{k}={','.join(v)}" for k, v in params.items()))
    return hashlib.sha256("|".join([url, entries, fmt, *map(plain_number, box), str(width), str(height)]).encode()).hexdigest()


def axis_labels(crs: Column) -> tuple[Column, Column]:
    """Names of the x and y axes."""
    x = F.when(crs == Crs.BRITISH_GRID.value, "E").when(crs == Crs.WEB_MERCATOR.value, "X").otherwise("Long")
    y = F.when(crs == Crs.BRITISH_GRID.value, "N").when(crs == Crs.WEB_MERCATOR.value, "Y").otherwise("Lat")
    return x, y


def subset(min_x: Column, min_y: Column, max_x: Column, max_y: Column, crs: Column) -> Column:
    """The two ``Axis(min,max)`` texts of a box."""
    x, y = axis_labels(crs)

    def part(axis: Column, low: Column, high: Column) -> Column:
        return F.concat(axis, F.lit("("), number_text(low), F.lit(","), number_text(high), F.lit(")"))

    return F.array(part(x, min_x, max_x), part(y, min_y, max_y))


def request_params(coverage_id: Column, box: tuple[Column, Column, Column, Column], crs: Column, fmt: Column, width: Column, height: Column, *, version: str = "2.0.1", extra: dict[str, str | list[str]] | None = None) -> Column:
    """Parameters of a GetCoverage request; each value is a list, as ``subset`` has two. ``extra`` comes last and wins."""
    one = {"service": F.lit("WCS"), "version": F.lit(version), "request": F.lit("GetCoverage"), "coverageId": F.coalesce(F.nullif(coverage_id, F.lit("")), F.raise_error(F.lit("a coverage id is needed")).cast("string")), "format": fmt, "width": width.cast("string"), "height": height.cast("string"), "subsettingCRS": crs}
    entries: dict[str, Column] = {k: F.array(v) for k, v in one.items()} | {"subset": subset(*box, crs)}
    for k, v in (extra or {}).items():
        entries[k] = F.array(*(F.lit(str(x)) for x in (v if isinstance(v, (list, tuple)) else [v])))
    return F.create_map(*(c for k, v in entries.items() for c in (F.lit(k), v)))


def base_url(url: Column) -> Column:
    """Without ``/`` and ``?`` at the end."""
    return F.regexp_replace(url, "[/?]+$", "")


def service_type(url: Column, fallback: str | None = None) -> Column:
    """WCS, WMS or WMTS by the ``service`` parameter, else by the path, else ``fallback`` (null without)."""
    low = F.lower(url)
    named = F.upper(F.nullif(F.try_parse_url(low, F.lit("QUERY"), F.lit("service")), F.lit("")))
    path = F.try_parse_url(low, F.lit("PATH"))
    by_path = F.when(F.contains(path, F.lit("wcs")), "WCS").when(F.contains(path, F.lit("wms")), "WMS").when(F.contains(path, F.lit("wmts")), "WMTS")
    return F.coalesce(F.when(named.isin([s.value for s in ServiceType]), named), by_path, F.lit(fallback))


def format_or_null(value: Column) -> Column:
    """A supported MIME type, or null."""
    return F.when(value.isin([f.value for f in Format]), value)


def supported(values: Column, known: type[Format] | type[Crs]) -> Column:
    """The known texts of a list, in order, repeated ones kept."""
    return F.filter(values, lambda v: F.trim(v).isin([m.value for m in known]))


def cache_key(url: Column, params: Column, fmt: Column, box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> Column:
    """SHA-256 over a canonical text of what identifies a tile; headers don't."""
    entries = F.array_sort(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))))
    return F.sha2(F.concat_ws("|", url, F.array_join(entries, "&"), fmt, *(number_text(v) for v in box), width.cast("string"), height.cast("string")), 256)
