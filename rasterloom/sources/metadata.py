"""Service metadata XML as typed records.

Each document is parsed once, in Arrow batches, into the texts at some paths; all that follows from
the texts (trimming, known values, numbers, times) is column expressions. Spark's own XML functions
parse a document again for each path, and don't see what follows the root's end.

Elements are found by local name, so documents of either generation of the standard's
namespaces read alike. A malformed document gives NULL, or an error with ``strict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.requests import supported
from ..model import Crs, Format

# Names of elements, the last of them within the one before, whose first text is wanted.
_FIRST = {
    "title": ("ServiceIdentification", "Title"),
    "abstract": ("ServiceIdentification", "Abstract"),
    "provider": ("ServiceProvider", "ProviderName"),
    "primary_contact": ("ContactPersonPrimary", "ContactPerson"),
    "other_contact": ("ServiceContact", "IndividualName"),
    "identifier": (None, "identifier"),
    "coverage_id": (None, "CoverageId"),
    "name": ("CoverageDescription", "name"),
    "description": ("CoverageDescription", "description"),
    "lower": ("Envelope", "lowerCorner"),
    "upper": ("Envelope", "upperCorner"),
    "native_crs": (None, "NativeCRS"),
    "begin": ("TimePeriod", "beginPosition"),
    "end": ("TimePeriod", "endPosition"),
}
# The same for elements of which all texts are wanted.
_ALL = {
    "keywords": ("Keywords", "Keyword"),
    "formats": (None, "SupportedFormat"),
    "more_formats": (None, "formatSupported"),
    "systems": (None, "SupportedCRS"),
    "more_systems": (None, "crsSupported"),
}
_STRING, _STRINGS = T.StringType(), T.ArrayType(T.StringType())
_SUMMARY = T.StructType([T.StructField("identifier", _STRING), T.StructField("title", _STRING), T.StructField("abstract", _STRING), T.StructField("keywords", _STRINGS)])
_PARSED = T.StructType([T.StructField("ok", T.BooleanType()), *(T.StructField(n, _STRING) for n in _FIRST), *(T.StructField(n, _STRINGS) for n in (*_ALL, "operations")), T.StructField("coverages", T.ArrayType(_SUMMARY))])


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _text(element: ElementTree.Element | None) -> str | None:
    """All text within an element, trimmed; None if there is none."""
    return ("".join(element.itertext()).strip() or None) if element is not None else None


def _summary(element: ElementTree.Element) -> dict[str, Any]:
    found: dict[str, ElementTree.Element] = {}
    for child in element:
        found.setdefault(_local(child), child)
    words = [_text(k) or "" for k in found.get("Keywords", ()) if _local(k) == "Keyword"]
    return {"identifier": _text(found.get("Identifier")) or _text(found.get("CoverageId")), "title": _text(found.get("Title")), "abstract": _text(found.get("Abstract")), "keywords": words}


_BY_NAME: dict[str, list[tuple[str | None, str, bool]]] = {}
for _paths, _once in ((_FIRST, True), (_ALL, False)):
    for _field, (_parent, _name) in _paths.items():
        _BY_NAME.setdefault(_name, []).append((_parent, _field, _once))


def parse(xml: str | None) -> dict[str, Any]:
    """The texts of one document, or only that it can't be parsed."""
    try:
        root = ElementTree.fromstring((xml or "").encode("utf-8"))
    except ElementTree.ParseError:
        return {"ok": False, "coverages": []}
    out: dict[str, Any] = {"ok": True, "operations": [], "coverages": [], **{n: [] for n in _ALL}}
    stack = [(root, None)]
    while stack:
        element, parent = stack.pop()
        name = _local(element)
        for wanted, key, once in _BY_NAME.get(name, ()):
            if wanted is None or wanted == parent:
                if once:
                    out.setdefault(key, _text(element))
                elif (element.text or "").strip():
                    out[key].append(element.text.strip())
        if name == "Operation" and element.get("name"):
            out["operations"].append(element.get("name"))
        elif name == "CoverageSummary" and parent == "Contents":
            record = _summary(element)
            if record["identifier"]:
                out["coverages"].append(record)
        stack += [(child, name) for child in reversed(element)]
    return out


def _parsed(documents: DataFrame, xml: str, strict: bool) -> tuple[DataFrame, Column]:
    """The documents' other columns, and a column of their texts."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, other = to_arrow_type(_PARSED), [f for f in documents.schema.fields if f.name != xml]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x) for x in batch.column(batch.schema.get_field_index(xml)).to_pylist()]
            if strict and not all(f["ok"] for f in found):
                raise ValueError("malformed service metadata")
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in other]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind)], [*(f.name for f in other), "__texts"])

    return documents.mapInArrow(run, T.StructType([*other, T.StructField("__texts", _PARSED)])), F.col("__texts")


def formats(found: Column) -> Column:
    """Supported MIME types that are known, in order."""
    return supported(F.concat(found["formats"], found["more_formats"]), Format)


def crs_list(found: Column) -> Column:
    """Supported systems that are known, in order; URIs that end in an EPSG code count."""
    return supported(F.transform(F.concat(found["systems"], found["more_systems"]), _crs_text), Crs)


def _crs_text(value: Column) -> Column:
    code = F.regexp_extract(value, r"EPSG(?:/\d+/|:+)(\d+)$", 1)
    return F.when(code == "", value).otherwise(F.concat(F.lit("EPSG:"), code))


def spatial_extent(found: Column) -> Column:
    """The first envelope as a box: the corners' first two numbers are x and y; NULL if incomplete or without area."""
    low, high = (F.split(found[c], r"\s+") for c in ("lower", "upper"))
    number = lambda v, i: F.try_element_at(v, F.lit(i)).try_cast("double")
    clean = lambda v: ~F.exists(v, lambda x: x.try_cast("double").isNull())
    box = F.struct(number(low, 1).alias("min_x"), number(low, 2).alias("min_y"), number(high, 1).alias("max_x"), number(high, 2).alias("max_y"), native_crs(found).alias("crs"))
    return F.when(clean(low) & clean(high) & (box["min_x"] < box["max_x"]) & (box["min_y"] < box["max_y"]), box)


def native_crs(found: Column) -> Column:
    """The declared system if it is a known one, else EPSG:4326."""
    text = _crs_text(found["native_crs"])
    return F.coalesce(F.when(text.isin([c.value for c in Crs]), text), F.lit(Crs.WGS84.value))


def moment(text: Column) -> Column:
    """A timestamp from ISO 8601 text, NULL if it is none."""
    return F.trim(text).try_cast("timestamp")


def temporal_extent(found: Column) -> Column:
    """Begin and end of the first period; NULL if neither is a time, or if the end precedes the begin."""
    start, end = moment(found["begin"]), moment(found["end"])
    period = F.struct(start.alias("start_time"), end.alias("end_time"))
    return F.when((start.isNotNull() | end.isNotNull()) & F.coalesce(end >= start, F.lit(True)), period)


def capabilities(documents: DataFrame, xml: str = "xml", service_url: str = "", *, strict: bool = False) -> DataFrame:
    """One record for each document; all other columns are kept."""
    parsed, x = _parsed(documents, xml, strict)
    record = {
        "service_title": F.when(x["ok"], F.coalesce(x["title"], F.lit("WCS Service"))),
        "service_abstract": x["abstract"],
        "service_keywords": x["keywords"],
        "service_provider": x["provider"],
        "service_contact": F.coalesce(x["primary_contact"], x["other_contact"]),
        "service_url": F.lit(service_url.rstrip("/")),
        "supported_operations": x["operations"],
        "supported_formats": formats(x),
        "supported_crs": crs_list(x),
        "coverages": x["coverages"],
    }
    return parsed.select(*(c for c in documents.columns if c != xml), *(c.alias(n) for n, c in record.items()))


def coverage_descriptions(documents: DataFrame, xml: str = "xml", *, strict: bool = False) -> DataFrame:
    """One record for each document with a coverage description; without an identifier it is NULL, or an error with ``strict``."""
    parsed, x = _parsed(documents, xml, strict)
    identifier = F.coalesce(x["identifier"], x["coverage_id"])
    if strict:
        identifier = F.coalesce(identifier, F.raise_error(F.lit("no coverage identifier")).cast("string"))
    record = {
        "identifier": identifier,
        "title": x["name"],
        "abstract": x["description"],
        "keywords": x["keywords"],
        "supported_crs": crs_list(x),
        "supported_formats": formats(x),
        "spatial_extent": spatial_extent(x),
        "temporal_extent": temporal_extent(x),
    }
    return parsed.select(*(c for c in documents.columns if c != xml), *(c.alias(n) for n, c in record.items()))
