"""The coverage engine: plans, requests, pixels, decoders, transports, metadata and the entry points."""

import http.server
import math
import struct
import threading
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.api import create_array, load_array
from rasterloom.errors import DecodeError, InvalidRequestError, MetadataError, UnknownServiceError
from rasterloom.functions.crs import reproject
from rasterloom.model import ArrayRequest, BBox, Crs, Format, ServiceConfig, ServiceType
from rasterloom.operators import pixels
from rasterloom.operators.boxes import intersecting
from rasterloom.plans import tiles
from rasterloom.sources import cache, decode
from rasterloom.sources.coverage import downsample
from rasterloom.sources.services import CoverageService, detect_service_type, get_service
from rasterloom.sources.transport import Request, Response, fetch

BOX = BBox(0, 0, 512, 1024)


def test_request_defaults_and_precedence():
    config = ServiceConfig("https://example.org/wcs/", chunk_size=(128, 128), grid_shape=None, resolution=4, coverage_id="c", cache_dir="~/x")
    found = ArrayRequest.of(config, BOX)
    assert found.chunk_size == (128, 128) and found.resolution == (4.0, 4.0) and found.grid_shape == (2, 1)
    assert found.service_url == "https://example.org/wcs" and not found.cache_dir.startswith("~")
    assert ArrayRequest.of("https://example.org/wcs", BOX).chunk_size == (256, 256)
    assert ArrayRequest.of(config, BOX, chunk_size=(64, 64)).grid_shape == (4, 2)
    assert ArrayRequest.of(config, BOX, output_format="image/png").output_format is Format.PNG
    assert ArrayRequest.of("u", BOX, resolution=1).grid_shape == (4, 2)
    attrs = ArrayRequest.of(config, BOX).attributes(ServiceType.WCS)
    assert attrs == {"crs": "EPSG:4326", "service_url": "https://example.org/wcs", "service_type": "WCS", "coverage_id": "c"}


@pytest.mark.parametrize("bad", [{"chunk_size": (0, 1)}, {"chunk_size": 5}, {"grid_shape": (1, -1)}, {"resolution": -1}, {"resolution": 4, "grid_shape": (9, 9)}, {"output_format": "text/plain"}, {"crs": "EPSG:1"}])
def test_bad_requests(bad):
    with pytest.raises(InvalidRequestError):
        ArrayRequest.of("https://example.org/wcs", BOX, **bad)


def test_boxes_and_systems():
    with pytest.raises(InvalidRequestError):
        BBox(1, 0, 1, 5)
    assert BBox(0, 0, 2, 2).intersects(BBox(1, 1, 3, 3)) and not BBox(0, 0, 2, 2).intersects(BBox(2, 0, 3, 3))
    assert Crs.of(" epsg:3857 ") is Crs.WEB_MERCATOR and Crs.of("27700") is Crs.BRITISH_GRID and Crs.of(32633) is Crs.UTM_33N
    config = ServiceConfig("u", crs=Crs.WEB_MERCATOR)
    with pytest.raises(InvalidRequestError):
        ArrayRequest.of(config, BOX, "EPSG:4326")


def test_resolution_plan_is_ragged(spark):
    plan = tiles.resolution_plan(spark, BBox(0, 0, 820, 820), (256, 256), 1.0).collect()
    assert len(plan) == 16 and {(r.width, r.height) for r in plan if r.col == 3 and r.south_row == 3} == {(52, 52)}
    offsets = tiles.mosaic_offsets(tiles.resolution_plan(spark, BBox(0, 0, 820, 820), (256, 256), 1.0), 4)
    assert {r.row_off for r in offsets.collect()} == {0, 52, 308, 564}


@settings(max_examples=15, deadline=None)
@given(st.floats(-1e4, 1e4), st.floats(0.5, 2000), st.integers(1, 64), st.floats(0.1, 7))
def test_edges_cover_the_span(low, span, size, res):
    edges = tiles.resolution_edges(low, low + span, size, res, res)
    assert edges[0] == low and all(a < b for a, b in zip(edges, edges[1:]))
    assert low + span - edges[-1] <= res / 10 + 1e-9
    assert len(edges) - 1 <= math.ceil(span / (size * res)) + 1


def test_grid_plan_covers_the_box(spark):
    plan = tiles.organised(tiles.grid_plan(spark, BOX, (10, 20), (3, 5)), 3).collect()
    assert len(plan) == 15 and max(r.max_x for r in plan) == 512 and max(r.max_y for r in plan) == 1024
    assert {r.max_y for r in plan if r.tile_row == 0} == {1024}
    assert abs(sum((r.max_x - r.min_x) * (r.max_y - r.min_y) for r in plan) - 512 * 1024) < 1e-6
    with pytest.raises(InvalidRequestError):
        tiles.organised_by_place(tiles.grid_plan(spark, BOX, (1, 1), (2, 2)), 3, 3)


def test_driver_edges_equal_the_plan(spark):
    for low, high, size, res in ((0.3, 1000.35, 64, 1.5), (-5.0, 5.0, 7, 0.1), (0.0, 1000.05, 500, 1.0)):
        plan = tiles.resolution_plan(spark, BBox(low, 0, high, 1), (size, 10), (res, 1.0)).orderBy("col").collect()
        edges = tiles.resolution_edges(low, high, size, res, min(res, 1.0))
        assert [r.min_x for r in plan] == edges[:-1] and plan[-1].max_x == edges[-1]


def test_block_mean(spark):
    rng = np.random.default_rng(0)
    a = rng.random((6, 8)).astype(np.float32)
    a[0, 0] = np.nan
    df = spark.createDataFrame([(1, 8, 6, a.ravel().tolist())], "k int, width int, height int, values array<float>")
    got = np.array(pixels.block_mean(df, 4, 3, "k").first()["values"]).reshape(3, 4)
    np.testing.assert_allclose(got, downsample(a, 4, 3), rtol=1e-6)
    assert np.isnan(got[0, 0])
    assert pixels.block_mean(df, 8, 6, "k").first()["values"][1] == a[0, 1]
    with pytest.raises(Exception):
        pixels.block_mean(df, 3, 3, "k").collect()
    with pytest.raises(DecodeError):
        downsample(a, 3, 3)


def test_intersecting_is_the_theta_join(spark):
    rng = np.random.default_rng(1)

    def made(n, size):
        low = rng.random((n, 2)) * 50 - 25
        high = low + rng.random((n, 2)) * size + 0.1
        return [(int(k), *map(float, low[k]), *map(float, high[k])) for k in range(n)]

    a, b = made(60, 9), made(50, 3)
    schema = "id long, min_x double, min_y double, max_x double, max_y double"
    got = sorted((r.a_id, r.b_id) for r in intersecting(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 4.0).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if BBox(*p[1:]).intersects(BBox(*q[1:])))


# Control points: longitude, latitude, x, y and the tolerance in metres.
POINTS = [
    (Crs.WEB_MERCATOR, 2.0, 50.0, 222638.981586547, 6446275.841017158, 1e-3),
    (Crs.UTM_33N, 15.0, 0.0, 500000.0, 0.0, 1e-6),
    (Crs.UTM_33N, 18.0, 0.0, 833978.5569194595, 0.0, 1e-3),
    (Crs.BRITISH_GRID, 1.716073973, 52.658007833, 651409.903, 313177.270, 5.0),
]


def test_reprojection(spark):
    for crs, lon, lat, x, y, tolerance in POINTS:
        gx, gy = spark.range(1).select(*reproject(F.lit(lon), F.lit(lat), Crs.WGS84, crs)).first()
        assert abs(gx - x) < tolerance and abs(gy - y) < tolerance, (crs, gx, gy)
    for crs, lon, lat, *_ in POINTS:
        x, y = spark.range(1).select(*reproject(F.lit(lon), F.lit(lat), Crs.WGS84, crs)).first()
        back = spark.range(1).select(*reproject(F.lit(x), F.lit(y), crs, Crs.WGS84)).first()
        assert abs(back[0] - lon) < 1e-6 and abs(back[1] - lat) < 1e-6


def test_reprojection_is_a_small_expression(spark):
    """Of all pairs of systems: a plan of the British grid once had megabytes and ended the driver."""
    points = spark.range(2).select(F.col("id").cast("double").alias("x"), (F.col("id") + 50.0).alias("y"))
    for source in Crs:
        for target in Crs:
            plan = points.select(*reproject(F.col("x"), F.col("y"), source, target))._jdf.queryExecution().analyzed()
            assert sum(len(plan.expressions().apply(k).sql()) for k in range(plan.expressions().size())) < 300_000, (source, target)
    lon, lat = 1.717921, 52.657570  # there and back by way of another projected system
    east, north = reproject(F.lit(lon), F.lit(lat), Crs.WGS84, Crs.BRITISH_GRID)
    grid = spark.range(1).select(east.alias("x"), north.alias("y"))
    mercator = grid.select(*(c.alias(n) for c, n in zip(reproject(F.col("x"), F.col("y"), Crs.BRITISH_GRID, Crs.WEB_MERCATOR), "xy", strict=True)))
    back = mercator.select(*reproject(F.col("x"), F.col("y"), Crs.WEB_MERCATOR, Crs.WGS84)).first()
    assert abs(back[0] - lon) < 1e-6 and abs(back[1] - lat) < 1e-6


def test_tiff_round_trips():
    rng = np.random.default_rng(2)
    for dtype in (np.float32, np.float64, np.uint8, np.int16, np.uint16):
        a = (rng.random((5, 7)) * 100).astype(dtype)
        for deflate in (False, True):
            np.testing.assert_array_equal(decode.tiff_samples(decode.encode_tiff(a, deflate=deflate)), a)
    a = np.array([[1, 1e30], [np.inf, np.nan]], np.float32)
    got = decode.decode_tiff(decode.encode_tiff(a))
    assert got[0, 0] == 1 and np.isnan(got.ravel()[1:]).all()
    for bad in (b"", b"II*\0", b"<xml/>", decode.encode_tiff(a)[:30]):
        with pytest.raises(DecodeError):
            decode.tiff_samples(bad)


def png(array, colour, filters):
    height, width = array.shape[:2]
    step = 1 if array.ndim == 2 else array.shape[2]
    flat = array.reshape(height, width * step).astype(int)
    lines = b""
    for y in range(height):
        kind = filters[y % len(filters)]
        line = []
        for i in range(width * step):
            a = flat[y, i - step] if i >= step else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((flat[y, i] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_filters_and_images(spark, tmp_path):
    rng = np.random.default_rng(3)
    grey, rgba = rng.integers(0, 256, (10, 6)), rng.integers(0, 256, (10, 6, 4))
    np.testing.assert_array_equal(decode.decode_png(png(grey, 0, [0, 1, 2, 3, 4])), grey)
    np.testing.assert_array_equal(decode.decode_png(png(rgba, 6, [4, 3, 2, 1, 0])), rgba[:, :, 0])
    with pytest.raises(DecodeError):
        decode.decode_png(b"no")
    (tmp_path / "a.png").write_bytes(png(rgba, 6, [0]))
    row = decode.decode_images(spark, str(tmp_path)).first()
    np.testing.assert_array_equal(np.array(row["values"]).reshape(10, 6), rgba[:, :, 0])


def java_image(spark, array, kind, compression=None, quality=None):
    """An image file as the JVM's own encoders write it."""
    jvm = spark._jvm
    colour = array.ndim == 3
    image = jvm.java.awt.image.BufferedImage(array.shape[1], array.shape[0], 5 if colour else 10)
    raster = image.getRaster()
    for y in range(array.shape[0]):
        for x in range(array.shape[1]):
            for b in range(3 if colour else 1):
                raster.setSample(x, y, b, int(array[y, x, b] if colour else array[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    param = writer.getDefaultWriteParam()
    if compression or quality:
        param.setCompressionMode(2)
        if compression:
            param.setCompressionType(compression)
        if quality:
            param.setCompressionQuality(quality)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


def test_compressed_tiffs(spark):
    rng = np.random.default_rng(4)
    for array in (rng.integers(0, 256, (40, 70)), np.repeat(rng.integers(0, 5, (64, 64)), 2, axis=1)):
        for compression in ("LZW", "PackBits", "Deflate", "ZLib"):
            np.testing.assert_array_equal(decode.decode_tiff(java_image(spark, array, "tiff", compression)), array)
    for raw, packed in ((b"", b""), (b"aaab", b"\xfe\x61\x00\x62"), (b"abcd", b"\x03abcd\x80")):
        assert decode._packbits(packed) == raw
    with pytest.raises(DecodeError):
        decode._lzw(b"\x80\x7f\xff\xff")


def test_floating_point_predictor():
    rng = np.random.default_rng(5)
    array = rng.normal(size=(6, 9)).astype(np.float32)
    planes = array.astype(">f4").view(np.uint8).reshape(6, 9, 4).transpose(0, 2, 1).reshape(6, 36)
    data = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    np.testing.assert_array_equal(decode._block(data, np.dtype("<f4"), 6, 9, 1, 3)[:, :, 0], array)


def test_jpeg(spark, tmp_path):
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:45, 0:61]
    smooth = (120 + 60 * np.sin(x / 9) + 50 * np.cos(y / 7)).astype(int)
    for quality in (0.3, 0.9):
        (tmp_path / "grey.jpg").write_bytes(java_image(spark, smooth, "jpeg", quality=quality))
        want = np.array(decode.decode_images(spark, str(tmp_path)).first()["values"]).reshape(45, 61)
        assert np.abs(decode.decode_jpeg((tmp_path / "grey.jpg").read_bytes()) - want).max() <= 1
    flat = np.kron(rng.integers(0, 256, (3, 4)), np.ones((8, 8), int))
    assert np.abs(decode.decode_jpeg(java_image(spark, flat, "jpeg", quality=1.0)) - flat).max() <= 1
    colour = np.stack([smooth, 255 - smooth, smooth // 2], axis=2)
    assert np.abs(decode.decode_jpeg(java_image(spark, colour, "jpeg", quality=0.95)) - smooth).mean() < 4
    raw = java_image(spark, smooth, "jpeg")
    for bad in (b"", b"\xff\xd8", raw[:100], raw[: len(raw) // 2]):
        with pytest.raises(DecodeError):
            decode.decode_jpeg(bad)


def png_of(width, height, depth, colour, interlace, lines, palette=b""):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_low_depths_and_interlaced_pngs(spark):
    rng = np.random.default_rng(7)
    for depth in (1, 2, 4):
        array = rng.integers(0, 1 << depth, (5, 11))
        bits = (array[:, :, None] >> np.arange(depth)[::-1] & 1).reshape(5, -1).astype(np.uint8)
        lines = b"".join(b"\0" + np.packbits(row).tobytes() for row in bits)
        np.testing.assert_array_equal(decode.decode_png(png_of(11, 5, depth, 0, 0, lines)), array * {1: 1, 2: 85, 4: 17}[depth])
        palette = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
        np.testing.assert_array_equal(decode.decode_png(png_of(11, 5, depth, 3, 0, lines, palette.tobytes())), palette[array][:, :, 0])
    for shape in ((13, 10), (1, 1), (3, 2)):
        array = rng.integers(0, 256, shape).astype(np.uint8)
        lines = b"".join(b"\0" + row.tobytes() for y, x, dy, dx in decode._ADAM7 for row in array[y::dy, x::dx] if len(row))
        np.testing.assert_array_equal(decode.decode_png(png_of(shape[1], shape[0], 8, 0, 1, lines)), array)
    with pytest.raises(DecodeError):
        decode.decode_png(png_of(9, 9, 8, 0, 0, b"\0abc"))


def test_decoder_registry():
    assert decode.registered_decoder("image/tiff") is decode.decode_tiff and decode.registered_decoder("x") is None
    assert decode.registered_decoder("image/jpeg") is decode.decode_jpeg
    with pytest.raises(DecodeError):
        decode.resolve_decoder("image/webp")
    assert decode.resolve_decoder("image/jpeg", len) is len


def test_plain_requests_are_the_columns(spark):
    """The texts made in plain Python are those of the column expressions."""
    from rasterloom.functions import requests as req

    values = [0.0, 0.1, -2.5, 1 / 3, 123456.789, 1e7, 12345678.9, 1e-3, 0.00025, -9999999.0, 5e15, 400.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", req.number_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [req.plain_number(r.v) for r in rows]
    for crs in Crs:
        box = (0.5, -1.25, 100.0, 33.1)
        lits = tuple(map(F.lit, box))
        params = req.request_params(F.lit("c"), lits, F.lit(crs.value), F.lit("image/tiff"), F.lit(4), F.lit(5))
        row = spark.range(1).select(params.alias("p")).select("p", req.cache_key(F.lit("u"), F.col("p"), F.lit("image/tiff"), lits, F.lit(4), F.lit(5)).alias("k")).first()
        own = req.plain_params("c", box, crs, "image/tiff", 4, 5)
        assert row.p == own and row.k == req.plain_cache_key("u", own, "image/tiff", box, 4, 5)


def test_source_pushes_filters_down(spark, server, tmp_path):
    """Only the tiles that a filter leaves are asked for; what can't be decoded is a failed tile."""
    from rasterloom.sources import coverage

    coverage.register(spark)
    _Handler.seen.clear()
    read = lambda url: spark.read.format("coverage").options(url=url, coverage_id="c1", bbox="0,0,8,8", crs="EPSG:27700", rows=4, cols=4, width=2, height=2, cache_dir=str(tmp_path)).load()
    got = read(f"{server}/wcs").filter("tile_row = 1 AND tile_col IN (0, 3)").collect()
    assert sorted((r.tile_row, r.tile_col) for r in got) == [(1, 0), (1, 3)] and all(r.success for r in got)
    assert len(_Handler.seen) == 2 and all("version=2.0.1" in s and "subset=E%28" in s for s in _Handler.seen)
    assert read(f"{server}/wcs").filter("tile_row > 9").collect() == []
    bad = read(f"{server}/wcs?DescribeCoverage").filter("tile_row <= 0 AND tile_col < 1").collect()
    assert [(r.success, math.isnan(r["values"][0]), len(r["values"])) for r in bad] == [(False, True, 4)]
    assert len(list(tmp_path.glob("*.tile"))) == 2


class _Handler(http.server.BaseHTTPRequestHandler):
    seen: list[str] = []

    def do_GET(self):
        self.seen.append(self.path)
        if "missing" in self.path:
            status, kind, body = 404, "text/plain", b"x" * 500
        elif "flaky" in self.path and sum("flaky" in s for s in self.seen) < 3:
            status, kind, body = 503, "text/plain", b"busy"
        elif "report" in self.path:
            status, kind, body = 200, "application/xml", b"<Exception/>"
        elif "DescribeCoverage" in self.path:
            status, kind, body = 200, "text/xml", b"<CoverageDescription><CoverageId>c1</CoverageId></CoverageDescription>"
        elif "GetCapabilities" in self.path:
            status, kind, body = 200, "text/xml", b"<Capabilities><Contents><CoverageSummary><CoverageId>c1</CoverageId></CoverageSummary></Contents></Capabilities>"
        else:
            status, kind, body = 200, "image/tiff", decode.encode_tiff(np.full((4, 4), 7, np.float32))
        self.send_response(status)
        self.send_header("content-type", kind)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_fetching(server):
    _Handler.seen.clear()
    got = fetch(Request(f"{server}/missing", {"a": ["1", "2"]}, retries=2))
    assert not got.success and got.status_code == 404 and len(_Handler.seen) == 3 and len(got.error_message) < 230
    assert fetch(Request(f"{server}/flaky", {"a": ["1"]}, retries=3)).success
    assert not fetch(Request(f"{server}/report", {"a": ["1"]}, {}, "image/tiff", retries=0)).success
    down = fetch(Request("http://127.0.0.1:9", {"a": ["1"]}, retries=1, timeout=1))
    assert down.status_code == 0 and "Network error" in down.error_message
    for bad in (Request("", {"a": ["1"]}), Request("http://x", {}), Request("gopher://x", {"a": ["1"]})):
        with pytest.raises(InvalidRequestError):
            fetch(bad)


def test_services(spark, server):
    assert detect_service_type("https://x.org/WMS?a=1&SERVICE=wcs") is ServiceType.WCS
    assert detect_service_type("https://x.org/a?service=odd", ServiceType.WMS) is ServiceType.WMS
    with pytest.raises(UnknownServiceError):
        detect_service_type("https://x.org/a")
    with pytest.raises(UnknownServiceError):
        get_service("https://x.org/wms")
    own = CoverageService.from_url(f"{server}/wcs/?", layer_id="c1")
    assert own.base_url == f"{server}/wcs" and own.coverage_id == "c1"
    assert own.get_capabilities(spark).first()["coverages"][0]["identifier"] == "c1"
    assert own.describe_coverage(spark).first()["identifier"] == "c1"
    got = own.get_coverage("c1", BBox(0, 0, 1, 1), 4, 4)
    assert got.success and "subset=Long" in got.url
    with pytest.raises(InvalidRequestError):
        CoverageService.from_url(server).describe_coverage(spark)
    with pytest.raises(MetadataError):
        CoverageService.from_url(f"{server}/missing", coverage_id="c").describe_coverage(spark)


def test_array_over_http_with_cache(spark, server, tmp_path):
    _Handler.seen.clear()
    made = lambda: create_array(spark, f"{server}/wcs", (0, 0, 4, 4), coverage_id="c1", chunk_size=(2, 2), grid_shape=(2, 2), cache_dir=str(tmp_path))
    array = made()
    assert array.dims == ("y", "x") and array.shape == (4, 4) and array.chunks == ((2, 2), (2, 2))
    assert not [s for s in _Handler.seen if "GetCoverage" in s]
    assert (array.compute() == 7).all() and array.compute().dtype == np.float32
    n = len(_Handler.seen)
    assert n == 4 and made().mean() == 7.0 and len(_Handler.seen) == n
    assert made().null_count() == 0 and made().process("max") == 7.0
    assert cache.entries(spark, str(tmp_path)).count() == 4
    assert len(list(tmp_path.glob("*.tile"))) == 4


def test_kept_and_replaced_tiles(spark, server):
    _Handler.seen.clear()
    array = create_array(spark, f"{server}/wcs", (0, 0, 4, 4), coverage_id="c1", chunk_size=(2, 2), grid_shape=(2, 2)).persist()
    assert array.mean() == 7.0 and array.process("sum") == 112.0 and array.null_count() == 0
    assert len(_Handler.seen) == 4 and array.get_shape() == (4, 4) and array.get_dtype() == "float32"
    twice = array.set_data(array.tiles().withColumn("values", F.transform("values", lambda v: v * 2)))
    assert twice.mean() == 14.0 and (twice.compute() == 14).all()
    with pytest.raises(InvalidRequestError):
        array.set_data(array.tiles().drop("values"))
    array.unpersist()


def test_failed_tiles_are_nan(spark, server):
    got = load_array(spark, f"{server}/missing/wcs", (0, 0, 4, 4), coverage_id="c1", chunk_size=(4, 4))
    assert got.shape == (4, 4) and np.isnan(got).all()
    with pytest.raises(InvalidRequestError):
        create_array(spark, f"{server}/wcs", (0, 0, 4, 4), coverage_id="c1", output_format="image/webp")
    with pytest.raises(InvalidRequestError):
        create_array(spark, f"{server}/wcs", (0, 0, 4, 4))


def test_orientation_and_labels(spark):
    array = create_array(spark, "synthetic://field/wcs", (0, 0, 8, 8), coverage_id="p", chunk_size=(4, 4), grid_shape=(2, 2))
    values = array.compute()
    assert values[0, 0] > values[-1, 0] and values[0, -1] > values[0, 0]
    rows = array.pixels().filter("x_idx = 0").orderBy("y_idx").collect()
    assert rows[0].y == 8.0 and rows[-1].y == 0.0
    rows = array.pixels(compat_y=True).filter("x_idx = 0").orderBy("y_idx").collect()
    assert rows[0].y == 0.0 and rows[-1].y == 8.0


def test_cache_and_sink(spark, tmp_path):
    cache.write(str(tmp_path), "k", b"abc")
    cache.write(str(tmp_path), "empty", b"")
    assert cache.read(str(tmp_path), "k") == b"abc" and cache.read(str(tmp_path), "none") is None
    plan = spark.createDataFrame([("k",), ("other",)], "cache_key string")
    cached = cache.entries(spark, str(tmp_path))
    assert [bytes(r.data) for r in cache.hits(plan, cached).collect()] == [b"abc"]
    assert [r.cache_key for r in cache.misses(plan, cached).collect()] == ["other"]
    assert not cache.save_tile(b"x", False, str(tmp_path / "n")) and not cache.save_tile(b"x", True, "/proc/none/x")
    rows = spark.createDataFrame([("a/b", bytearray(b"1"), True), ("c", bytearray(b"2"), False)], "name string, data binary, success boolean")
    assert {(r.name, r.saved) for r in cache.save_tiles(rows, str(tmp_path)).collect()} == {("a/b", True), ("c", False)}
    assert (tmp_path / "a" / "b").read_bytes() == b"1"


def test_a_custom_transport_and_decoder(spark):
    def send(request):
        return Response(bytes(range(request.width * request.height)), "image/tiff", 200, {}, request.url, True)

    def read(raw):
        return np.frombuffer(raw, np.uint8).reshape(3, 3)

    got = load_array(spark, "custom://x/wcs", (0, 0, 3, 3), coverage_id="c", chunk_size=(3, 3), transport=send, tile_decoder=read)
    np.testing.assert_array_equal(got, np.arange(9).reshape(3, 3))
