"""The registered queries of the coverage engine, each with its SQL.

The tables have no geometry, so boxes, points, tiles and documents are derived from ordinary
columns: a line item is a point (quantity, price), an embedding an 8 x 8 tile, a page a service
URL. A query that reads tables runs over all of their rows. Plans, the synthetic coverage and the
``*_cases`` queries read none: they list outcomes of fixed inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs as crs_fn
from ..functions import requests as req
from ..model import BBox, Crs, Format
from ..operators import boxes, pixels
from ..sources import coverage, decode, metadata
from . import tiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FIELD = BBox(0.0, 0.0, 60.0, 120000.0)
_SPAN = BBox(0.3, -1.2, 1000.35, 733.3)


def _query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_GRID_SQL = """
    SELECT r AS south_row, c AS col,
           b.min_x + c * ((b.max_x - b.min_x) / {cols}) AS min_x,
           b.min_y + r * ((b.max_y - b.min_y) / {rows}) AS min_y,
           CASE WHEN c = {cols} - 1 THEN b.max_x ELSE b.min_x + (c + 1) * ((b.max_x - b.min_x) / {cols}) END AS max_x,
           CASE WHEN r = {rows} - 1 THEN b.max_y ELSE b.min_y + (r + 1) * ((b.max_y - b.min_y) / {rows}) END AS max_y,
           64 AS width, 32 AS height{more}
    FROM ({box}) b, range(0, {rows}) t(r), range(0, {cols}) u(c)"""
_FIELD_SQL = "SELECT 0::double AS min_x, 0::double AS min_y, 60::double AS max_x, 120000::double AS max_y"


@_query("""
    WITH p AS (SELECT r AS tile_row, c AS tile_col FROM range(0, 6) t(r), range(0, 5) u(c)),
         v AS (SELECT 5 - least(5, floor(l_extendedprice / (120000::double / 6)))::int AS tile_row,
                      least(4, floor(l_quantity / (60::double / 5)))::int AS tile_col, l_discount FROM lineitem)
    SELECT p.tile_row::int AS tile_row, p.tile_col::int AS tile_col, count(l_discount) AS n, round(avg(l_discount), 6) AS mean_value
    FROM p LEFT JOIN v USING (tile_row, tile_col) GROUP BY ALL""")
def tile_point_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point cloud to grid: mean of the points of each tile, empty tiles included."""
    rows, cols = 6, 5
    plan = tiles.organised(tiles.grid_plan(spark, _FIELD, (1, 1), (rows, cols)), rows).select("tile_row", "tile_col")
    points = _table(spark, sf_dir, "lineitem")
    at = lambda v, high, n: F.least(F.lit(n - 1), F.floor(v / F.lit(high / n))).cast("int")
    binned = points.select((F.lit(rows - 1) - at(F.col("l_extendedprice"), _FIELD.max_y, rows)).alias("tile_row"), at(F.col("l_quantity"), _FIELD.max_x, cols).alias("tile_col"), "l_discount")
    sums = binned.groupBy("tile_row", "tile_col").agg(F.count("l_discount").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_value"))
    return plan.join(F.broadcast(sums), ["tile_row", "tile_col"], "left").select("tile_row", "tile_col", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean_value")


@_query(_GRID_SQL.format(rows=3, cols=4, more=", b.o_orderpriority", box="SELECT o_orderpriority, min(o_custkey)::double AS min_x, min(o_totalprice) AS min_y, max(o_custkey)::double AS max_x, max(o_totalprice) AS max_y FROM orders GROUP BY 1").replace("r AS south_row, c AS col", "r::int AS south_row, c::int AS col"))
def g1_plan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid plans over the boxes of order priorities."""
    found = _table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min("o_custkey").cast("double").alias("min_x"), F.min("o_totalprice").alias("min_y"), F.max("o_custkey").cast("double").alias("max_x"), F.max("o_totalprice").alias("max_y"))
    return tiles.grid_plan_of(found, (64, 32), (3, 4))


_EDGES_SQL = """
    WITH RECURSIVE xs(i, e) AS (SELECT 0, 0.3::double UNION ALL SELECT i + 1, least(1000.35::double, e + 64 * 1.5::double) FROM xs WHERE e < 1000.35::double - 0.1::double),
    ys(i, e) AS (SELECT 0, -1.2::double UNION ALL SELECT i + 1, least(733.3::double, e + 100 * 1.0::double) FROM ys WHERE e < 733.3::double - 0.1::double),
    px AS (SELECT a.i AS col, a.e AS lo, b.e AS hi FROM xs a JOIN xs b ON b.i = a.i + 1),
    py AS (SELECT a.i AS row, a.e AS lo, b.e AS hi FROM ys a JOIN ys b ON b.i = a.i + 1)"""


@_query(_EDGES_SQL + """
    SELECT py.row::int AS south_row, px.col::int AS col, px.lo AS min_x, py.lo AS min_y, px.hi AS max_x, py.hi AS max_y,
           greatest(1, ceil((px.hi - px.lo) / 1.5::double)::int) AS width, greatest(1, ceil((py.hi - py.lo) / 1.0::double)::int) AS height
    FROM px, py""")
def g2_plan_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resolution plan with accumulated, clipped edges."""
    return tiles.resolution_plan(spark, _SPAN, (64, 100), (1.5, 1.0))


@_query("""
    SELECT c_custkey, greatest(1, ceil((c_acctbal + 1500) / (32 * 0.75::double))::int) AS n_rows, greatest(1, ceil(c_custkey / (64 * 0.5::double))::int) AS n_cols
    FROM customer""")
def g4_infer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid shapes inferred from spans, chunk size and resolution."""
    rows, cols = tiles.inferred_grid(F.col("c_custkey"), F.col("c_acctbal") + 1500, (64, 32), (0.5, 0.75))
    return _table(spark, sf_dir, "customer").select("c_custkey", rows.alias("n_rows"), cols.alias("n_cols"))


@_query("""
    SELECT r::int AS south_row, c::int AS col, 10 + c * 128::double AS min_x, -5 + r * 128::double AS min_y, 10 + (c + 1) * 128::double AS max_x, -5 + (r + 1) * 128::double AS max_y, 256 AS width, 256 AS height
    FROM range(0, 6) t(r), range(-1, 8) u(c)""")
def g6_aligned_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a grid with a fixed origin that cover a box."""
    return tiles.aligned_plan(spark, _SPAN, (256, 256), (10.0, -5.0), 0.5)


@_query(_GRID_SQL.replace("SELECT r AS south_row, c AS col,", "SELECT (6 - r)::int AS tile_row, c::int AS tile_col,").format(rows=7, cols=9, more="", box=_FIELD_SQL))
def g5_plan_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid plan laid out from the north by its own indices."""
    return tiles.organised(tiles.grid_plan(spark, _FIELD, (64, 32), (7, 9)), 7).drop("south_row", "col").select("tile_row", "tile_col", "min_x", "min_y", "max_x", "max_y", "width", "height")


@_query("""
    WITH t AS (""" + _GRID_SQL.format(rows=7, cols=9, more="", box=_FIELD_SQL) + """)
    SELECT min_x, max_y, ((row_number() OVER (ORDER BY max_y DESC, min_x) - 1) // 9)::int AS tile_row, ((row_number() OVER (ORDER BY max_y DESC, min_x) - 1) % 9)::int AS tile_col FROM t""")
def o2_organise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles ordered north to south, west to east, and placed in a matrix."""
    return tiles.organised_by_place(tiles.grid_plan(spark, _FIELD, (64, 32), (7, 9)), 7, 9).select("min_x", "max_y", "tile_row", "tile_col")


@_query(_EDGES_SQL + """,
    r AS (SELECT row, greatest(1, ceil((hi - lo) / 1.0::double)::int) AS h FROM py), c AS (SELECT col, greatest(1, ceil((hi - lo) / 1.5::double)::int) AS w FROM px),
    ro AS (SELECT (SELECT max(row) FROM r) - row AS tile_row, h, coalesce(sum(h) OVER (ORDER BY row DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_off FROM r),
    co AS (SELECT col AS tile_col, w, coalesce(sum(w) OVER (ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col_off FROM c)
    SELECT tile_row::int AS tile_row, tile_col::int AS tile_col, w AS width, h AS height, row_off::bigint AS row_off, col_off::bigint AS col_off FROM ro, co""")
def u1_mosaic_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel offsets of a ragged plan's tiles."""
    rows = len(tiles.resolution_edges(_SPAN.min_y, _SPAN.max_y, 100, 1.0, 1.0)) - 1
    return tiles.mosaic_offsets(tiles.resolution_plan(spark, _SPAN, (64, 100), (1.5, 1.0)), rows).select("tile_row", "tile_col", "width", "height", "row_off", "col_off")


@_query("""
    SELECT r_regionkey, i, CASE WHEN i = n - 1 THEN hi ELSE i * ((hi - lo) / (n - 1)) + lo END AS x, CASE WHEN i = 0 THEN hi ELSE (n - 1 - i) * ((hi - lo) / (n - 1)) + lo END AS y, lo + (i + 0.5::double) * ((hi - lo) / n) AS x_centre
    FROM (SELECT r_regionkey, -7.1::double * r_regionkey AS lo, 820.4::double AS hi, 2 + 410 * r_regionkey AS n FROM region) b, LATERAL (SELECT unnest(range(0, n))::int AS i) s""")
def p12_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate labels: even from edge to edge, both ways, and pixel centres."""
    base = _table(spark, sf_dir, "region").select("r_regionkey", (F.lit(-7.1) * F.col("r_regionkey")).alias("lo"), F.lit(820.4).alias("hi"), (F.lit(2) + 410 * F.col("r_regionkey")).alias("n"))
    cells = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    args = (F.col("lo"), F.col("hi"), F.col("n"), F.col("i"))
    return cells.select("r_regionkey", "i", tiles.coordinate(*args).alias("x"), tiles.coordinate(*args, descending=True).alias("y"), tiles.coordinate(*args, centre=True).alias("x_centre"))


def _orders_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    systems = F.element_at(F.array(*(F.lit(c.value) for c in Crs)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("min_x"), F.col("o_totalprice").alias("min_y"), (F.col("o_custkey") + 0.25).alias("max_x"), (F.col("o_totalprice") + 100).alias("max_y"), systems.alias("crs"))


_ORDERS_SQL = """SELECT o_orderkey, o_custkey::double AS min_x, o_totalprice AS min_y, o_custkey + 0.25::double AS max_x, o_totalprice + 100 AS max_y,
    ['EPSG:4326', 'EPSG:3857', 'EPSG:32633', 'EPSG:27700'][o_orderkey % 4 + 1] AS crs FROM orders"""
_AXES_SQL = "CASE crs WHEN 'EPSG:27700' THEN '{1}' WHEN 'EPSG:3857' THEN '{2}' ELSE '{0}' END"
_SUBSET_SQL = f"""({_AXES_SQL.format('Long', 'E', 'X')}) || '(' || min_x::varchar || ',' || max_x::varchar || ')' AS subset_x,
    ({_AXES_SQL.format('Lat', 'N', 'Y')}) || '(' || min_y::varchar || ',' || max_y::varchar || ')' AS subset_y"""


@_query(f"SELECT o_orderkey, {_SUBSET_SQL} FROM ({_ORDERS_SQL})")
def p2_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset texts of boxes in several systems, with their axis labels."""
    found = _orders_boxes(spark, sf_dir).withColumn("s", req.subset(*(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y", "crs"))))
    return found.select("o_orderkey", F.col("s")[0].alias("subset_x"), F.col("s")[1].alias("subset_y"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = tuple(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
    params = req.request_params(F.concat(F.lit("cov-"), (F.col("o_orderkey") % 7).cast("string")), box, F.col("crs"), F.lit("image/tiff"), F.lit(256), F.lit(128), extra={"version": "2.1.0", "scale": ["2", "4"]})
    return _orders_boxes(spark, sf_dir).withColumn("params", params)


_KEY_SQL = f"""sha256(concat_ws('|', 'https://example.org/wcs', concat_ws('&', 'coverageId=cov-' || (o_orderkey % 7)::varchar, 'format=image/tiff', 'height=128', 'request=GetCoverage', 'scale=2,4', 'service=WCS',
    'subset=' || subset_x || ',' || subset_y, 'subsettingCRS=' || crs, 'version=2.1.0', 'width=256'), 'image/tiff', min_x::varchar, min_y::varchar, max_x::varchar, max_y::varchar, '256', '128'))"""


@_query(f"""SELECT o_orderkey, unnest(map_entries(MAP {{'service': 'WCS', 'version': '2.1.0', 'request': 'GetCoverage', 'coverageId': 'cov-' || (o_orderkey % 7)::varchar, 'subset': subset_x || ';' || subset_y,
    'format': 'image/tiff', 'width': '256', 'height': '128', 'subsettingCRS': crs, 'scale': '2;4'}}), recursive := true) FROM (SELECT *, {_SUBSET_SQL} FROM ({_ORDERS_SQL}))""")
def p1_request_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of tile requests, a caller's own last."""
    return _requests(spark, sf_dir).select("o_orderkey", F.explode("params").alias("key", "v")).select("o_orderkey", "key", F.array_join("v", ";").alias("value"))


@_query(f"SELECT o_orderkey, {_KEY_SQL} AS cache_key FROM (SELECT *, {_SUBSET_SQL} FROM ({_ORDERS_SQL}))")
def s5_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of tile requests."""
    return _requests(spark, sf_dir).select("o_orderkey", _key().alias("cache_key"))


def _key() -> Column:
    return req.cache_key(F.lit("https://example.org/wcs"), F.col("params"), F.lit("image/tiff"), tuple(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")), F.lit(256), F.lit(128))


def _cache_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    plan = _requests(spark, sf_dir).select("o_orderkey", _key().alias("cache_key"))
    cached = _requests(spark, sf_dir).filter(F.col("crs").isin("EPSG:3857", "EPSG:27700")).select(_key().alias("cache_key"), F.encode(F.col("crs"), "UTF-8").alias("data"))
    return plan, cached


@_query(f"SELECT o_orderkey, crs AS content FROM ({_ORDERS_SQL}) WHERE crs IN ('EPSG:3857', 'EPSG:27700')")
def j1_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned tiles with their cached bytes."""
    from ..sources.cache import hits

    return hits(*_cache_sides(spark, sf_dir)).select("o_orderkey", F.decode("data", "UTF-8").alias("content"))


@_query(f"SELECT o_orderkey FROM ({_ORDERS_SQL}) WHERE crs NOT IN ('EPSG:3857', 'EPSG:27700')")
def j1_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned tiles that are not in the cache."""
    from ..sources.cache import misses

    return misses(*_cache_sides(spark, sf_dir)).select("o_orderkey")


_URLS = ("/WCS?request=GetCapabilities", "/ows?Service=wms&x=1", "/maps/wmts/1.0", "/plain?service=other", "/geo/wms/?service=")


@_query("""
    WITH u AS (SELECT page_id, url || ['/WCS?request=GetCapabilities', '/ows?Service=wms&x=1', '/maps/wmts/1.0', '/plain?service=other', '/geo/wms/?service='][page_id % 5 + 1] AS url FROM pages),
    v AS (SELECT page_id, url, nullif(upper(regexp_extract(regexp_replace(lower(url), '#.*', ''), '^[^?]*[?](?:.*?&)?service=([^&]*)', 1)), '') AS named, regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM u)
    SELECT page_id, coalesce(CASE WHEN named IN ('WCS', 'WMS', 'WMTS') THEN named END, CASE WHEN contains(path, 'wcs') THEN 'WCS' WHEN contains(path, 'wms') THEN 'WMS' WHEN contains(path, 'wmts') THEN 'WMTS' END, 'none') AS service_type,
           regexp_replace(url, '[/?]+$', '') AS base_url FROM v""")
def p4_detect_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service types of URLs, and their base URLs."""
    found = _table(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.element_at(F.array(*map(F.lit, _URLS)), (F.col("page_id") % 5 + 1).cast("int"))))
    return found.select("page_id", req.service_type(F.col("url"), "none").alias("service_type"), req.base_url(F.col("url")).alias("base_url"))


@_query("""
    SELECT n_nationkey, 'EPSG:' || [4326, 3857, 32633, 27700][n_nationkey % 4 + 1]::varchar AS crs FROM nation""")
def p6_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems named in several ways, made alike."""
    code = F.element_at(F.array(*(F.lit(c.value[5:]) for c in Crs)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    named = F.when(F.col("n_nationkey") % 3 == 0, code).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit(" epsg:"), code)).otherwise(F.concat(F.lit("EPSG:"), code))
    return _table(spark, sf_dir, "nation").select("n_nationkey", crs_fn.normalised(named).alias("crs"))


_LONLAT_SQL = "SELECT c_custkey, (c_acctbal + 1000) / 31 - 175 AS lon, c_nationkey * 6.5::double - 78 + (c_custkey % 100) / 100::double AS lat FROM customer"


def _lon_lat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_acctbal") + 1000) / 31 - 175).alias("lon"), (F.col("c_nationkey") * F.lit(6.5) - 78 + (F.col("c_custkey") % 100) / F.lit(100.0)).alias("lat"))


@_query(f"""
    WITH p AS (SELECT *, 6378137::double * radians(lon) AS mx, 6378137::double * ln(tan(pi() / 4 + radians(lat) / 2)) AS my FROM ({_LONLAT_SQL}))
    SELECT c_custkey, round(mx, 4) AS x, round(my, 4) AS y, round(degrees(mx / 6378137), 8) AS lon_back, round(degrees(2 * atan(exp(my / 6378137)) - pi() / 2), 8) AS lat_back FROM p""")
def p9_reproject_3857(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitude and latitude to Web Mercator and back."""
    x, y = crs_fn.reproject(F.col("lon"), F.col("lat"), Crs.WGS84, Crs.WEB_MERCATOR)
    points = _lon_lat(spark, sf_dir).select("c_custkey", x.alias("mx"), y.alias("my"))
    lon, lat = crs_fn.reproject(F.col("mx"), F.col("my"), Crs.WEB_MERCATOR, Crs.WGS84)
    return points.select("c_custkey", F.round("mx", 4).alias("x"), F.round("my", 4).alias("y"), F.round(lon, 8).alias("lon_back"), F.round(lat, 8).alias("lat_back"))


@_query("SELECT c_custkey, round((0.0004 * (c_custkey % 1000) + 12)::double, 7) AS lon, round((0.0003 * (c_custkey % 777) + 48)::double, 7) AS lat FROM customer")
def p9_reproject_32633(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTM zone 33 there and back; the way back gives the same point."""
    points = _table(spark, sf_dir, "customer").select("c_custkey", (F.lit(0.0004) * (F.col("c_custkey") % 1000) + 12).alias("lon"), (F.lit(0.0003) * (F.col("c_custkey") % 777) + 48).alias("lat"))
    there = points.select("c_custkey", *(c.alias(n) for c, n in zip(crs_fn.reproject(F.col("lon"), F.col("lat"), Crs.WGS84, Crs.UTM_33N), "xy", strict=True)))
    lon, lat = crs_fn.reproject(F.col("x"), F.col("y"), Crs.UTM_33N, Crs.WGS84)
    return there.select("c_custkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@_query("""SELECT doc_id, CASE WHEN f IN ('image/tiff', 'image/png', 'image/jpeg') THEN f END AS output_format, coalesce(CASE WHEN f IN ('image/tiff', 'image/png', 'image/jpeg') THEN f END, 'image/tiff') AS effective_format
    FROM (SELECT doc_id, ['image/tiff', 'image/png', 'image/gif', 'text/xml'][doc_id % 4 + 1] AS f FROM documents)""")
def p10_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported formats, with the service's in place of unknown ones."""
    name = F.element_at(F.array(*map(F.lit, ("image/tiff", "image/png", "image/gif", "text/xml"))), (F.col("doc_id") % 4 + 1).cast("int"))
    known = req.format_or_null(name)
    return _table(spark, sf_dir, "documents").select("doc_id", known.alias("output_format"), F.coalesce(known, F.lit(Format.TIFF.value)).alias("effective_format"))


@_query("""
    SELECT a.c_custkey, b.s_suppkey FROM
      (SELECT c_custkey, c_acctbal - 3 AS min_x, c_nationkey * 100 - 3::double AS min_y, c_acctbal + 3 AS max_x, c_nationkey * 100 + 3::double AS max_y FROM customer) a JOIN
      (SELECT s_suppkey, s_acctbal - 20 AS min_x, s_nationkey * 100 - 2::double AS min_y, s_acctbal + 20 AS max_x, s_nationkey * 100 + 2::double AS max_y FROM supplier) b
      ON a.min_x < b.max_x AND a.max_x > b.min_x AND a.min_y < b.max_y AND a.max_y > b.min_y""")
def f1_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of intersecting boxes, joined by grid cell."""
    box = lambda x, y, dx, dy: ((F.col(x) - dx).alias("min_x"), (F.col(y) * 100 - F.lit(float(dy))).alias("min_y"), (F.col(x) + dx).alias("max_x"), (F.col(y) * 100 + F.lit(float(dy))).alias("max_y"))
    left = _table(spark, sf_dir, "customer").select("c_custkey", *box("c_acctbal", "c_nationkey", 3, 3))
    right = _table(spark, sf_dir, "supplier").select("s_suppkey", *box("s_acctbal", "s_nationkey", 20, 2))
    return boxes.intersecting(left, right, 50.0).select(F.col("a_c_custkey").alias("c_custkey"), F.col("b_s_suppkey").alias("s_suppkey"))


@_query("SELECT count(*) AS n, count(*) FILTER (l_quantity < l_extendedprice / 1000 AND l_discount < l_tax) AS n_valid FROM lineitem")
def f2_valid_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes have an area."""
    made = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("min_x"), (F.col("l_extendedprice") / 1000).alias("max_x"), F.col("l_discount").alias("min_y"), F.col("l_tax").alias("max_y"))
    return made.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(boxes.valid_bbox(), 1)).alias("n_valid"))


@_query("SELECT o_orderpriority, count(*) FILTER (NOT coalesce(l_shipdate >= o_orderdate, true)) AS n_reversed, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def f3_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods that end before they start, by priority."""
    lines, orders = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count(F.when(~boxes.valid_period(F.col("o_orderdate"), F.col("l_shipdate")), 1)).alias("n_reversed"), F.count(F.lit(1)).alias("n"))


_DIRTY_SQL = "CASE WHEN l_linenumber % 7 = 1 THEN 1e30::double WHEN l_linenumber % 7 = 2 THEN 'nan'::double WHEN l_linenumber % 7 = 3 THEN '-inf'::double ELSE l_quantity END"


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 7
    value = F.when(n == 1, 1e30).when(n == 2, float("nan")).when(n == 3, float("-inf")).otherwise(F.col("l_quantity"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", value.alias("value"))


@_query(f"SELECT l_orderkey, l_linenumber, CASE WHEN isnan(v) OR abs(v) > 1e20 THEN NULL ELSE v END AS value, (isnan(v) OR abs(v) > 1e20) AS was_invalid FROM (SELECT l_orderkey, l_linenumber, {_DIRTY_SQL} AS v FROM lineitem)")
def f5_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill values cleaned to NaN (shown as NULL)."""
    cleaned = _dirty(spark, sf_dir).withColumn("value", pixels.clean(F.col("value")))
    return cleaned.select("l_orderkey", "l_linenumber", F.nanvl("value", F.lit(None).cast("double")).alias("value"), F.isnan("value").alias("was_invalid"))


@_query(f"""SELECT l_returnflag, round(avg(CASE WHEN NOT (isnan(v) OR abs(v) > 1e20) THEN v END), 6) AS mean_value, count(*) FILTER (isnan(v) OR abs(v) > 1e20) AS n_nan, bool_or(isnan(v) OR abs(v) > 1e20) AS any_invalid, count(*) AS n
    FROM (SELECT l_returnflag, {_DIRTY_SQL} AS v FROM lineitem) GROUP BY 1""")
def a2_nan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean without NaN, number of NaN, whether anything was invalid, and the count."""
    rows = _dirty(spark, sf_dir).withColumn("clean", pixels.clean(F.col("value")))
    return rows.groupBy("l_returnflag").agg(F.round(pixels.nan_mean(F.col("clean")), 6).alias("mean_value"), pixels.nan_count(F.col("clean")).alias("n_nan"), pixels.any_invalid(F.col("value")).alias("any_invalid"), F.count(F.lit(1)).alias("n"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").alias("values"))


@_query("SELECT vec_id, (i // 8)::int AS r, (i % 8)::int AS c, CASE WHEN label % 5 = 0 THEN NULL ELSE embedding[i + 1] END AS value FROM embeddings, range(0, 64) t(i)")
def f6_failed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with failed tiles as NaN (shown as NULL)."""
    found = _tiles(spark, sf_dir).withColumn("values", pixels.or_nan_tile(F.col("label") % 5 != 0, F.col("values"), F.col("width"), F.col("height")))
    return pixels.pixels_of(found, "vec_id").withColumn("value", F.nanvl("value", F.lit(None).cast("float")))


@_query("SELECT doc_id, array_to_string(list_filter([' image/tiff', 'image/' || lang, 'image/png', 'image/png'], lambda v: trim(v) IN ('image/tiff', 'image/png', 'image/jpeg')), ';') AS formats FROM documents")
def f7_enum_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known formats of a list, in order, repeated ones kept."""
    listed = F.array(F.lit(" image/tiff"), F.concat(F.lit("image/"), F.col("lang")), F.lit("image/png"), F.lit("image/png"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(req.supported(listed, Format), ";").alias("formats"))


_BLOCK_SQL = """SELECT vec_id, (i // 8 // {f})::int AS r, (i % 8 // {f})::int AS c, round(avg(embedding[i + 1]::double)::float::double, 5) AS value FROM embeddings, range(0, 64) t(i) GROUP BY ALL"""


@_query(_BLOCK_SQL.format(f=2))
def a1_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 tiles downsampled to 4 x 4."""
    return pixels.pixels_of(pixels.block_mean(_tiles(spark, sf_dir), 4, 4, "vec_id"), "vec_id").select("vec_id", "r", "c", F.round(F.col("value").cast("double"), 5).alias("value"))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice - 40000 BETWEEN -32768 AND 32767 THEN round(l_extendedprice - 40000)::smallint END AS value FROM lineitem")
def p18_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as 16-bit numbers; what doesn't fit is NULL."""
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pixels.as_dtype(F.when((F.col("l_extendedprice") - 40000).between(-32768, 32767), F.rint(F.round(F.col("l_extendedprice") - 40000))).otherwise(F.lit(1e9)), "int16").alias("value"))


@_query("SELECT (vec_id // 40 * 8 + i // 8)::bigint AS y_idx, (vec_id % 40 * 8 + i % 8)::bigint AS x_idx, embedding[i + 1] AS value FROM embeddings, range(0, 64) t(i)")
def u1_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic of all embeddings, 40 tiles in a row."""
    found = _table(spark, sf_dir, "embeddings")
    rows = found.agg(F.floor(F.max("vec_id") / 40) + 1).first()[0]
    own = found.select(F.floor(F.col("vec_id") / 40).cast("int").alias("tile_row"), (F.col("vec_id") % 40).cast("int").alias("tile_col"), F.col("embedding").alias("values"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return pixels.mosaic(own, tiles.mosaic_offsets(tiles.grid_plan(spark, BBox(0, 0, 40, rows), (8, 8), (rows, 40)), rows))


_DOCUMENT = (
    "<wcs:Capabilities xmlns:wcs='http://www.opengis.net/wcs/2.0' xmlns:ows='http://www.opengis.net/ows/2.0' xmlns:gml='http://www.opengis.net/gml/3.2' version='2.0.1'>"
    "<ows:ServiceIdentification><ows:Title> {title} </ows:Title><ows:Keywords><ows:Keyword>{word}</ows:Keyword><ows:Keyword>all</ows:Keyword></ows:Keywords></ows:ServiceIdentification>"
    "<ows:ServiceProvider><ows:ProviderName>{brand}</ows:ProviderName></ows:ServiceProvider>"
    "<ows:OperationsMetadata><ows:Operation name='GetCapabilities'/><ows:Operation name='GetCoverage'/></ows:OperationsMetadata>"
    "<wcs:ServiceMetadata><wcs:formatSupported>image/tiff</wcs:formatSupported><wcs:formatSupported>text/plain</wcs:formatSupported><wcs:SupportedCRS>EPSG:27700</wcs:SupportedCRS></wcs:ServiceMetadata>"
    "<wcs:Contents><wcs:CoverageSummary><wcs:CoverageId>c{key}</wcs:CoverageId><ows:Title>{title}</ows:Title></wcs:CoverageSummary><wcs:CoverageSummary><ows:Title>nameless</ows:Title></wcs:CoverageSummary></wcs:Contents></wcs:Capabilities>"
)
_DESCRIPTION = (
    "<wcs:CoverageDescription xmlns:wcs='http://www.opengis.net/wcs/2.0' xmlns:gml='http://www.opengis.net/gml/3.2'><gml:boundedBy><gml:Envelope>"
    "<gml:lowerCorner>{x0} {y0}</gml:lowerCorner><gml:upperCorner>{x1} {y1}</gml:upperCorner></gml:Envelope></gml:boundedBy>"
    "<wcs:CoverageId>o{key}</wcs:CoverageId><wcs:NativeCRS>{crs}</wcs:NativeCRS><gml:TimePeriod><gml:beginPosition>{t0}Z</gml:beginPosition><gml:endPosition>{t1}</gml:endPosition></gml:TimePeriod></wcs:CoverageDescription>"
)


def _filled(template: str, **values: Column) -> Column:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else values[p].cast("string") for i, p in enumerate(parts)))


def _capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = _filled(_DOCUMENT, title=F.col("p_name"), word=F.col("p_type"), brand=F.col("p_brand"), key=F.col("p_partkey"))
    xml = F.when(F.col("p_partkey") % 10 == 0, F.concat(xml, F.lit("<"))).otherwise(xml)
    return metadata.capabilities(_table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")))


@_query("""
    SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN p_name END AS service_title, CASE WHEN p_partkey % 10 > 0 THEN p_brand END AS service_provider, CASE WHEN p_partkey % 10 > 0 THEN p_type || ';all' END AS keywords,
           CASE WHEN p_partkey % 10 > 0 THEN 'GetCapabilities;GetCoverage' END AS operations, CASE WHEN p_partkey % 10 > 0 THEN 'image/tiff' END AS formats, CASE WHEN p_partkey % 10 > 0 THEN 'EPSG:27700' END AS crs_list FROM part""")
def r1_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities records; malformed documents have none."""
    found = _capabilities(spark, sf_dir)
    return found.select("p_partkey", "service_title", "service_provider", *(F.array_join(c, ";").alias(n) for c, n in (("service_keywords", "keywords"), ("supported_operations", "operations"), ("supported_formats", "formats"), ("supported_crs", "crs_list"))))


@_query("SELECT p_partkey, 'c' || p_partkey::varchar AS identifier, p_name AS title FROM part WHERE p_partkey % 10 > 0")
def r7_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage summaries that have an id."""
    return _capabilities(spark, sf_dir).select("p_partkey", F.explode("coverages").alias("c")).select("p_partkey", "c.identifier", "c.title")


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    rows = _orders_boxes(spark, sf_dir).join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    upper = F.when(F.col("o_orderkey") % 6 == 0, F.lit("")).otherwise(req.number_text(F.col("max_y")))
    end = F.when(F.col("o_orderkey") % 5 == 0, F.lit("unknown")).otherwise(stamp(F.col("o_orderdate") + F.expr("INTERVAL 36 HOURS")))
    xml = _filled(_DESCRIPTION, x0=req.number_text(F.col("min_x")), y0=req.number_text(F.col("min_y")), x1=req.number_text(F.col("max_x")), y1=upper, key=F.col("o_orderkey"), crs=F.col("crs"), t0=stamp(F.col("o_orderdate")), t1=end)
    return metadata.coverage_descriptions(rows.select("o_orderkey", xml.alias("xml")))


@_query(f"""SELECT o_orderkey, 'o' || o_orderkey::varchar AS identifier, CASE WHEN ok THEN min_x END AS min_x, CASE WHEN ok THEN min_y END AS min_y, CASE WHEN ok THEN max_x END AS max_x, CASE WHEN ok THEN max_y END AS max_y, CASE WHEN ok THEN crs END AS crs
    FROM (SELECT *, o_orderkey % 6 > 0 AS ok FROM ({_ORDERS_SQL}))""")
def r8_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of coverage descriptions; incomplete ones have none."""
    return _descriptions(spark, sf_dir).select("o_orderkey", "identifier", *(F.col(f"spatial_extent.{c}").alias(c) for c in ("min_x", "min_y", "max_x", "max_y", "crs")))


@_query("SELECT o_orderkey, o_orderdate::timestamp AS start_time, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderdate + INTERVAL 36 HOURS)::timestamp END AS end_time FROM orders")
def r9_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of coverage descriptions; what is no time is NULL."""
    found = _descriptions(spark, sf_dir).select("o_orderkey", "temporal_extent.start_time", "temporal_extent.end_time")
    return found.select("o_orderkey", F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"))


_SCAN_SQL = """
    SELECT r::int AS tile_row, c::int AS tile_col, (i // 16)::int AS r, (i % 16)::int AS c,
           ((100 * c + (i % 16 + 0.5::double) * (100::double / 16)) + 1000 * (50 * (3 - r) - (i // 16 + 0.5::double) * (50::double / 8)))::float AS value
    FROM range(0, 3) t(r), range(0, 4) u(c), range(0, 128) s(i)"""


@_query(_SCAN_SQL)
def s1_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage read through the data source: twelve tiles made by a synthetic service."""
    coverage.register(spark)
    read = spark.read.format("coverage").options(url="synthetic://field", coverage_id="plane", bbox="0,0,400,150", rows=3, cols=4, width=16, height=8).load()
    return pixels.pixels_of(read, "tile_row", "tile_col")


@_query("""
    SELECT (r * 8 + i // 16)::bigint AS y_idx, (c * 16 + i % 16)::bigint AS x_idx, ((100 * c + (i % 16 + 0.5::double) * (100::double / 16)) + 1000 * (50 * (3 - r) - (i // 16 + 0.5::double) * (50::double / 8)))::float AS value,
           CASE WHEN r * 8 + i // 16 = 0 THEN 150 ELSE (23 - (r * 8 + i // 16)) * (150::double / 23) END AS y, CASE WHEN c * 16 + i % 16 = 63 THEN 400 ELSE (c * 16 + i % 16) * (400::double / 63) END AS x
    FROM range(0, 3) t(r), range(0, 4) u(c), range(0, 128) s(i)""")
def x12_create_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: plan, request, fetch, decode, assemble and label."""
    from ..api import create_array

    return create_array(spark, "synthetic://field/wcs", (0, 0, 400, 150), coverage_id="plane", chunk_size=(16, 8), grid_shape=(3, 4)).pixels()


def _decoded(spark: SparkSession, sf_dir: str, encode_batch: Callable, decoder: Callable) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            arrays = [decoder(encode_batch(np.array(v, np.float32).reshape(8, 8))) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.ravel() for a in arrays], pa.list_(pa.float32()))], ["vec_id", "values"])

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, values array<float>")
    return pixels.pixels_of(rows.withColumn("width", F.lit(8)), "vec_id")


@_query("SELECT vec_id, (i // 8)::int AS r, (i % 8)::int AS c, embedding[i + 1] AS value FROM embeddings, range(0, 64) t(i)")
def s9_decode_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles written as deflated TIFF and decoded."""
    return _decoded(spark, sf_dir, lambda a: decode.encode_tiff(a, deflate=True), decode.decode_tiff)


@_query("SELECT vec_id, (i // 8)::int AS r, (i % 8)::int AS c, floor((embedding[i + 1]::double + 1) * 100)::float AS value FROM embeddings, range(0, 64) t(i)")
def s10_decode_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles written as 8-bit PNG and decoded."""

    def encode(a):
        import struct
        import zlib

        import numpy as np

        grey = np.floor((a.astype(np.float64) + 1) * 100).astype(np.uint8)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in grey))) + chunk(b"IEND", b"")

    return _decoded(spark, sf_dir, encode, decode.decode_png)


# An 8 x 8 TIFF in two packings and a 16 x 16 JPEG of four flat blocks, as another encoder wrote them.
_LZW_TIFF = "TU0AKgAAAAgADAEAAAMAAAABAAgAAAEBAAMAAAABAAgAAAECAAMAAAABAAgAAAEDAAMAAAABAAUAAAEGAAMAAAABAAEAAAERAAQAAAABAAAAsAEVAAMAAAABAAEAAAEWAAMAAAABAAgAAAEXAAQAAAABAAAAKwEaAAUAAAABAAAAoAEbAAUAAAABAAAAqAEoAAMAAAABAAEAAAAAAAAAAAAAAAEAAAABAAAAAQAAAAGAACBAADwUDwOCQYUQsUC+HC+GQ2HlCKFArxcrxWLRg8R08H+QH+PR+QwE"
_PACKBITS_TIFF = "TU0AKgAAAAgADAEAAAMAAAABAAgAAAEBAAMAAAABAAgAAAECAAMAAAABAAgAAAEDAAMAAAABgAUAAAEGAAMAAAABAAEAAAERAAQAAAABAAAAsAEVAAMAAAABAAEAAAEWAAMAAAABAAgAAAEXAAQAAAABAAAAIAEaAAUAAAABAAAAoAEbAAUAAAABAAAAqAEoAAMAAAABAAEAAAAAAAAAAAAAAAEAAAABAAAAAQAAAAH9AP0H/QD9B/0o/S/9KP0v/VD9V/1Q/Vf9eP1//Xj9fw=="
_JPEG = "/9j/4AAQSkZJRgABAgAAAQABAAD/2wBDAAgGBgcGBQgHBwcJCQgKDBQNDAsLDBkSEw8UHRofHh0aHBwgJC4nICIsIxwcKDcpLDAxNDQ0Hyc5PTgyPC4zNDL/wAALCAAQABABAREA/8QAHwAAAQUBAQEBAQEAAAAAAAAAAAECAwQFBgcICQoL/8QAtRAAAgEDAwIEAwUFBAQAAAF9AQIDAAQRBRIhMUEGE1FhByJxFDKBkaEII0KxwRVS0fAkM2JyggkKFhcYGRolJicoKSo0NTY3ODk6Q0RFRkdISUpTVFVWV1hZWmNkZWZnaGlqc3R1dnd4eXqDhIWGh4iJipKTlJWWl5iZmqKjpKWmp6ipqrKztLW2t7i5usLDxMXGx8jJytLT1NXW19jZ2uHi4+Tl5ufo6erx8vP09fb3+Pn6/9oACAEBAAA/APD69Qr1CvQK/9k="


def _fixed(spark: SparkSession, sf_dir: str, name: str, key: str, samples: tuple[str, ...], fmt: Format, size: int) -> DataFrame:
    """A row for each row of a table, with one of some fixed images, decoded by the format's registered decoder."""
    image = F.element_at(F.array(*(F.unbase64(F.lit(s)) for s in samples)), (F.col(key) % len(samples) + 1).cast("int"))
    read = decode.resolve_decoder(fmt)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            arrays = [read(raw).ravel() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arrays, pa.list_(pa.float32()))], ["key", "values"])

    rows = _table(spark, sf_dir, name).select(F.col(key).cast("long").alias("key"), image.alias("raw")).mapInArrow(run, "key long, values array<float>")
    return pixels.pixels_of(rows.withColumn("width", F.lit(size)), "key").withColumnRenamed("key", key)


@_query("SELECT s_suppkey, (i // 8)::int AS r, (i % 8)::int AS c, (i // 16 * 40 + i % 8 // 4 * 7)::float AS value FROM supplier, range(0, 64) t(i)")
def s9_decode_lzw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles packed by LZW and PackBits, not by our own encoder."""
    return _fixed(spark, sf_dir, "supplier", "s_suppkey", (_LZW_TIFF, _PACKBITS_TIFF), Format.TIFF, 8)


@_query("SELECT n_nationkey::bigint AS n_nationkey, (i // 16)::int AS r, (i % 16)::int AS c, (16 + 160 * (i // 128) + CASE WHEN i % 16 >= 8 THEN 80 - 16 * (i // 128) ELSE 0 END)::float AS value FROM nation, range(0, 256) t(i)")
def s10_decode_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG tiles, not by our own encoder."""
    return _fixed(spark, sf_dir, "nation", "n_nationkey", (_JPEG,), Format.JPEG, 16)


@_query(_SCAN_SQL + " WHERE r = 1 AND c IN (0, 3)")
def s1_scan_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiles of a coverage; the filter reaches the source, which makes no others."""
    coverage.register(spark)
    read = spark.read.format("coverage").options(url="synthetic://field", coverage_id="plane", bbox="0,0,400,150", rows=3, cols=4, width=16, height=8).load()
    return pixels.pixels_of(read.filter("tile_row = 1 AND tile_col IN (0, 3)"), "tile_row", "tile_col")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all tasks share."""
    import uuid

    from ..sources.cache import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_query("SELECT r::int AS tile_row, c::int AS tile_col, (r + c) % 2 = 0 AS success, CASE WHEN (r + c) % 2 = 0 THEN (10 * r + c)::float END AS value FROM range(0, 3) t(r), range(0, 4) u(c)")
def s4_cached_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a service that is down: those that the cache has are there, the others failed."""
    import numpy as np

    from ..model import ArrayRequest
    from ..sources import cache
    from ..sources.services import CoverageService

    folder = _folder(spark, "cached-fetch")
    request = ArrayRequest.of("file:///nowhere/wcs", (0, 0, 4, 3), coverage_id="c", chunk_size=(1, 1), grid_shape=(3, 4))
    plan = CoverageService("file:///nowhere/wcs", coverage_id="c").tile_requests(spark, request)

    def fill(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cache.write(folder, row["cache_key"], decode.encode_tiff(np.full((1, 1), 10 * row["tile_row"] + row["tile_col"], np.float32)))
            yield batch

    plan.filter((F.col("tile_row") + F.col("tile_col")) % 2 == 0).select("cache_key", "tile_row", "tile_col").mapInArrow(fill, "cache_key string, tile_row int, tile_col int").count()
    found = coverage.load_tiles(plan, cache_dir=folder, retries=0)
    return found.select("tile_row", "tile_col", "success", F.nanvl(F.col("values")[0], F.lit(None).cast("float")).alias("value"))


@_query("SELECT vec_id::varchar AS cache_key, (i // 8)::int AS r, (i % 8)::int AS c, embedding[i + 1] AS value FROM embeddings, range(0, 64) t(i)")
def s6_cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written to a cache as tiles in the tasks, read again as one scan, and decoded."""
    from ..sources import cache

    folder = _folder(spark, "cache-read")

    def put(batches):
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                cache.write(folder, str(row["vec_id"]), decode.encode_tiff(np.array(row["embedding"], np.float32).reshape(8, 8)))
            yield batch.select(["vec_id"])

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            arrays = [decode.decode_tiff(raw).ravel() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arrays, pa.list_(pa.float32()))], ["cache_key", "values"])

    _table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(put, "vec_id long").count()
    entries = cache.entries(spark, "file://" + folder).mapInArrow(read, "cache_key string, values array<float>")
    return pixels.pixels_of(entries.withColumn("width", F.lit(8)), "cache_key")


@_query("SELECT n_name || '/' || n_nationkey::varchar AS name, n_nationkey % 3 > 0 AS saved, CASE WHEN n_nationkey % 3 > 0 THEN repeat(n_name, 3) END AS content FROM nation")
def s8_save_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses written by the tasks, and read again; failed ones aren't written."""
    from ..sources import cache

    folder = _folder(spark, "saved-tiles")
    rows = _table(spark, sf_dir, "nation").select(F.concat_ws("/", "n_name", F.col("n_nationkey").cast("string")).alias("name"), F.encode(F.repeat("n_name", 3), "UTF-8").alias("data"), (F.col("n_nationkey") % 3 > 0).alias("success"))
    saved = spark.createDataFrame(cache.save_tiles(rows, folder).toArrow())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load("file://" + folder)
    found = files.select(F.regexp_extract(F.url_decode("path"), r"([^/]+/[^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("content"))
    return saved.join(found, "name", "left")


def _cases(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """``name, outcome``: what each case gives, or the kind of error that it raises."""
    found = []
    for name, case in cases.items():
        try:
            found.append((name, str(case())))
        except Exception as e:  # noqa: BLE001  the outcome is what is listed
            found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "name string, outcome string")


def _expected(**outcomes: str) -> str:
    rows = ", ".join("('" + name + "', '" + outcome.replace("'", "''") + "')" for name, outcome in outcomes.items())
    return f"SELECT * FROM (VALUES {rows}) t(name, outcome)"


_BOX = (0, 0, 512, 1024)


@_query(_expected(chunk_default="(256, 256)", chunk_config="(128, 128)", chunk_explicit="(64, 64)", grid_inferred="(4, 2)", grid_config="(2, 3)", resolution_one="(4.0, 4.0)", format_explicit="image/png", format_config="image/jpeg", bbox_tuple="(1.0, 2.0, 3.0, 4.0) EPSG:27700", bbox_moved="EPSG:3857 111319", url="https://example.org/wcs", options="2.1.0 1 a", tile_options="coverage_id,headers,resolution,version"))
def p14_default_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit values, then the configuration's, then the built-in ones."""
    from ..model import ArrayRequest, ServiceConfig

    config = ServiceConfig("https://example.org/wcs/", chunk_size=(128, 128), grid_shape=(2, 3), output_format=Format.JPEG, coverage_id="c", headers={"k": "v"})
    of = ArrayRequest.of
    return _cases(spark, {
        "chunk_default": lambda: of("u", _BOX).chunk_size,
        "chunk_config": lambda: of(config, _BOX).chunk_size,
        "chunk_explicit": lambda: of(config, _BOX, chunk_size=(64, 64)).chunk_size,
        "grid_inferred": lambda: of("u", _BOX, resolution=1).grid_shape,
        "grid_config": lambda: of(config, _BOX).grid_shape,
        "resolution_one": lambda: of("u", _BOX, resolution=4).resolution,
        "format_explicit": lambda: of(config, _BOX, output_format="image/png").output_format.value,
        "format_config": lambda: of(config, _BOX).output_format.value,
        "bbox_tuple": lambda: f"{BBox.of((1, 2, 3, 4), 27700).bounds} {BBox.of((1, 2, 3, 4), 27700).crs.value}",
        "bbox_moved": lambda: (lambda b: f"{b.crs.value} {round(b.max_x)}")(of("u", BBox(0, 0, 1, 1), "EPSG:3857").bbox),
        "url": lambda: of(config, _BOX).service_url,
        "options": lambda: (lambda o: f"{o['version']} {o['x']} {o['params']['p']}")(of(config, _BOX, version="2.1.0", x=1, params={"p": "a"}).options),
        "tile_options": lambda: ",".join(sorted(ServiceConfig("u", resolution=1.0, coverage_id="c", headers={"k": "v"}).tile_options())),
    })


@_query(_expected(always="crs=EPSG:4326;service_type=WCS;service_url=u", known="coverage_id=c;crs=EPSG:4326;output_format=image/png;service_type=WCS;service_url=u", shape="(64, 48)", chunks="((24, 24, 16), (32, 16))", dims="('y', 'x')"))
def p13_attribute_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes, shape and chunks of arrays that have not been fetched."""
    from ..api import create_array
    from ..model import ArrayRequest, ServiceType

    text = lambda d: ";".join(f"{k}={v}" for k, v in sorted(d.items()))
    array = create_array(spark, "synthetic://f/wcs", (0, 0, 48, 64), coverage_id="c", chunk_size=(32, 24), resolution=1)
    return _cases(spark, {
        "always": lambda: text(ArrayRequest.of("u", _BOX).attributes(ServiceType.WCS)),
        "known": lambda: text(ArrayRequest.of("u", _BOX, coverage_id="c", output_format="image/png").attributes(ServiceType.WCS)),
        "shape": lambda: array.shape,
        "chunks": lambda: (lambda c: (tuple(sorted(c[0], reverse=True)), c[1]))(array.chunks),
        "dims": lambda: array.dims,
    })


@_query(_expected(chunk_zero="InvalidRequestError", chunk_one="InvalidRequestError", grid_negative="InvalidRequestError", resolution_negative="InvalidRequestError", grid_disagrees="InvalidRequestError", box_flat="InvalidRequestError", crs_unknown="InvalidRequestError", crs_differs="InvalidRequestError", format_unknown="InvalidRequestError", tiles_missing="InvalidRequestError", tile_without_box="InvalidRequestError", geometry_in_other_crs="SparkRuntimeException", coverage_missing="InvalidRequestError", tiles_whole="4"))
def f4_guard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused: sizes, boxes, systems, formats, and plans that are no matrix."""
    from ..model import ArrayRequest, ServiceConfig
    from ..sources.services import CoverageService

    of = ArrayRequest.of
    plan = tiles.grid_plan(spark, BBox(0, 0, 2, 2), (1, 1), (2, 2))
    geometry = spark.createDataFrame([("EPSG:4326",), ("EPSG:3857",)], "crs string")
    return _cases(spark, {
        "chunk_zero": lambda: of("u", _BOX, chunk_size=(0, 1)),
        "chunk_one": lambda: of("u", _BOX, chunk_size=5),
        "grid_negative": lambda: of("u", _BOX, grid_shape=(1, -1)),
        "resolution_negative": lambda: of("u", _BOX, resolution=-1),
        "grid_disagrees": lambda: of("u", _BOX, resolution=4, grid_shape=(9, 9)),
        "box_flat": lambda: BBox(1, 0, 1, 5),
        "crs_unknown": lambda: of("u", _BOX, "EPSG:1"),
        "crs_differs": lambda: of(ServiceConfig("u", crs=Crs.WEB_MERCATOR), _BOX, "EPSG:4326"),
        "format_unknown": lambda: of("u", _BOX, output_format="text/plain"),
        "tiles_missing": lambda: tiles.organised_by_place(plan.filter("col < 1 OR south_row < 1"), 2, 2).count(),
        "tile_without_box": lambda: tiles.organised_by_place(plan.withColumn("max_y", F.expr("CASE WHEN col = 0 THEN max_y END")), 2, 2).count(),
        "geometry_in_other_crs": lambda: boxes.in_crs(geometry, Crs.WGS84).collect(),
        "coverage_missing": lambda: CoverageService("http://x/wcs").tile_requests(spark, of("http://x/wcs", _BOX)),
        "tiles_whole": lambda: tiles.organised_by_place(plan, 2, 2).count(),
    })


@_query(_expected(tiff="decode_tiff", png="decode_png", jpeg="decode_jpeg", none="DecodeError", explicit="len", wcs="CoverageService", wms="UnknownServiceError", by_query="WCS", by_path="WMTS", unknown="UnknownServiceError", contradicted="UnknownServiceError", registered="list"))
def x3_registry_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoders and services by what is registered for them."""
    from ..model import ServiceConfig, ServiceType
    from ..sources import services

    def registered() -> str:
        services.register_service(ServiceType.WMTS)(lambda config, **options: [config])
        try:
            return type(services.get_service("https://x.org/wmts")).__name__
        finally:
            services._REGISTRY.pop(ServiceType.WMTS)

    return _cases(spark, {
        "tiff": lambda: decode.resolve_decoder("image/tiff").__name__,
        "png": lambda: decode.resolve_decoder("image/png").__name__,
        "jpeg": lambda: decode.resolve_decoder("image/jpeg").__name__,
        "none": lambda: decode.resolve_decoder("image/gif"),
        "explicit": lambda: decode.resolve_decoder("image/gif", len).__name__,
        "wcs": lambda: type(services.get_service("https://x.org/wcs")).__name__,
        "wms": lambda: services.get_service("https://x.org/wms"),
        "by_query": lambda: services.detect_service_type("https://x.org/WMS?SERVICE=wcs").value,
        "by_path": lambda: services.detect_service_type("https://x.org/a/wmts/b?service=odd").value,
        "unknown": lambda: services.detect_service_type("https://x.org/a"),
        "contradicted": lambda: services.get_service(ServiceConfig("u", service_type=ServiceType.WCS), "WMS"),
        "registered": registered,
    })


def _service(spark: SparkSession, sf_dir: str):
    """A coverage service of the regions: its transport answers from texts that are made of the table."""
    from ..sources.services import CoverageService
    from ..sources.transport import Response

    names = {f"c{r['r_regionkey']}": r["r_name"] for r in _table(spark, sf_dir, "region").collect()}

    def send(request):
        asked = request.params["request"][0]
        if asked == "GetCapabilities":
            inner = "".join(f"<CoverageSummary><CoverageId>{k}</CoverageId><Title>{v}</Title></CoverageSummary>" for k, v in names.items())
            return Response(f"<Capabilities><Contents>{inner}</Contents></Capabilities>".encode(), "text/xml", 200, {}, request.url, True)
        name = request.params["coverageId"][0]
        if name not in names:
            return Response(b"", "", 404, {}, request.url, False, "HTTP 404")
        if asked == "DescribeCoverage":
            return Response(f"<CoverageDescription><name>{names[name]}</name><CoverageId>{name}</CoverageId></CoverageDescription>".encode(), "text/xml", 200, {}, request.url, True)
        return Response(names[name].encode(), "image/tiff", 200, {}, request.url, True)

    return CoverageService("https://example.org/wcs", coverage_id="c1", transport=send), names


@_query("SELECT 'c' || r_regionkey::varchar AS identifier, r_name AS title FROM region")
def s11_get_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a service's capabilities list."""
    return _service(spark, sf_dir)[0].get_capabilities(spark).select(F.explode("coverages").alias("c")).select("c.identifier", "c.title")


@_query("SELECT 'c' || r_regionkey::varchar AS identifier, r_name AS title, CASE WHEN r_regionkey < 3 THEN r_name ELSE 'HTTP 404' END AS content FROM region")
def s13_get_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions and one-shot coverages; a failed one is a value."""
    own, names = _service(spark, sf_dir)
    found = []
    for name in names:
        row = own.describe_coverage(spark, name).first()
        got = own.get_coverage(name if name < "c3" else "none", BBox(0, 0, 1, 1), 4, 4)
        found.append((row["identifier"], row["title"], got.data.decode() if got.success else got.error_message))
    return spark.createDataFrame(found, "identifier string, title string, content string")


@_query("SELECT * FROM (VALUES ('utm_axis', 500000, 0), ('utm_equator', 833979, 0), ('utm_tower', 630084, 4833439), ('mercator', 222639, 6446276), ('utm_back', 1661, 4364), ('british_back', 172, 5266)) t(name, x, y)")
def p9_control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published points in projected systems, in whole metres, and back in hundredths of a degree."""
    there = [("utm_axis", 15.0, 0.0, Crs.UTM_33N), ("utm_equator", 18.0, 0.0, Crs.UTM_33N), ("utm_tower", -79.387139 + 96, 43.642567, Crs.UTM_33N), ("mercator", 2.0, 50.0, Crs.WEB_MERCATOR)]
    back = [("utm_back", 630084.0, 4833438.6, Crs.UTM_33N), ("british_back", 651409.903, 313177.270, Crs.BRITISH_GRID)]
    points = spark.createDataFrame([(n, x, y) for n, x, y, _ in there + back], "name string, px double, py double")
    whole = lambda v: F.round(v).cast("int")
    x = y = F.lit(None)
    for n, _, _, crs in there:
        u, v = crs_fn.reproject(F.col("px"), F.col("py"), Crs.WGS84, crs)
        x, y = F.when(F.col("name") == n, whole(u)).otherwise(x), F.when(F.col("name") == n, whole(v)).otherwise(y)
    for n, _, _, crs in back:
        u, v = crs_fn.reproject(F.col("px"), F.col("py"), crs, Crs.WGS84)
        x, y = F.when(F.col("name") == n, whole(u * 100)).otherwise(x), F.when(F.col("name") == n, whole(v * 100)).otherwise(y)
    return points.select("name", x.alias("x"), y.alias("y"))


@_query("SELECT y::int AS y, x::int AS x, ((x + 0.5::double) + 1000 * (12 - y - 0.5::double))::float AS value FROM range(0, 12) t(y), range(0, 10) u(x)")
def s2_load_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small array loaded at once, as rows."""
    from ..api import load_array

    found = load_array(spark, "synthetic://field/wcs", (0, 0, 10, 12), coverage_id="plane", chunk_size=(4, 5), resolution=1)
    rows = [(y, x, float(v)) for y, line in enumerate(found) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "y int, x int, value float")


@_query(_expected(first_time="True 1", third_time="True 3", never="False 4 HTTP 500: busy", no_retry="False 1 HTTP 500: busy", report="False 1 <E/>", no_url="InvalidRequestError", no_params="InvalidRequestError", unknown_scheme="InvalidRequestError", missing_file="False 0"))
def s3_fetch_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetching with retries: outcomes, with the number of attempts."""
    from ..sources.transport import Request, Response, fetch

    def attempt(fail: int, retries: int = 3, kind: str = "image/tiff") -> str:
        seen = []

        def send(request):
            seen.append(request)
            if len(seen) <= fail:
                return Response(b"", "", 500, {}, request.url, False, "HTTP 500: busy")
            return Response(b"<E/>", kind, 200, {}, request.url, True)

        got = fetch(Request("http://x", {"a": ["1"]}, {}, "image/tiff", retries=retries), send)
        return " ".join(filter(None, [str(got.success), str(len(seen)), got.error_message]))

    return _cases(spark, {
        "first_time": lambda: attempt(0),
        "third_time": lambda: attempt(2),
        "never": lambda: attempt(9),
        "no_retry": lambda: attempt(9, 0),
        "report": lambda: attempt(0, 3, "text/xml"),
        "no_url": lambda: fetch(Request("", {"a": ["1"]})),
        "no_params": lambda: fetch(Request("http://x", {})),
        "unknown_scheme": lambda: fetch(Request("gopher://x", {"a": ["1"]})),
        "missing_file": lambda: (lambda r: f"{r.success} {r.status_code}")(fetch(Request("file:///nowhere", {"file": ["x"]}, retries=0))),
    })


@_query("SELECT n_nationkey, ['EPSG:3857', 'EPSG:27700', 'EPSG:4326', 'EPSG:4326'][n_nationkey % 4 + 1] AS native_crs, CASE WHEN n_nationkey % 4 < 3 THEN n_name END AS title FROM nation")
def r11_native_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native systems: named, by URI, unknown (the default), and absent."""
    declared = F.element_at(F.array(F.lit("EPSG:3857"), F.lit("http://www.opengis.net/def/crs/EPSG/0/27700"), F.lit("EPSG:9999"), F.lit("")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    name = F.when(F.col("n_nationkey") % 4 < 3, F.concat(F.lit("<name> "), F.col("n_name"), F.lit("</name>"))).otherwise(F.lit("<name/>"))
    xml = F.concat(F.lit("<CoverageDescription>"), name, F.lit("<CoverageId>c</CoverageId><NativeCRS>"), declared, F.lit("</NativeCRS><Envelope><lowerCorner>0 0</lowerCorner><upperCorner>1 1</upperCorner></Envelope></CoverageDescription>"))
    found = metadata.coverage_descriptions(_table(spark, sf_dir, "nation").select("n_nationkey", xml.alias("xml")))
    return found.select("n_nationkey", F.col("spatial_extent.crs").alias("native_crs"), "title")
