"""Coordinate reference systems as column expressions, without Python on the executors.

Every system converts to and from longitude and latitude on WGS 84. The transverse Mercator
systems use the Krüger series to the sixth order in the third flattening; the British grid adds
the published seven-parameter shift between its datum and WGS 84, good to some metres.

A conversion is a list of steps from columns to columns. Most are written out as one expression inside
code generation. Those of the British grid use what came before so often that this expression would have
a hundred thousand nodes and more, so there each step's results are held in a struct instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..model import BBox, Crs

# Radius of the sphere of EPSG:3857, and ellipsoids (semi-major axis, flattening).
SPHERE = 6378137.0
WGS84 = (6378137.0, 1 / 298.257223563)
AIRY = (6377563.396, 1 - 6356256.909 / 6377563.396)
# Shift from WGS 84 to OSGB36: metres, parts per million, arc seconds.
SHIFT = (-446.448, 125.157, -542.060, 20.4894, -0.1502, -0.2470, -0.8421)

Step = Callable[..., tuple[Column, ...]]


def _written_out(point: tuple[Column, Column], steps: list[Step]) -> tuple[Column, Column]:
    """All steps as one expression, which grows with each use of a value."""
    values: tuple[Column, ...] = point
    for step in steps:
        values = step(*values)
    return values


def _held(point: tuple[Column, Column], steps: list[Step]) -> tuple[Column, Column]:
    """The same with each step's values computed once: the expression grows with the steps alone."""

    def struct(values: tuple[Column, ...]) -> Column:
        return F.struct(*(v.alias(f"v{k}") for k, v in enumerate(values)))

    def after(held: Column, step: Step, n: int) -> Column:
        def body(s: Column) -> Column:
            values = step(*(s[f"v{k}"] for k in range(n)))
            sizes.append(len(values))
            return struct(values)

        return F.transform(held, body)

    held, sizes = F.array(struct(point)), [2]
    for step in steps:
        held = after(held, step, sizes[-1])
    return held[0]["v0"], held[0]["v1"]


def normalised(value: Column) -> Column:
    """``EPSG:n`` of a supported system from ``EPSG:n`` in any case, or n; others raise."""
    text = F.upper(F.trim(value.cast("string")))
    named = F.when(text.startswith("EPSG:"), text).otherwise(F.concat(F.lit("EPSG:"), text))
    return F.when(named.isin([c.value for c in Crs]), named).when(value.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("unsupported CRS: "), value.cast("string"))).cast("string"))


@dataclass(frozen=True)
class TransverseMercator:
    """A transverse Mercator projection; angles in degrees."""

    ellipsoid: tuple[float, float]
    lat0: float
    lon0: float
    scale: float
    false_e: float
    false_n: float

    @property
    def e(self) -> float:
        f = self.ellipsoid[1]
        return math.sqrt(f * (2 - f))

    @property
    def n(self) -> float:
        f = self.ellipsoid[1]
        return f / (2 - f)

    @property
    def radius(self) -> float:
        """Of the rectifying sphere."""
        n = self.n
        return self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)

    def _alpha(self) -> list[float]:
        n = self.n
        return [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
            61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
            49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
            34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
            212378941 * n**6 / 319334400,
        ]

    def _beta(self) -> list[float]:
        n = self.n
        return [
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
            17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
            4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
            4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
            20648693 * n**6 / 638668800,
        ]

    def _origin(self) -> float:
        """Rectifying latitude of the origin, on the unit sphere."""
        s = math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - self.e * math.atanh(self.e * s)))
        return xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(self._alpha(), 1))

    def forward_steps(self) -> list[Step]:
        k = self.scale * self.radius

        def sine(lon: Column, lat: Column) -> tuple[Column, ...]:
            return F.sin(F.radians(lat)), F.radians(lon - F.lit(self.lon0))

        def conformal(s: Column, dlon: Column) -> tuple[Column, ...]:
            return F.sinh(F.atanh(s) - F.lit(self.e) * F.atanh(F.lit(self.e) * s)), dlon

        def sphere(t: Column, dlon: Column) -> tuple[Column, ...]:
            return F.atan2(t, F.cos(dlon)), F.asinh(F.sin(dlon) / F.sqrt(t * t + F.cos(dlon) * F.cos(dlon)))

        def grid(xi: Column, eta: Column) -> tuple[Column, ...]:
            north, east = xi, eta
            for j, a in enumerate(self._alpha(), 1):
                north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
                east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            return F.lit(self.false_e) + F.lit(k) * east, F.lit(self.false_n) + F.lit(k) * (north - F.lit(self._origin()))

        return [sine, conformal, sphere, grid]

    def inverse_steps(self) -> list[Step]:
        k = self.scale * self.radius

        def scaled(x: Column, y: Column) -> tuple[Column, ...]:
            return (y - F.lit(self.false_n)) / F.lit(k) + F.lit(self._origin()), (x - F.lit(self.false_e)) / F.lit(k)

        def sphere(north: Column, east: Column) -> tuple[Column, ...]:
            xi, eta = north, east
            for j, b in enumerate(self._beta(), 1):
                xi = xi - F.lit(b) * F.sin(2 * j * north) * F.cosh(2 * j * east)
                eta = eta - F.lit(b) * F.cos(2 * j * north) * F.sinh(2 * j * east)
            return xi, eta

        def conformal(xi: Column, eta: Column) -> tuple[Column, ...]:
            return F.asin(F.sin(xi) / F.cosh(eta)), F.lit(self.lon0) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))

        def degrees(conformal: Column, lon: Column) -> tuple[Column, ...]:
            psi, lat = F.atanh(F.sin(conformal)), conformal
            for _ in range(5):  # the fixed point contracts by e squared each time
                lat = F.asin(F.tanh(psi + F.lit(self.e) * F.atanh(F.lit(self.e) * F.sin(lat))))
            return lon, F.degrees(lat)

        return [scaled, sphere, conformal, degrees]


UTM_33N = TransverseMercator(WGS84, 0.0, 15.0, 0.9996, 500_000.0, 0.0)
BRITISH = TransverseMercator(AIRY, 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0)


def _shift_steps(source: tuple[float, float], target: tuple[float, float], sign: int) -> list[Step]:
    """From one datum to the other by way of geocentric coordinates."""

    def normal(lon: Column, lat: Column) -> tuple[Column, ...]:
        a, f = source
        phi = F.radians(lat)
        return F.lit(a) / F.sqrt(1 - F.lit(f * (2 - f)) * F.sin(phi) * F.sin(phi)), phi, F.radians(lon)

    def geocentric(nu: Column, phi: Column, lam: Column) -> tuple[Column, ...]:
        f = source[1]
        return nu * F.cos(phi) * F.cos(lam), nu * F.cos(phi) * F.sin(lam), nu * F.lit(1 - f * (2 - f)) * F.sin(phi)

    def shifted(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        tx, ty, tz, ppm, *turns = (sign * v for v in SHIFT)
        rx, ry, rz = (math.radians(v / 3600) for v in turns)
        s = 1 + ppm * 1e-6
        return F.lit(tx) + F.lit(s) * x - F.lit(rz) * y + F.lit(ry) * z, F.lit(ty) + F.lit(rz) * x + F.lit(s) * y - F.lit(rx) * z, F.lit(tz) - F.lit(ry) * x + F.lit(rx) * y + F.lit(s) * z

    a, f = target
    e2, b = f * (2 - f), a * (1 - f)

    def axis(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        return F.hypot(x, y), z, F.degrees(F.atan2(y, x))

    def reduced(p: Column, z: Column, lon: Column) -> tuple[Column, ...]:
        return F.atan2(z * F.lit(a), p * F.lit(b)), p, z, lon

    def degrees(theta: Column, p: Column, z: Column, lon: Column) -> tuple[Column, ...]:
        up = z + F.lit(e2 / (1 - e2) * b) * F.pow(F.sin(theta), 3)
        out = p - F.lit(e2 * a) * F.pow(F.cos(theta), 3)
        return lon, F.degrees(F.atan2(up, out))

    return [normal, geocentric, shifted, axis, reduced, degrees]


def _to_lon_lat(crs: Crs) -> list[Step]:
    """To WGS 84 longitude and latitude from a point in ``crs``."""
    if crs is Crs.WGS84:
        return []
    if crs is Crs.WEB_MERCATOR:
        return [lambda x, y: (F.degrees(x / F.lit(SPHERE)), F.degrees(F.atan(F.sinh(y / F.lit(SPHERE)))))]
    if crs is Crs.UTM_33N:
        return UTM_33N.inverse_steps()
    return [*BRITISH.inverse_steps(), *_shift_steps(AIRY, WGS84, -1)]


def _from_lon_lat(crs: Crs) -> list[Step]:
    """To the point in ``crs`` from a WGS 84 longitude and latitude."""
    if crs is Crs.WGS84:
        return []
    if crs is Crs.WEB_MERCATOR:
        return [lambda lon, lat: (F.lit(SPHERE) * F.radians(lon), F.lit(SPHERE) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)))]
    if crs is Crs.UTM_33N:
        return UTM_33N.forward_steps()
    return [*_shift_steps(WGS84, AIRY, 1), *BRITISH.forward_steps()]


def reproject(x: Column, y: Column, source: Crs | str | int, target: Crs | str | int) -> tuple[Column, Column]:
    """A point from one system to another; x stays x-like (longitude, easting) throughout."""
    source, target = Crs.of(source), Crs.of(target)
    if source is target:
        return x, y
    convert = _held if Crs.BRITISH_GRID in (source, target) else _written_out
    return convert((x, y), [*_to_lon_lat(source), *_from_lon_lat(target)])


def reproject_bbox(box: BBox, target: Crs) -> BBox:
    """The box around the two transformed corners."""
    if box.crs is target:
        return box
    spark = SparkSession.active()
    low = reproject(F.lit(box.min_x), F.lit(box.min_y), box.crs, target)
    high = reproject(F.lit(box.max_x), F.lit(box.max_y), box.crs, target)
    return BBox(*spark.range(1).select(*low, *high).first(), crs=target)
