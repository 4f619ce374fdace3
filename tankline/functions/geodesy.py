"""Projection and distance as Column expressions: UTM by a Krueger series, the great circle, and the ellipsoid's geodesic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid, the scale of UTM and the mean radius of the earth in metres.
A, FLATTENING, SCALE, RADIUS = 6378137.0, 1 / 298.257223563, 0.9996, 6371008.8

#: Steps of the geodesic's iteration, and how close two of them must come, in radians.
STEPS, CLOSE = 40, 1e-11

_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_ECC = 2 * _N**0.5 / (1 + _N)


def utm_zone(lon: Column) -> Column:
    """1 to 60; the exceptions in the north of Europe aren't made."""
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lon)


def utm_xy(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres in a zone, north of the equator or, below it, from 10,000 km."""
    off, phi = F.radians(lon - (zone * 6 - 183)), F.radians(lat)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + SCALE * _RECTIFYING * x, F.when(lat < 0, 10000000.0).otherwise(0.0) + SCALE * _RECTIFYING * y


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere; within 0.6 % of the ellipsoid."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _arc(lam: Column, su1: Column, cu1: Column, su2: Column, cu2: Column) -> Column:
    """(s, c, a, q, m) of two places lam apart on the auxiliary sphere: sine and cosine of the arc between them, the sine of the
    geodesic's azimuth at the equator, 1 - a^2, and the cosine of twice the arc from the equator to the middle."""
    cross = cu1 * su2 - su1 * cu2 * F.cos(lam)
    sides = F.struct(F.sqrt(F.pow(cu2 * F.sin(lam), 2) + F.pow(cross, 2)).alias("s"), (su1 * su2 + cu1 * cu2 * F.cos(lam)).alias("c"))
    azimuth = lambda v: F.when(v["s"] == 0, 0.0).otherwise(cu1 * cu2 * F.sin(lam) / F.when(v["s"] == 0, 1.0).otherwise(v["s"]))
    with_a = lambda v: F.struct(v["s"].alias("s"), v["c"].alias("c"), azimuth(v).alias("a"))
    with_q = lambda v: F.struct(v["s"].alias("s"), v["c"].alias("c"), v["a"].alias("a"), (1 - v["a"] * v["a"]).alias("q"))
    middle = lambda v: F.when(v["q"] < 1e-15, 0.0).otherwise(v["c"] - 2 * su1 * su2 / F.when(v["q"] < 1e-15, 1.0).otherwise(v["q"]))
    with_m = lambda v: F.struct(v["s"].alias("s"), v["c"].alias("c"), v["a"].alias("a"), v["q"].alias("q"), middle(v).alias("m"))
    return _let(_let(_let(sides, with_a), with_q), with_m)


def ellipsoid_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the ellipsoid along the geodesic, to a tenth of a millimetre: the longitudes' difference on the auxiliary sphere is
    iterated until it stands. For places so nearly opposite each other that it doesn't, the great circle's metres."""
    b = A * (1 - FLATTENING)
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    turn = F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180  # the short way round
    given = F.struct(F.sin(reduced(lat1)).alias("su1"), F.cos(reduced(lat1)).alias("cu1"), F.sin(reduced(lat2)).alias("su2"), F.cos(reduced(lat2)).alias("cu2"), F.radians(turn).alias("l"))

    def longer(g: Column, lam: Column) -> Column:
        def step(v: Column) -> Column:
            k = FLATTENING / 16 * v["q"] * (4 + FLATTENING * (4 - 3 * v["q"]))
            return _let(k, lambda k: g["l"] + (1 - k) * FLATTENING * v["a"] * (F.atan2(v["s"], v["c"]) + k * v["s"] * (v["m"] + k * v["c"] * (2 * v["m"] * v["m"] - 1))))

        return _let(_arc(lam, g["su1"], g["cu1"], g["su2"], g["cu2"]), step)

    def metres(v: Column) -> Column:
        u = v["q"] * (A * A - b * b) / (b * b)
        high = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        low = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m2 = v["m"] * v["m"]
        less = low * v["s"] * (v["m"] + low / 4 * (v["c"] * (2 * m2 - 1) - low / 6 * v["m"] * (4 * v["s"] * v["s"] - 3) * (4 * m2 - 3)))
        return b * high * (F.atan2(v["s"], v["c"]) - less)

    def found(g: Column) -> Column:
        start = F.struct(g["l"].alias("lam"), F.lit(1.0).alias("moved"))
        step = lambda s: _let(longer(g, s["lam"]), lambda to: F.struct(to.alias("lam"), F.abs(to - s["lam"]).alias("moved")))
        stands = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: F.when(s["moved"] < CLOSE, s).otherwise(step(s)))
        return _let(stands, lambda s: F.when((s["moved"] < CLOSE) & (F.abs(s["lam"]) <= 3.2), metres(_arc(s["lam"], g["su1"], g["cu1"], g["su2"], g["cu2"]))))

    return F.when((lon1 == lon2) & (lat1 == lat2), 0.0).otherwise(F.coalesce(_let(given, found), great_circle(lon1, lat1, lon2, lat2)))
