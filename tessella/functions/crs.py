"""Map projections on the GRS80 ellipsoid as Catalyst expressions: transverse Mercator (UTM) and Lambert azimuthal equal area.

Coordinates are degrees on the one side and metres on the other. Areas on the ellipsoid are those of the equal-area
projection. SRIDs name the systems: 4258 (degrees), 25828 to 25838 (UTM zones 28 to 38 north), 3035 (equal area, Europe).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.geometry import point, ring_area

#: GRS80's larger half-axis and flattening; UTM's scale and false easting; the equal-area system's centre.
A, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0
CENTRE_LON, CENTRE_LAT, FALSE_EAST, FALSE_NORTH = 10.0, 52.0, 4321000.0, 3210000.0
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
N = FLATTENING / (2 - FLATTENING)
#: Radius of the rectifying sphere, and the Krueger series to the third power of N.
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
KRUEGER = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)


def utm(lon: Column, lat: Column, zone: int) -> Column:
    """Point in metres in a UTM zone of the northern half."""
    phi, away = F.radians(lat), F.radians(lon - (6.0 * zone - 183.0))
    s = F.sin(phi)
    conformal = F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s))
    xi, eta = F.atan2(conformal, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + conformal * conformal))
    x, y = eta, xi
    for j, c in enumerate(KRUEGER, 1):
        x = x + c * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        y = y + c * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    return point(EAST + SCALE * RADIUS * x, SCALE * RADIUS * y)


def authalic(s: float | Column):
    """q of a sine of latitude, for numbers and columns alike."""
    if isinstance(s, Column):
        return (1 - ECC**2) * (s / (1 - ECC**2 * s * s) + F.atanh(ECC * s) / ECC)
    return (1 - ECC**2) * (s / (1 - ECC**2 * s * s) + math.atanh(ECC * s) / ECC)


QP, S0 = authalic(1.0), math.sin(math.radians(CENTRE_LAT))
B0 = math.asin(authalic(S0) / QP)
RQ = A * math.sqrt(QP / 2)
D = A * math.cos(math.radians(CENTRE_LAT)) / (math.sqrt(1 - ECC**2 * S0**2) * RQ * math.cos(B0))


def equal_area(lon: Column, lat: Column) -> Column:
    """Point in metres in the equal-area system of Europe."""
    sine = authalic(F.sin(F.radians(lat))) / QP
    cosine, away = F.sqrt(1 - sine * sine), F.radians(lon - CENTRE_LON)
    b = RQ * F.sqrt(2.0 / (1 + math.sin(B0) * sine + math.cos(B0) * cosine * F.cos(away)))
    return point(FALSE_EAST + b * D * cosine * F.sin(away), FALSE_NORTH + b / D * (math.cos(B0) * sine - math.sin(B0) * cosine * F.cos(away)))


def transform(pts: Column, srid: int) -> Column:
    """A line in degrees (4258) in another system; 4258 leaves it as it is."""
    if srid == 4258:
        return pts
    if srid == 3035:
        return F.transform(pts, lambda p: equal_area(p["x"], p["y"]))
    if 25828 <= srid <= 25838:
        return F.transform(pts, lambda p: utm(p["x"], p["y"], srid - 25800))
    raise ValueError(f"unknown SRID {srid}")


def spheroid_area(ring: Column) -> Column:
    """Square metres of a ring in degrees; sides are straight in the equal-area system, not geodesics."""
    return F.abs(ring_area(transform(ring, 3035)))


def spheroid_length(a: Column, b: Column) -> Column:
    """Metres between two points in degrees by Andoyer's formula of the first order in the flattening."""
    f, g, l = (F.radians((a["y"] + b["y"]) / 2), F.radians((a["y"] - b["y"]) / 2), F.radians((a["x"] - b["x"]) / 2))  # noqa: E741
    sq = lambda c: c * c
    s = sq(F.sin(g)) * sq(F.cos(l)) + sq(F.cos(f)) * sq(F.sin(l))
    c = sq(F.cos(g)) * sq(F.cos(l)) + sq(F.sin(f)) * sq(F.sin(l))
    w = F.atan2(F.sqrt(s), F.sqrt(c))
    r = F.sqrt(s * c) / w
    h1, h2 = (3 * r - 1) / (2 * c), (3 * r + 1) / (2 * s)
    far = 2 * w * A * (1 + FLATTENING * h1 * sq(F.sin(f)) * sq(F.cos(g)) - FLATTENING * h2 * sq(F.cos(f)) * sq(F.sin(g)))
    return F.when((a["x"] == b["x"]) & (a["y"] == b["y"]), 0.0).otherwise(far)
