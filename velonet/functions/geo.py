"""Column expressions for planar distances, bearings and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velonet import constants as C


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _east(lon1, lat1, lon2, lat2) -> Column:
    return (col(lon2) - col(lon1)) * F.cos(F.radians((col(lat1) + col(lat2)) / 2))


def distance_m(lon1, lat1, lon2, lat2) -> Column:
    """Metres on the local plane at the mean latitude."""
    return F.hypot(_east(lon1, lat1, lon2, lat2) * C.METRES_LON, (col(lat2) - col(lat1)) * C.METRES_LAT)


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Heading in [0, 360), from degrees of latitude and shrunk degrees of longitude."""
    return F.pmod(F.degrees(F.atan2(_east(lon1, lat1, lon2, lat2), col(lat2) - col(lat1))), F.lit(360.0))


def line_bearing(lon1, lat1, lon2, lat2) -> Column:
    """Heading in [0, 180) of an undirected line, in metres."""
    return F.pmod(F.degrees(F.atan2(_east(lon1, lat1, lon2, lat2) * C.METRES_LON, (col(lat2) - col(lat1)) * C.METRES_LAT)), F.lit(180.0))


def quantised(b) -> Column:
    """A bearing in steps of 360/256."""
    return F.pmod(F.bround(col(b) / 1.40625), F.lit(256)) * 1.40625


def swing(arrive, leave) -> Column:
    """Signed turn in [-180, 180); negative is left. Rounded first, so that turning back is -180 and never 180."""
    return F.pmod(F.round(col(leave) - col(arrive) + 540.0, 9), F.lit(360.0)) - 180.0


def line_angle(a, b) -> Column:
    """Angle between two lines, 0 to 90."""
    x = F.pmod(F.abs(col(a) - col(b)), F.lit(180.0))
    return F.least(x, 180.0 - x)


def cuts_across(a, b) -> Column:
    return line_angle(a, b) >= C.CUTS_DEGREES


def same_heading(a, b, degrees: float = C.PARALLEL_DEGREES, folded: bool = False) -> Column:
    """Whether two headings run along each other. Unfolded, opposite headings count only when exactly opposite."""
    if folded:
        return line_angle(a, b) <= degrees
    return F.pmod(F.abs(F.pmod(col(b) - col(a) + 540.0, F.lit(360.0)) - 180.0), F.lit(180.0)) <= degrees


def manoeuvre(s) -> Column:
    s = col(s)
    side = F.when(s < 0, "left").otherwise("right")
    return F.when(F.abs(s) < C.TURN_DEGREES, "straight").when(F.abs(s) >= C.SHARP_DEGREES, F.concat(F.lit("sharp_"), side)).otherwise(side)


def segment_distance_m(lon, lat, lon1, lat1, lon2, lat2) -> Column:
    """Metres from a point to a segment; the foot is clamped to its ends."""
    scale = F.cos(F.radians(col(lat)))
    x1, y1 = (col(lon1) - col(lon)) * scale * C.METRES_LON, (col(lat1) - col(lat)) * C.METRES_LAT
    x2, y2 = (col(lon2) - col(lon)) * scale * C.METRES_LON, (col(lat2) - col(lat)) * C.METRES_LAT
    dx, dy = x2 - x1, y2 - y1
    span = dx * dx + dy * dy
    t = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / span))).otherwise(0.0)
    return F.hypot(x1 + t * dx, y1 + t * dy)


def cell(x, size: float) -> Column:
    return F.floor(col(x) / size)


def within(lon, lat, bounds=C.BOUNDS, margin: float = 0.0) -> Column:
    """Inclusive box test."""
    w, s, e, n = bounds
    return col(lon).between(w - margin, e + margin) & col(lat).between(s - margin, n + margin)


def coordinate_label(lon, lat) -> Column:
    return F.format_string("%.5f, %.5f", col(lat), col(lon))


def zigzag(v) -> Column:
    return F.call_function("shiftleft", col(v).cast("long"), F.lit(1)).bitwiseXOR(F.call_function("shiftright", col(v).cast("long"), F.lit(63)))


def unzigzag(v) -> Column:
    return F.call_function("shiftrightunsigned", col(v).cast("long"), F.lit(1)).bitwiseXOR(-(col(v).cast("long").bitwiseAND(F.lit(1).cast("long"))))


def cell_truncated(x, size: float) -> Column:
    """As ``cell``, but towards zero: the same for positive coordinates."""
    return (col(x) / size).cast("long")


# The reference ellipsoid, and central meridian, scale and false easting of the two national grids.
ELLIPSOID = (6378137.0, 1 / 298.257222101)
GRIDS = {3067: (27.0, 0.9996, 500_000.0), 3879: (25.0, 1.0, 25_500_000.0)}
# Reference systems in degrees that count as those of the map.
DEGREES = (4326, 4258)


def _series() -> tuple[float, tuple[float, ...], tuple[float, ...]]:
    """Radius of the rectifying sphere, and the coefficients to the plane and back, in the third flattening up to its fourth power."""
    a, f = ELLIPSOID
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return radius, there, back


def _conformal() -> tuple[float, ...]:
    """The coefficients from the conformal latitude to the latitude itself."""
    n = ELLIPSOID[1] / (2 - ELLIPSOID[1])
    return 2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630


def to_grid(lon, lat, crs: int) -> tuple[Column, Column]:
    """(east, north) in metres of a transverse Mercator grid, by Krueger's series."""
    meridian, scale, false = GRIDS[crs]
    radius, there, _ = _series()
    f = ELLIPSOID[1]
    e = (f * (2 - f)) ** 0.5
    s = F.sin(F.radians(col(lat)))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    turn = F.radians(col(lon) - meridian)
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, c in enumerate(there, 1):
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return false + scale * radius * east, scale * radius * north


def from_grid(east, north, crs: int) -> tuple[Column, Column]:
    """(lon, lat) in degrees of a point of a transverse Mercator grid."""
    meridian, scale, false = GRIDS[crs]
    radius, _, back = _series()
    xi, eta = col(north) / (scale * radius), (col(east) - false) / (scale * radius)
    x, y = xi, eta
    for j, c in enumerate(back, 1):
        x = x - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, c in enumerate(_conformal(), 1):
        lat = lat + c * F.sin(2 * j * chi)
    return meridian + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)
