"""Distances, projections and text keys as Column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: WGS84
A_M, FLAT = 6378137.0, 1 / 298.257223563
B_M = A_M * (1 - FLAT)


def _h(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle kilometres, arcsine form; null where a coordinate is."""
    h = _h(lat1, lng1, lat2, lng2)  # least() and greatest() pass over nulls
    return F.when(h.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def haversine_atan2(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """The same by atan2, as a cross-check."""
    raw = _h(lat1, lng1, lat2, lng2)
    h = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
    return F.when(raw.isNotNull(), 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h)))


def geodesic(lat1: Column, lng1: Column, lat2: Column, lng2: Column, rounds: int = 12) -> Column:
    """WGS84 kilometres by Vincenty's inverse iteration, as one aggregate() over a fixed number of rounds."""
    u1, u2 = F.atan((1 - FLAT) * F.tan(F.radians(lat1))), F.atan((1 - FLAT) * F.tan(F.radians(lat2)))
    su1, cu1, su2, cu2, ll = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2), F.radians(lng2 - lng1)

    def parts(lam: Column) -> tuple[Column, ...]:
        ss = F.sqrt(F.pow(cu2 * F.sin(lam), 2) + F.pow(cu1 * su2 - su1 * cu2 * F.cos(lam), 2))
        cs = su1 * su2 + cu1 * cu2 * F.cos(lam)
        sa = F.when(ss == 0, F.lit(0.0)).otherwise(cu1 * cu2 * F.sin(lam) / F.when(ss == 0, F.lit(1.0)).otherwise(ss))
        c2a = 1 - sa * sa
        c2m = F.when(c2a == 0, F.lit(0.0)).otherwise(cs - 2 * su1 * su2 / F.when(c2a == 0, F.lit(1.0)).otherwise(c2a))
        return ss, cs, F.atan2(ss, cs), sa, c2a, c2m

    def step(lam: Column, _: Column) -> Column:
        ss, cs, s, sa, c2a, c2m = parts(lam)
        c = FLAT / 16 * c2a * (4 + FLAT * (4 - 3 * c2a))
        return ll + (1 - c) * FLAT * sa * (s + c * ss * (c2m + c * cs * (-1 + 2 * c2m * c2m)))

    lam = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), ll.cast("double"), step)

    def finish(lam: Column) -> Column:
        ss, cs, s, _, c2a, c2m = parts(lam)
        u = c2a * (A_M**2 - B_M**2) / B_M**2
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = b * ss * (c2m + b / 4 * (cs * (-1 + 2 * c2m * c2m) - b / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))
        return B_M * a * (s - d) / 1000

    return F.get(F.transform(F.array(lam), finish), F.lit(0))


# Transverse Mercator, zone 23 south: central meridian -45, false easting 500 km, false northing 10 000 km.
_N = FLAT / (2 - FLAT)
_AA = A_M / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = (1 - FLAT) ** 2
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
K0, MERIDIAN, EAST, NORTH = 0.9996, -45.0, 500_000.0, 10_000_000.0


def to_utm(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    s = F.sin(F.radians(lat))
    e = 2 * _N**0.5 / (1 + _N)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(s) - e * atanh(e * s))
    dl = F.radians(lng - MERIDIAN)
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return EAST + K0 * _AA * x, NORTH + K0 * _AA * y


def from_utm(east: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    xi0, eta0 = (north - NORTH) / (K0 * _AA), (east - EAST) / (K0 * _AA)
    xi = xi0 - sum(b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0) for j, b in enumerate(_BETA, 1))
    eta = eta0 - sum(b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0) for j, b in enumerate(_BETA, 1))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return F.degrees(phi), MERIDIAN + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def cover_target(total: Column, p: int = 95, q: int = 100) -> Column:
    """Smallest whole number of orders that is at least p / q of the total."""
    return F.floor((total * p + (q - 1)) / F.lit(q)).cast("long")


ACCENTS, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"


def city_key(name: Column, ascii_only: bool = True) -> Column:
    """Lower case, trimmed, accents dropped; other letters beyond ASCII dropped too unless told otherwise."""
    plain = F.translate(F.lower(F.trim(name)), ACCENTS, PLAIN)
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "") if ascii_only else plain


def prefix_key(value: Column) -> Column:
    """Five digits from one to five ASCII digits, else null."""
    return F.when(value.rlike(r"^[0-9]{1,5}$"), F.lpad(value, 5, "0"))


def prefix_lenient(value: Column) -> Column:
    """Without a trailing '.0'; digits are filled to five, longer or other strings stay."""
    bare = F.regexp_replace(F.trim(value), r"\.0$", "")
    return F.when(bare.rlike(r"^[0-9]{1,4}$"), F.lpad(bare, 5, "0")).otherwise(bare)


def arc_degrees(km: float) -> float:
    return km * 180 / (pi * EARTH_KM)
