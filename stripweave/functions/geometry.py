"""Column helpers: vectors, rays, planes, scattering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the detector: distance of towers, of strips, of layers (mm).
TOWER_PITCH, STRIP_PITCH, LAYER_PITCH, TRAY_WIDTH = 374.5, 0.228, 32.575, 358.6

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Vec, b: Vec) -> Column:
    """Angle between two directions; the cosine is clamped, so rounding never gives NaN."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (length(a) * length(b)))))


def plane(layer: Column, view: Column) -> Column:
    return 2 * layer + view


def order_key(tower: Column, layer: Column, view: Column) -> Column:
    return view + 2 * layer + 64 * tower


def scattering(rad_len: Column, energy: Column) -> Column:
    """Multiple-scattering angle for a thickness in radiation lengths and an energy in MeV (published formula)."""
    return 13.6 * F.sqrt(rad_len) * (1 + 0.038 * F.log(rad_len)) / energy


def ray_distance(p: Vec, d: Vec, q: Vec, e: Vec) -> Column:
    """Closest approach of two rays (point, direction); parallel rays: distance of q from the first."""
    w, n = minus(q, p), cross(d, e)
    size = length(n)
    along = dot(w, d) / dot(d, d)
    apart = length((w[0] - along * d[0], w[1] - along * d[1], w[2] - along * d[2]))
    return F.when(size > 1e-9, F.abs(dot(w, n)) / size).otherwise(apart)


#: Coefficients of a published rational approximation of the error function.
ERF = (0.47047, 0.34802, 0.09587, 0.74785)


def fast_erf(x: Column) -> Column:
    """The error function for x >= 0, to about 3e-5."""
    p, a, b, c = ERF
    t = 1 / (1 + p * x)
    return 1 - (a - (b - c * t) * t) * t * F.exp(-x * x)


def threshold(x: Column) -> Column:
    """A smooth step from 1 (x far below 0) to 0."""
    f = fast_erf(F.abs(x))
    return F.when(x < 0, 0.5 * (1 + f)).otherwise(0.5 * (1 - f))
