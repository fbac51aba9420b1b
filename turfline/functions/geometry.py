"""Projective and affine geometry as column expressions; matrices are row-major arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def project(h: Column, x: Column, y: Column) -> Column:
    """(x, y) through a 3x3 homography; null without a matrix or where the denominator vanishes."""
    w = h[6] * x + h[7] * y + h[8]
    safe = F.when(F.abs(w) >= EPS, w)
    return point((h[0] * x + h[1] * y + h[2]) / safe, (h[3] * x + h[4] * y + h[5]) / safe)


def denominator(h: Column, x: Column, y: Column) -> Column:
    return h[6] * x + h[7] * y + h[8]


def foot(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Middle of a box's lower edge."""
    return point((x1 + x2) / 2, y2 + y1 * 0)


def mat_mul(a: Column, b: Column) -> Column:
    """Product of two 3x3 matrices; null if either is."""
    product = F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])
    return F.when(a.isNotNull() & b.isNotNull(), product)


def det(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def mat_inv(m: Column) -> Column:
    """Inverse by adjugate and determinant; null for a singular matrix."""
    d = F.when(F.abs(det(m)) > 1e-12, det(m))
    minors = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    return F.when(d.isNotNull(), F.array(*[(m[a] * m[b] - m[c] * m[e]) / d for a, b, c, e in minors]))


def lift(affine: Column) -> Column:
    """A 2x3 affine map as a 3x3 matrix; null becomes the identity."""
    eye = F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(9)])
    return F.coalesce(F.concat(affine, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))), eye)


def inside_pitch(p: Column, margin: Column | float, length: float, width: float) -> Column:
    """Within the pitch widened by the margin, edges included; false for what is not finite or absent."""
    margin = F.lit(margin) if isinstance(margin, (int, float)) else margin
    ok = p["x"].between(-margin, margin + length) & p["y"].between(-margin, margin + width)
    finite = ~F.isnan(p["x"]) & ~F.isnan(p["y"])
    return F.coalesce(ok & finite, F.lit(False))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def to_pixels(metres: Column, scale: float, margin: int) -> Column:
    """Rounded half to even."""
    return F.rint(metres * scale + margin).cast("int")


def frames_for(seconds: float, fps: float) -> int:
    """Whole frames of a duration, rounded half to even, at least 1."""
    return max(1, round(seconds * fps))
