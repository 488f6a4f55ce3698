"""Vector geometry on columns. A point or vector is a tuple of three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def point(name: str, fields: str = "xyz") -> Vector:
    """The point in struct column ``name``."""
    return tuple(F.col(f"{name}.{c}") for c in fields)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def angle(a: Vector, b: Vector, c: Vector) -> Column:
    """The angle at ``b`` in radians."""
    u, v = minus(a, b), minus(c, b)
    cosine = dot(u, v) / (norm(u) * norm(v))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def dihedral(p0: Vector, p1: Vector, p2: Vector, p3: Vector) -> Column:
    """Signed torsion about p1-p2 in radians."""
    a, b, c = minus(p1, p0), minus(p2, p1), minus(p3, p2)
    n1, n2 = cross(a, b), cross(b, c)
    return F.atan2(norm(b) * dot(a, n2), dot(n1, n2))


def rounded(c: Column, decimals: int = 4) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, decimals) + F.lit(0.0)


def bin10(radians: Column) -> Column:
    """The nearest ten degrees: to a degree first, halves to even, then to ten, halves to the even ten."""
    return (F.bround(F.bround(F.degrees(radians), 0) / 10, 0) * 10).cast("int")
