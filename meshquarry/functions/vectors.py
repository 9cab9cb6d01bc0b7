"""Small vector kernels over columns: tetrahedra, distances, mesh volume terms, ray crossings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshquarry.functions.boxes import total

V = Sequence[Column]


def sub(a: V, b: V) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def dot(a: V, b: V) -> Column:
    return total([x * y for x, y in zip(a, b)])


def cross(a: V, b: V) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def distance2(a: V, b: V) -> Column:
    d = sub(a, b)
    return dot(d, d)


def norm(a: V) -> Column:
    return F.sqrt(dot(a, a))


def tet_volume(a: V, b: V, c: V, d: V) -> Column:
    """|(b - a) . ((c - a) x (d - a))| / 6."""
    return F.abs(dot(sub(b, a), cross(sub(c, a), sub(d, a)))) / 6


def tet_centroid(a: V, b: V, c: V, d: V) -> list[Column]:
    return [(w + x + y + z) / 4 for w, x, y, z in zip(a, b, c, d)]


def signed_volume(a: V, b: V, c: V) -> Column:
    """Contribution of a triangle to the volume of its closed surface."""
    return dot(a, cross(b, c)) / 6


def cuboid_distance(p: V, half: V) -> Column:
    """Signed distance of a point to a cuboid around the origin with the given half sides."""
    q = [F.abs(x) - h for x, h in zip(p, half)]
    outside = norm([F.greatest(x, F.lit(0.0)) for x in q])
    return outside + F.least(F.greatest(*q), F.lit(0.0))


#: Direction of the rays of the inside test and its tolerance (fixed values).
RAY, RAY_EPS = (1.0, 0.372137, 0.157913), 1e-10


def ray_hits(p: V, a: V, b: V, c: V) -> Column:
    """Whether the ray from p in :data:`RAY` crosses the triangle ahead of p."""
    r = [F.lit(x) for x in RAY]
    e1, e2 = sub(b, a), sub(c, a)
    h = cross(r, e2)
    det = dot(e1, h)
    s = sub(p, a)
    u, q = dot(s, h) / F.nullif(det, F.lit(0.0)), cross(s, e1)
    v, t = dot(r, q) / F.nullif(det, F.lit(0.0)), dot(e2, q) / F.nullif(det, F.lit(0.0))
    return F.coalesce((F.abs(det) > RAY_EPS) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > RAY_EPS), F.lit(False))
