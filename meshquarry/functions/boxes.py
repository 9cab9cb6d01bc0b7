"""Box and edit kernels as column expressions.

A box is six DOUBLE columns min_x, min_y, min_z, max_x, max_y, max_z. All kernels are built from
Spark expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
LOWS, HIGHS = tuple(f"min_{a}" for a in AXES), tuple(f"max_{a}" for a in AXES)
BOUNDS = (*LOWS, *HIGHS)
Box = Sequence[Column]


def box(prefix: str = "") -> list[Column]:
    """The six bounds in columns with a common prefix."""
    return [F.col(prefix + c) for c in BOUNDS]


def extents(b: Box) -> list[Column]:
    """Side lengths; 0 where max is below min."""
    return [F.greatest(F.lit(0.0), b[i + 3] - b[i]) for i in range(3)]


def product(cs: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x * y, cs)


def total(cs: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, cs)


def volume(b: Box) -> Column:
    """Volume with extents clamped at 0."""
    return product(extents(b))


def is_valid(b: Box) -> Column:
    """Whether min is strictly below max on every axis."""
    return (b[0] < b[3]) & (b[1] < b[4]) & (b[2] < b[5])


def contains(b: Box, p: Sequence[Column]) -> Column:
    """Whether a point lies in the box; both ends count."""
    return reduce(lambda x, y: x & y, [(p[i] >= b[i]) & (p[i] <= b[i + 3]) for i in range(3)])


def rotate(r: Sequence[Column] | Column, p: Sequence[Column]) -> list[Column]:
    """Row-major 3x3 rotation times a point; ``r`` is nine columns or one array column."""
    m = [r[i] for i in range(9)]
    return [total([m[3 * i + k] * p[k] for k in range(3)]) for i in range(3)]


def contains_oriented(b: Box, r: Sequence[Column] | Column, p: Sequence[Column]) -> Column:
    """Whether a point lies in the box of a rotated frame; points that aren't finite don't."""
    finite = reduce(lambda x, y: x & y, [~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in p])
    return finite & contains(b, rotate(r, p))


def contains_proposal(v: Column, p: Sequence[Column], tol: float = 1e-9) -> Column:
    """Whether a point lies in a proposal box: array of 6 (centre, size), 12 (centre, half axes) or 24 (corners).

    The 24-number form is tested by the bounds of its corners. Other lengths give null.
    """
    six = reduce(lambda x, y: x & y, [F.abs(p[i] - v[i]) <= F.greatest(v[i + 3], F.lit(1e-6)) / 2 + tol for i in range(3)])
    def along(k: int) -> Column:
        h = [v[3 + 3 * k + i] for i in range(3)]
        n = F.greatest(F.sqrt(total([c * c for c in h])), F.lit(1e-9))
        return F.abs(total([(p[i] - v[i]) * h[i] for i in range(3)])) / n <= n + tol
    twelve = along(0) & along(1) & along(2)
    corner = [F.array(*(v[3 * k + i] for k in range(8))) for i in range(3)]
    many = reduce(lambda x, y: x & y, [(p[i] >= F.array_min(corner[i]) - tol) & (p[i] <= F.array_max(corner[i]) + tol) for i in range(3)])
    return F.when(F.size(v) == 6, six).when(F.size(v) == 12, twelve).when(F.size(v) == 24, many)


def proposal_volume(v: Column) -> Column:
    """Volume of a proposal box of 6, 12 (8 times the determinant of the half axes) or 24 numbers (bounds of the corners)."""
    h = [[v[3 + 3 * k + i] for i in range(3)] for k in range(3)]
    det = total([h[0][i] * (h[1][(i + 1) % 3] * h[2][(i + 2) % 3] - h[1][(i + 2) % 3] * h[2][(i + 1) % 3]) for i in range(3)])
    corner = [F.array(*(v[3 * k + i] for k in range(8))) for i in range(3)]
    return (
        F.when(F.size(v) == 6, product([F.greatest(F.lit(0.0), v[i]) for i in (3, 4, 5)]))
        .when(F.size(v) == 12, 8 * F.abs(det))
        .when(F.size(v) == 24, product([F.array_max(c) - F.array_min(c) for c in corner]))
    )


def as_proposal(b: Box, form: int) -> Column:
    """A box as an array of 6, 12 or 24 numbers (see :func:`contains_proposal`)."""
    mid, size = [(b[i] + b[i + 3]) / 2 for i in range(3)], [b[i + 3] - b[i] for i in range(3)]
    if form == 6:
        return F.array(*mid, *size)
    if form == 12:
        return F.array(*mid, *(size[i] / 2 if i == k else F.lit(0.0) for k in range(3) for i in range(3)))
    return F.array(*(b[i + 3 * (k >> i & 1)] for k in range(8) for i in range(3)))


def scaled_proposal(v: Column, s: float) -> Column:
    """A proposal box of any form scaled about its centre (the mean of the corners); scales below 1e-6 count as that."""
    k = max(float(s), 1e-6)
    mean = [total([v[3 * k_ + i] for k_ in range(8)]) / 8 for i in range(3)]
    many = F.transform(v, lambda x, j: (lambda m: m + (x - m) * k)(F.array(*mean)[j % 3]))
    return F.when(F.size(v) == 24, many).otherwise(F.transform(v, lambda x, j: F.when(j < 3, x).otherwise(x * k)))


def corners(b: Box) -> Column:
    """The eight corners as an array of structs (x, y, z); bit k of the position picks max on axis k."""
    return F.array(*(F.struct(*(b[i + 3 * (k >> i & 1)].alias(a) for i, a in enumerate(AXES))) for k in range(8)))


def scaled(b: Box, s: Column | float) -> list[Column]:
    """The box scaled about its centre."""
    k = s if isinstance(s, Column) else F.lit(float(s))
    mid, half = [(b[i] + b[i + 3]) / 2 for i in range(3)], [(b[i + 3] - b[i]) / 2 * k for i in range(3)]
    return [m - h for m, h in zip(mid, half)] + [m + h for m, h in zip(mid, half)]


def intersection(a: Box, b: Box) -> list[Column]:
    return [F.greatest(a[i], b[i]) for i in range(3)] + [F.least(a[i + 3], b[i + 3]) for i in range(3)]


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is at most 1e-12."""
    i = volume(intersection(a, b))
    u = volume(a) + volume(b) - i
    return F.when(u > 1e-12, i / u).otherwise(0.0)


# --- edits: actions per box are coord * S + scale for the 6 bounds, then one recenter ---


def check_scales(s: int) -> int:
    if s <= 0 or s % 2:
        raise ValueError("the number of scales must be even and positive")
    return s


def action_scales(s: int) -> list[int]:
    """The signed steps: -2^k ... -1, 1 ... 2^k."""
    check_scales(s)
    up = [2**k for k in range(s // 2)]
    return [-k for k in reversed(up)] + up


def action_count(boxes: Column | int, s: int) -> Column | int:
    return boxes * (6 * check_scales(s) + 1)


def decode(action: Column, s: int) -> dict[str, Column]:
    """bbox_idx, coord_idx (6: recenter) and scale_idx (0 for recenter) of an action id."""
    per = 6 * check_scales(s) + 1
    rest = F.pmod(action, F.lit(per))
    again = rest == per - 1
    return {"bbox_idx": F.floor(action / per).cast("int"), "coord_idx": F.when(again, 6).otherwise(F.floor(rest / s)).cast("int"), "scale_idx": F.when(again, 0).otherwise(F.pmod(rest, F.lit(s))).cast("int")}


def encode(bbox: Column, coord: Column, scale: Column, s: int) -> Column:
    per = 6 * check_scales(s) + 1
    return bbox * per + F.when(coord == 6, F.lit(per - 1)).otherwise(coord * s + scale)


def opposite(action: Column, s: int) -> Column:
    """The edit that undoes an action: the same bound, the step of the other sign; recenter is its own."""
    d = decode(action, s)
    return F.when(d["coord_idx"] == 6, action).otherwise(encode(d["bbox_idx"], d["coord_idx"], F.lit(s - 1) - d["scale_idx"], s))


def step(scale_idx: Column, s: int) -> Column:
    """The signed step of a scale index."""
    return F.array(*(F.lit(float(k)) for k in action_scales(s)))[scale_idx]


def apply_edit(b: Box, coord: Column, delta: Column) -> list[Column]:
    """The box with one bound moved; recenter (coord 6) leaves it."""
    return [b[i] + F.when(coord == i, delta).otherwise(0.0) for i in range(6)]


# --- scores ---


def score(bvs: Column, covered: Column, penalty: float, rate: float) -> Column:
    """-|bvs - 1| - (1 - covered) * rate * penalty."""
    return -F.abs(bvs - 1) - (1 - covered) * rate * penalty


def upper_reward(new_total: Column, shape_volume: Column, last: Column) -> Column:
    """The best an edit may gain: its score if all were covered, less the last score."""
    return -F.abs(new_total / shape_volume - 1) - last


def bavf(part: Column, boxv: Column, alpha: float) -> Column:
    """alpha * part / box; 0 where the box has no volume."""
    return F.when(boxv > 0, alpha * part / boxv).otherwise(0.0)


def merge_reward(bvs: Column, left: Column, right: Column, merged: Column, shape: Column) -> Column:
    """-|bvs' - 1| + |bvs - 1| where bvs' has the merged box for the two."""
    return -F.abs(bvs + (merged - left - right) / shape - 1) + F.abs(bvs - 1)


# --- roles and targets of edits ---


def role(coord: Column, delta: Column) -> Column:
    """expand, shrink or recenter."""
    grows = F.when(coord < 3, delta < 0).otherwise(delta > 0)
    return F.when(coord == 6, "recenter").when(grows, "expand").otherwise("shrink")


def axis_rank(b: Box) -> tuple[Column, Column]:
    """(major, minor) axis of a box, 0 ... 2; ties within 1e-9 go to the lower axis."""
    e = extents(b)
    big, small = F.greatest(*e), F.least(*e)
    first = lambda near: F.when(near(e[0]), 0).when(near(e[1]), 1).otherwise(2)
    return first(lambda x: x >= big - 1e-9), first(lambda x: x <= small + 1e-9)


def state_key(b: Box) -> Column:
    """Identity of a box state (equal bounds, equal key)."""
    return F.xxhash64(*b)


def named_bucket(v: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the bucket of a value: below edges[0] the first, at or above the last edge the last; null stays null."""
    out = F.lit(names[-1])
    for e, n in reversed(list(zip(edges, names))):
        out = F.when(v < e, F.lit(n)).otherwise(out)
    return F.when(v.isNotNull(), out)


def soft_inside(b: Box, p: Sequence[Column], sharp: float) -> Column:
    """Smooth membership: product of sigmoids of the distances to the six sides."""
    sig = lambda x: 1 / (1 + F.exp(-sharp * x))
    return product([sig(p[i] - b[i]) * sig(b[i + 3] - p[i]) for i in range(3)])


def td_target(reward: Column, done: Column, next_q: Column, gamma: float) -> Column:
    """reward + (1 - done) * gamma * Q'."""
    return reward + F.when(done, 0.0).otherwise(gamma * next_q)


def huber(error: Column, delta: float = 1.0) -> Column:
    """Half the square within ``delta``, linear beyond."""
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))


def blended(a: Column, b: Column, tau: float) -> Column:
    """tau * a + (1 - tau) * b of two arrays of parameters."""
    return F.zip_with(a, b, lambda x, y: tau * x + (1 - tau) * y)
