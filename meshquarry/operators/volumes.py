"""Exact volumes between boxes and solids: overlap metrics of box sets, tetrahedra clipped to boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.operators.spatial import union_cells, union_volume

#: Boxes per set up to which the union is taken by inclusion and exclusion; larger sets are cut into cells.
MAX_BOXES = 8


def overlap_metrics(shape: DataFrame, boxes: DataFrame, key: str, tiny: float = 1e-10) -> DataFrame:
    """key, bvs, covered, tov, viou, mov of a box set against a shape that is itself a union of axis boxes.

    bvs: summed box volume over shape; covered: shared over shape; tov: outside over shape; viou: shared over union; mov: the
    largest share of a box outside over inside (0 where nothing is inside). Sets without a shape are left out.
    """
    cols = [key, *B.BOUNDS]
    u = lambda d, n: union_volume(d.select(*cols), key).select(key, F.col("union_volume").alias(n))
    both = u(shape, "s").join(u(boxes, "b"), key).join(u(shape.select(*cols).union(boxes.select(*cols)), "u"), key)
    total = boxes.filter(B.is_valid(B.box())).groupBy(key).agg(F.sum(B.volume(B.box())).alias("total"))
    shared = F.col("s") + F.col("b") - F.col("u")
    one = boxes.filter(B.is_valid(B.box())).select(key, F.struct(*B.BOUNDS).alias("x"), B.volume(B.box()).alias("v"))
    each = one.withColumn("set", F.xxhash64(key, "x"))
    own = each.select(key, "set", "x.*", "v").distinct()
    alone = own.select(key, "set", *B.BOUNDS)
    cut = shape.select(key, *(F.col(c).alias(f"s_{c}") for c in B.BOUNDS)).join(alone, key)
    part = B.intersection(B.box(), B.box("s_"))
    inside = union_volume(cut.select("set", *(c.alias(n) for n, c in zip(B.BOUNDS, part))), "set").select("set", F.col("union_volume").alias("i"))
    m = own.select(key, "set", "v").join(inside, "set", "left").groupBy(key).agg(F.max(F.when(F.col("i") > tiny, (F.col("v") - F.col("i")) / F.col("i")).otherwise(0.0)).alias("mov"))
    return both.join(total, key).join(m, key).filter(F.col("s") > tiny).select(key, (F.col("total") / F.col("s")).alias("bvs"), (shared / F.col("s")).alias("covered"), ((F.col("b") - shared) / F.col("s")).alias("tov"), (shared / F.col("u")).alias("viou"), "mov")


def _cut(tets: np.ndarray, owner: np.ndarray, axis: int, at: np.ndarray, keep_above: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tetrahedra (n, 4, 3) cut by a plane each; the part on one side as tetrahedra again."""
    d = (tets[:, :, axis] - at[owner][:, None]) * (1 if keep_above else -1)
    order = np.argsort(-d, axis=1, kind="stable")
    t, d = np.take_along_axis(tets, order[:, :, None], 1), np.take_along_axis(d, order, 1)
    n = (d > 0).sum(1)
    parts, owners = [t[n == 4]], [owner[n == 4]]
    for k, pick in ((1, None), (2, None), (3, None)):
        s, e, o = t[n == k], d[n == k], owner[n == k]
        if not len(s):
            continue
        x = lambda i, j: s[:, i] + (s[:, j] - s[:, i]) * (e[:, i] / (e[:, i] - e[:, j]))[:, None]  # noqa: B023,E731
        if k == 1:
            new = [(s[:, 0], x(0, 1), x(0, 2), x(0, 3))]
        elif k == 2:
            a, b, c, f = x(0, 2), x(0, 3), x(1, 2), x(1, 3)
            new = [(s[:, 0], a, b, f), (s[:, 0], a, c, f), (s[:, 0], s[:, 1], c, f)]
        else:
            a, b, c = x(0, 3), x(1, 3), x(2, 3)
            new = [(s[:, 0], s[:, 1], s[:, 2], c), (s[:, 0], s[:, 1], b, c), (s[:, 0], a, b, c)]
        parts += [np.stack(q, 1) for q in new]
        owners += [o] * len(new)
    return np.concatenate(parts), np.concatenate(owners)


def clipped_volumes(tets: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Volume of each tetrahedron (n, 4, 3) within its box (n, 6)."""
    t, owner = tets, np.arange(len(tets))
    for axis in range(3):
        t, owner = _cut(t, owner, axis, boxes[:, axis], True)
        t, owner = _cut(t, owner, axis, boxes[:, axis + 3], False)
    vol = np.abs(np.einsum("ij,ij->i", t[:, 1] - t[:, 0], np.cross(t[:, 2] - t[:, 0], t[:, 3] - t[:, 0]))) / 6
    return np.bincount(owner, weights=vol, minlength=len(tets))


CORNERS = [f"{n}{a}" for n in "abcd" for a in B.AXES]


def clip(pairs: DataFrame) -> DataFrame:
    """``pairs`` (corners ax ... dz and box bounds, other columns kept) with ``inside``, the tetrahedron's volume in the box.

    Invalid boxes and null numbers hold nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            num = np.array([b.column(c).to_numpy(zero_copy_only=False) for c in (*CORNERS, *B.BOUNDS)], dtype=np.float64).T
            ok = np.isfinite(num).all(1) & (num[:, 12:15] < num[:, 15:18]).all(1) if len(num) else np.zeros(0, bool)
            out = np.zeros(len(num))
            if ok.any():
                out[ok] = clipped_volumes(num[ok, :12].reshape(-1, 4, 3), num[ok, 12:])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "inside"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("inside", DoubleType())]))


def tet_box_metrics(tets: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """key, volume, bvs, covered, tov, viou of a tetrahedral solid against the axis boxes of its set.

    The union of up to :data:`MAX_BOXES` boxes is taken by inclusion and exclusion: every intersection of boxes is a box, to
    which the tetrahedra are clipped. That of more boxes is cut into cells that don't overlap. Both are exact.
    """
    v = boxes.filter(B.is_valid(B.box())).select(key, *B.BOUNDS)
    sets = v.groupBy(key).agg(F.collect_list(F.struct(*B.BOUNDS)).alias("_b"))
    few, many = sets.filter(F.size("_b") <= MAX_BOXES), sets.filter(F.size("_b") > MAX_BOXES)
    subset = few.select(key, "_b", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size("_b")) - 1).cast("int"))).alias("_m"))
    chosen = F.filter("_b", lambda x, i: F.getbit(F.col("_m").cast("long"), i) == 1)
    subset = subset.withColumn("_c", chosen).withColumn("_sign", F.when(F.size("_c") % 2 == 1, 1.0).otherwise(-1.0))
    meet = subset.select(key, "_sign", *(F.array_max(F.col(f"_c.{c}")).alias(c) for c in B.LOWS), *(F.array_min(F.col(f"_c.{c}")).alias(c) for c in B.HIGHS)).filter(B.is_valid(B.box()))
    large = many.select(key, F.explode("_b").alias("x")).select(key, "x.*")
    meet = meet.unionByName(union_cells(large, key).select(key, F.lit(1.0).alias("_sign"), *B.BOUNDS))
    from meshquarry.functions import vectors as V

    corner = [[F.col(f"{n}{a}") for a in B.AXES] for n in "abcd"]
    solid = tets.groupBy(key).agg(F.sum(V.tet_volume(*corner)).alias("volume"))
    shared = clip(tets.select(key, *CORNERS).join(meet, key)).groupBy(key).agg(F.sum(F.col("_sign") * F.col("inside")).alias("shared"))
    held = meet.groupBy(key).agg(F.sum(F.col("_sign") * B.volume(B.box())).alias("union"))
    total = v.groupBy(key).agg(F.sum(B.volume(B.box())).alias("total"))
    j = solid.join(total, key).join(held, key).join(shared, key, "left").na.fill({"shared": 0.0}).filter(F.col("volume") > 0)
    return j.select(key, "volume", (F.col("total") / F.col("volume")).alias("bvs"), (F.col("shared") / F.col("volume")).alias("covered"), ((F.col("union") - F.col("shared")) / F.col("volume")).alias("tov"), (F.col("shared") / (F.col("volume") + F.col("union") - F.col("shared"))).alias("viou"))
