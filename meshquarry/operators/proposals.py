"""Proposed boxes against each other and against solids: matching, excess, labels, initial boxes, samples, observations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.operators import loops as L
from meshquarry.operators.spatial import union_volume
from meshquarry.session import release, salted_join, spill


def corner_cost(a: Column, b: Column) -> Column:
    """Symmetric distance of two corner sets (arrays of structs x, y, z): the mean L1 distance to the nearest corner, both ways, halved."""
    far = lambda p, q: B.total([F.abs(p[c] - q[c]) for c in B.AXES])
    one = lambda s, t: F.aggregate(F.transform(s, lambda p: F.array_min(F.transform(t, lambda q: far(p, q)))), F.lit(0.0), lambda x, y: x + y) / F.size(s)
    return (one(a, b) + one(b, a)) / 2


def least_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment of least cost (shortest augmenting paths; every row or every column is used)."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in least_assignment(cost.T))
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = owner[j]
            free = np.flatnonzero(~used[1:]) + 1
            reach = cost[row - 1, free - 1] - u[row] - v[free]
            better = reach < least[free]
            least[free[better]], way[free[better]] = reach[better], j
            nxt = free[least[free].argmin()]
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nxt
            if not owner[j]:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def optimal_assignment(costs: DataFrame, key: str, left: str, right: str, cost: str) -> DataFrame:
    """key, left, right, cost: of each set's pairs those of the assignment of least total cost.

    ``costs`` has a row per pair of a set, integers for left and right, and no null costs; missing pairs are never chosen. A
    set's matrix (some dozens of boxes a side) is solved in one row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in costs.schema.fields}
    sets = costs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r"), F.col(cost).cast("double").alias("c")))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, pairs in enumerate(b.column(1).to_pylist()):
                ls, rs = sorted({p["l"] for p in pairs}), sorted({p["r"] for p in pairs})
                m = np.full((len(ls), len(rs)), 1e15)
                for p in pairs:
                    m[ls.index(p["l"]), rs.index(p["r"])] = p["c"]
                got = [(ls[x], rs[y], float(m[x, y])) for x, y in least_assignment(m) if m[x, y] < 1e15]
                at += [i] * len(got)
                rows += got
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64())))], names=[key, left, right, cost])

    return sets.mapInArrow(run, f"`{key}` {kinds[key]}, `{left}` long, `{right}` long, `{cost}` double")


def excess(boxes: DataFrame, solid: DataFrame, key: str, idx: str) -> DataFrame:
    """key, idx, excess: the volume of each box outside its set's solid (a union of axis boxes); without a solid all of it.

    ``boxes`` has bounds; a box is met by the solid's boxes, never by other sets.
    """
    own = boxes.select(F.struct(key, idx).alias("_id"), key, *B.BOUNDS)
    cut = salted_join(solid.select(key, *(F.col(c).alias(f"s_{c}") for c in B.BOUNDS)), own, key, F.xxhash64(*(F.col(f"s_{c}") for c in B.BOUNDS)), how="inner")
    part = B.intersection(B.box(), B.box("s_"))
    inside = union_volume(cut.select("_id", *(c.alias(n) for n, c in zip(B.BOUNDS, part))), "_id").select("_id", F.col("union_volume").alias("inside"))
    r = own.join(inside, "_id", "left")
    return r.select(key, F.col(f"_id.{idx}").alias(idx), (B.volume(B.box()) - F.coalesce("inside", F.lit(0.0))).alias("excess"))


def excess_matrix(parts: DataFrame, solid: DataFrame, key: str, idx: str) -> DataFrame:
    """key, i, j, value: excess of the box around two parts over their summed volumes, less the excess of each part's own box.

    ``parts`` has bounds and ``volume``; parts without a volume are left out. On the diagonal the pair is the part alone, so
    the value is minus its own excess share.
    """
    p = parts.filter(F.col("volume") > 0).select(key, idx, *B.BOUNDS, "volume")
    alone = excess(p, solid, key, idx).join(p.select(key, idx, "volume"), [key, idx]).select(key, idx, (F.col("excess") / F.col("volume")).alias("own"))
    p = spill(p.join(alone, [key, idx]), "parts")
    side = lambda n: p.select(key, F.col(idx).alias(n), *(F.col(c).alias(f"{n}_{c}") for c in B.BOUNDS), F.col("volume").alias(f"{n}_v"), F.col("own").alias(f"{n}_own"))
    pair = side("i").join(side("j"), key)
    bounds = [F.least(F.col(f"i_{c}"), F.col(f"j_{c}")) for c in B.LOWS] + [F.greatest(F.col(f"i_{c}"), F.col(f"j_{c}")) for c in B.HIGHS]
    pair = spill(pair.select(key, F.struct("i", "j").alias("ij"), *(b.alias(c) for b, c in zip(bounds, B.BOUNDS)), "i_v", "j_v", "i_own", "j_own"), "pairs")
    both = excess(pair, solid, key, "ij").join(pair.select(key, "ij", "i_v", "j_v", "i_own", "j_own"), [key, "ij"])
    size = F.when(F.col("ij.i") == F.col("ij.j"), F.col("i_v")).otherwise(F.col("i_v") + F.col("j_v"))
    return both.select(key, "ij.i", "ij.j", (F.col("excess") / size - F.col("i_own") - F.col("j_own")).alias("value"))


def top_boxes(boxes: DataFrame, key: Column, limit: int = 32) -> DataFrame:
    """key, boxes: the ``limit`` largest boxes of each set as an array of (volume, corners), largest first (ties: the lower bounds first)."""
    v = B.volume(B.box())
    d = boxes.select(key.alias("key"), *B.BOUNDS, v.alias("_v"))
    w = W.partitionBy("key").orderBy(F.desc("_v"), *B.BOUNDS)
    flat = F.flatten(F.transform(B.corners(B.box()), lambda c: F.array(c["x"], c["y"], c["z"])))
    d = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    g = d.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_r", F.col("_v").alias("volume"), flat.alias("corners")))).alias("b"))
    return g.select("key", F.transform("b", lambda x: F.struct(x["volume"], x["corners"])).alias("boxes"))


def uniform(seed: int, *what: Column) -> Column:
    """A number in (0, 1) drawn by hash: equal for equal rows, whatever the partitions."""
    return (F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *what: Column) -> Column:
    """A standard normal number drawn by hash."""
    return F.sqrt(-2 * F.log(uniform(seed, F.lit(0), *what))) * F.cos(2 * np.pi * uniform(seed, F.lit(1), *what))


def random_boxes(sets: DataFrame, key: str, n: int, sd: float = 0.3, seed: int = 1) -> DataFrame:
    """key, bbox_idx, bounds: ``n`` boxes per set between two normal points each (initial boxes without any data)."""
    d = sets.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bbox_idx"))
    a, b = ([normal(seed, F.col(key), F.col("bbox_idx"), F.lit(c), F.lit(side)) * sd for c in B.AXES] for side in (0, 1))
    return d.select(key, "bbox_idx", *(F.least(x, y).alias(c) for x, y, c in zip(a, b, B.LOWS)), *(F.greatest(x, y).alias(c) for x, y, c in zip(a, b, B.HIGHS)))


def surface_points(boxes: DataFrame, keys: list[str], n: int, seed: int = 2) -> DataFrame:
    """keys, point_id, x, y, z: ``n`` points per box on its surface, faces drawn in proportion to their area.

    Boxes without a surface give none.
    """
    e = B.extents(B.box())
    area = [e[(i + 1) % 3] * e[(i + 2) % 3] for i in range(3)]  # of one of the two faces across axis i
    d = boxes.filter(B.total(area) > 0).select(*keys, *B.BOUNDS, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point_id"))
    u = lambda k: uniform(seed, *(F.col(c) for c in keys), F.col("point_id"), F.lit(k))
    at = u("face") * B.total(area)
    axis = F.when(at < area[0], 0).when(at < area[0] + area[1], 1).otherwise(2)
    spot = [F.when(axis == i, F.when(u("side") < 0.5, F.col(B.LOWS[i])).otherwise(F.col(B.HIGHS[i]))).otherwise(F.col(B.LOWS[i]) + u(a) * e[i]) for i, a in enumerate(B.AXES)]
    return d.select(*keys, "point_id", *(s.alias(a) for s, a in zip(spot, B.AXES)))


def padded(rows: Column, width: int, most: int) -> Column:
    """An array of arrays of ``width`` numbers as ``most`` rows in one flat array, cut or filled with zeros."""
    flat = F.flatten(F.slice(rows, 1, most))
    return F.concat(flat, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), most * width - F.size(flat)).cast("int")))


def one_hot(at: Column, n: int) -> Column:
    """``n`` numbers, 1 at a position; all 0 outside."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))


#: Pieces of less than this share of their mesh's volume are dropped; a box counts as unchanged within this volume.
LEAST_PIECE, SAME_BOX = 0.002, 1e-7


def presegment(tets: DataFrame, adjacency: DataFrame, mesh: str) -> DataFrame:
    """mesh, tet_id, piece (the least tet_id of the piece): the first segmentation of tetrahedra.

    ``tets`` has tet_id, label (the parts that hold it, as text; empty or null: none), volume and its bounds; ``adjacency``
    src, dst both ways. Neighbours of one label are a piece; pieces of less than :data:`LEAST_PIECE` of the mesh fall apart. What
    belongs to no piece joins a neighbouring piece whose box it leaves unchanged (the least piece first), again and again;
    what is left forms pieces of neighbours.
    """
    t = spill(tets.select(mesh, "tet_id", F.coalesce("label", F.lit("")).alias("label"), "volume", *B.BOUNDS), "tets")
    name = lambda c: t.select(mesh, F.col("tet_id").alias(c), F.col("label").alias(f"{c}_label"))
    e = adjacency.select(mesh, "src", "dst").join(name("src"), [mesh, "src"]).join(name("dst"), [mesh, "dst"])
    e = spill(e, "edges")
    same = e.filter((F.col("src_label") == F.col("dst_label")) & (F.col("src_label") != "")).select(mesh, "src", "dst")
    c = L.components(same, mesh).select(mesh, F.col("v").alias("tet_id"), F.col("component").alias("piece"))
    p = t.join(c, [mesh, "tet_id"], "left").withColumn("piece", F.coalesce("piece", F.when(F.col("label") != "", F.col("tet_id"))))
    all_ = t.groupBy(mesh).agg(F.sum("volume").alias("_all"))
    keep = p.filter(F.col("piece").isNotNull()).groupBy(mesh, "piece").agg(F.sum("volume").alias("_v")).join(all_, mesh).filter(F.col("_v") >= LEAST_PIECE * F.col("_all")).select(mesh, "piece")
    now = spill(p.join(keep.withColumn("_k", F.lit(True)), [mesh, "piece"], "left").select(mesh, "tet_id", F.when(F.col("_k"), F.col("piece")).alias("piece"), *B.BOUNDS), "pieces")
    while True:
        box = now.filter(F.col("piece").isNotNull()).groupBy(mesh, "piece").agg(*(F.min(c).alias(f"p_{c}") for c in B.LOWS), *(F.max(c).alias(f"p_{c}") for c in B.HIGHS))
        near = e.select(mesh, F.col("src").alias("tet_id"), "dst").join(now.select(mesh, F.col("tet_id").alias("dst"), F.col("piece").alias("to")).filter(F.col("to").isNotNull()), [mesh, "dst"])
        near = now.filter(F.col("piece").isNull()).drop("piece").join(near.select(mesh, "tet_id", "to").distinct(), [mesh, "tet_id"]).join(box.withColumnRenamed("piece", "to"), [mesh, "to"])
        grown = [F.least(F.col(c), F.col(f"p_{c}")) for c in B.LOWS] + [F.greatest(F.col(c), F.col(f"p_{c}")) for c in B.HIGHS]
        fit = near.filter(F.abs(B.volume(grown) - B.volume(B.box("p_"))) <= SAME_BOX).groupBy(mesh, "tet_id").agg(F.min("to").alias("to"))
        fit = spill(fit, "fit")
        if fit.isEmpty():
            break
        after = spill(now.join(fit, [mesh, "tet_id"], "left").withColumn("piece", F.coalesce("piece", "to")).drop("to"), "pieces")
        release(now, fit)
        now = after
    rest = spill(now.filter(F.col("piece").isNull()).select(mesh, "tet_id"), "rest")
    left = e.select(mesh, "src", "dst").join(rest.withColumnRenamed("tet_id", "src"), [mesh, "src"]).join(rest.withColumnRenamed("tet_id", "dst"), [mesh, "dst"])
    c = L.components(left.select(mesh, "src", "dst"), mesh).select(mesh, F.col("v").alias("tet_id"), F.col("component").alias("own"))
    out = now.join(c, [mesh, "tet_id"], "left").select(mesh, "tet_id", F.coalesce("piece", "own", "tet_id").alias("piece"))
    least = out.groupBy(mesh, "piece").agg(F.min("tet_id").alias("least"))
    return out.join(least, [mesh, "piece"]).select(mesh, "tet_id", F.col("least").alias("piece"))


def part_adjacency(members: DataFrame, faces: DataFrame, mesh: str) -> DataFrame:
    """mesh, l, r (l < r): parts of a mesh that share a face. ``members`` has part_id and tet_id, ``faces`` tet_id and key."""
    f = faces.select(mesh, "tet_id", "key").join(members.select(mesh, "tet_id", "part_id"), [mesh, "tet_id"])
    parts = f.groupBy(mesh, "key").agg(F.array_sort(F.collect_set("part_id")).alias("p")).filter(F.size("p") > 1)  # parts, not tetrahedra
    pair = parts.select(mesh, F.posexplode("p").alias("k", "l"), "p").select(mesh, "l", F.explode(F.slice("p", F.col("k") + 2, F.size("p"))).alias("r"))
    return pair.distinct()
