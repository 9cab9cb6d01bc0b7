"""Spatial operators: box fitting, coverage, range joins on a grid, neighbours, adjacency, volumes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.functions import vectors as V
from meshquarry.session import BROADCAST_BYTES, salted_join


def fit_boxes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The axis box of each group's finite points (x, y, z), with n and the summed weight.

    Null, NaN and infinite coordinates are left out. Combines before the shuffle.
    """
    ok = points
    for a in B.AXES:
        ok = ok.filter(F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    return ok.groupBy(*keys).agg(*(F.min(a).alias(f"min_{a}") for a in B.AXES), *(F.max(a).alias(f"max_{a}") for a in B.AXES), F.count("*").alias("n"), F.sum("weight").alias("weight"))


def covered(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """``points`` with ``n_boxes``, in how many boxes of their own set they lie (0 without boxes).

    The boxes of a set (a state's boxes, a few dozen) travel as one array per set, so points are neither multiplied nor
    regrouped.
    """
    sets = boxes.groupBy(key).agg(F.collect_list(F.struct(*B.BOUNDS)).alias("_boxes"))
    p = [F.col(a) for a in B.AXES]
    j = salted_join(points, sets, key, F.xxhash64(*B.AXES))
    inside = F.filter("_boxes", lambda s: B.contains([s[c] for c in B.BOUNDS], p))
    return j.withColumn("n_boxes", F.when(F.col("_boxes").isNull(), 0).otherwise(F.size(inside))).drop("_boxes")


def _gridded(boxes: DataFrame, cell: Sequence[float], most_cells: int) -> tuple[DataFrame, Row]:
    """``boxes`` once per cell that they touch (_level, _cx, _cy, _cz); the levels, the number of cells and the bounds of all boxes.

    A box that touches more than ``most_cells`` cells has cells that are coarser by powers of 8 per axis (one level
    per box), so none is repeated without bound.
    """
    levels = 8
    cells_at = lambda lv: B.product([(F.floor((F.col(f"max_{a}")) / (w * 8**lv)) - F.floor(F.col(f"min_{a}") / (w * 8**lv)) + 1).cast("double") for a, w in zip(B.AXES, cell)])
    level, cells = F.lit(levels - 1), cells_at(levels - 1)
    for lv in reversed(range(levels - 1)):
        fits = cells_at(lv) <= most_cells
        level, cells = F.when(fits, lv).otherwise(level), F.when(fits, cells_at(lv)).otherwise(cells)
    b = boxes.withColumn("_level", level)
    found = b.agg(F.collect_set("_level").alias("levels"), F.sum(cells).alias("cells"), *(F.min(c).alias(c) for c in B.LOWS), *(F.max(c).alias(c) for c in B.HIGHS)).first()  # one row, at most `levels` numbers in it
    for a, w in zip(B.AXES, cell):
        size = F.lit(float(w)) * F.pow(F.lit(8.0), F.col("_level"))
        b = b.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(F.col(f"min_{a}") / size), F.floor(F.col(f"max_{a}") / size))))
    return b, found


def _in_cells(points: DataFrame, cell: Sequence[float], levels: Sequence[int]) -> DataFrame:
    """``points`` with their cell at each of the levels."""
    q = points.withColumn("_level", F.explode(F.array(*(F.lit(lv) for lv in levels)) if levels else F.array().cast("array<int>")))
    for a, w in zip(B.AXES, cell):
        q = q.withColumn(f"_c{a}", F.floor(F.col(a) / (F.lit(float(w)) * F.pow(F.lit(8.0), F.col("_level")))))
    return q


CELL = ["_level", *(f"_c{a}" for a in B.AXES)]


def grid_join(points: DataFrame, boxes: DataFrame, cell: Sequence[float], most_cells: int = 4096) -> DataFrame:
    """Every (point, box) with the point in the box, by an equi-join on grid cells and the exact test.

    Spark's estimate of the boxes doesn't know that they are repeated per cell, so their counted cells decide whether they
    are broadcast. Shared column names must be resolved beforehand. For sums per box see :func:`grid_sums`.
    """
    b, found = _gridded(boxes, cell, most_cells)
    b = F.broadcast(b) if (found["cells"] or 0) * 100 <= BROADCAST_BYTES else b.hint("merge")
    return _in_cells(points, cell, found["levels"]).join(b, CELL).filter(B.contains(B.box(), [F.col(a) for a in B.AXES])).drop(*CELL)


#: Points that one search tree holds at most, (box, node) pairs tested at once, and points and boxes of a cell in one task.
TREE_POINTS, TREE_PAIRS, CELL_POINTS, CELL_BOXES = 1 << 18, 1 << 19, 1 << 20, 1 << 18


def _ordered(v: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, as Spark has it: -0 equals 0, NaN equals NaN and is above all."""
    v = v + 0.0
    v[np.isnan(v)] = np.nan
    i = v.view(np.int64)
    return np.where(i < 0, i ^ np.int64(0x7FFFFFFFFFFFFFFF), i)


def _tree_sums(p: np.ndarray, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each box (rows of ``lo``, ``hi``) the sums of ``values`` over the points ``p`` in it, ends included.

    A k-d tree, halved by position, whose nodes hold tight bounds and sums: nodes within a box count whole, nodes apart
    from it not at all, and only leaves that its surface cuts are tested point by point.
    """
    n, depth = len(p), max(0, (len(p) - 1).bit_length() - 3)
    order, tree = np.arange(n), []
    with np.errstate(invalid="ignore"):  # inf - inf is NaN, as in a plain sum
        for d in range(depth + 1):
            starts = (n * np.arange(1 << d)) >> d
            q = p[order]
            a, b = np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)
            tree.append((a, b, np.add.reduceat(values[order], starts)))
            if d < depth:  # the next axis on which the node's points differ
                turn = (d + np.arange(3)) % 3
                axis = turn[(a != b)[:, turn].argmax(1)]
                node = np.repeat(np.arange(1 << d), np.diff(starts, append=n))
                order = order[np.lexsort((q[np.arange(n), axis[node]], node))]
        q, leaf_values, ends = p[order], values[order], np.append(starts, n)
        out = np.zeros((len(lo), values.shape[1]))

        def add(box: np.ndarray, what: np.ndarray) -> None:
            first, at = np.unique(box, return_inverse=True)
            for k in range(out.shape[1]):
                out[first, k] += np.bincount(at, weights=what[:, k], minlength=len(first))

        todo = [(0, np.arange(i, min(i + TREE_PAIRS, len(lo))), None) for i in range(0, len(lo), TREE_PAIRS)]
        while todo:
            d, box, node = todo.pop()
            node = np.zeros(len(box), dtype=np.int64) if node is None else node
            if d > depth:  # single points
                held = ((q[node] >= lo[box]) & (q[node] <= hi[box])).all(1)
                add(box[held], leaf_values[node[held]])
                continue
            a, b, sums = tree[d]
            meets = ((b[node] >= lo[box]) & (a[node] <= hi[box])).all(1)
            box, node = box[meets], node[meets]
            held = ((a[node] >= lo[box]) & (b[node] <= hi[box])).all(1)
            add(box[held], sums[node[held]])
            box, node = box[~held], node[~held]
            if d < depth:
                box, node = np.repeat(box, 2), np.repeat(2 * node, 2) + np.tile(np.array([0, 1]), len(node))
            else:
                size = ends[node + 1] - ends[node]
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                box, node = np.repeat(box, size), np.repeat(ends[node], size) + at
            todo += [(d + 1, box[i : i + TREE_PAIRS], node[i : i + TREE_PAIRS]) for i in range(0, len(box), TREE_PAIRS)]
    return out


def _cell_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, its boxes before its points: each box that holds points of the cell, with their sums."""
    now, boxes, points, waiting, out = None, [], [], 0, None

    def search() -> None:
        nonlocal out, waiting
        if boxes and points:
            b, p = np.concatenate(boxes), np.concatenate(points)
            out = np.zeros((len(b), 3)) if out is None else out
            out += _tree_sums(_ordered(p[:, :3]), np.ascontiguousarray(p[:, 3:]), _ordered(b[:, :3]), _ordered(b[:, 3:]))
        points.clear()
        waiting = 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal out
        search()
        if out is not None and (hit := out[:, 0] > 0).any():
            b = np.concatenate(boxes)[hit]
            yield pa.RecordBatch.from_arrays([*(pa.array(b[:, k]) for k in range(6)), *(pa.array(out[hit, k].astype(np.int64)) for k in range(2)), pa.array(out[hit, 2])], names=[*B.BOUNDS, "_n", "_given", "_sum"])
        boxes.clear()
        out = None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(CELL) + 3)], 1)
        rows = np.stack([batch.column(len(CELL) + 3 + k).to_numpy(zero_copy_only=False) for k in range(6)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if now != (now := tuple(keys[i, :-1])):
                yield from done()
            if keys[i, -1] == 0:
                boxes.append(rows[i:j])
            elif boxes:
                points.append(rows[i:j])
                waiting += j - i
                if waiting >= TREE_POINTS:
                    search()
    yield from done()


def grid_sums(points: DataFrame, boxes: DataFrame, cell: Sequence[float], value: str, most_cells: int = 4096) -> DataFrame:
    """``boxes`` that hold points, with n_points, how many, and ``value``, their sum in doubles: what grouping :func:`grid_join` gives, without its pairs.

    Equal points, and equal boxes, are taken together; those of a cell meet in a search tree, whose nodes within a box count
    whole. A cell of more than ``CELL_POINTS`` points or ``CELL_BOXES`` boxes is cut into pieces that each meet all pieces
    of the other side. ``boxes`` must not have a column named like ``value``.
    """
    spark = boxes.sparkSession
    b, found = _gridded(boxes.select(*B.BOUNDS).distinct(), cell, most_cells)
    near = points.select(*B.AXES, value).filter(B.contains([F.lit(found[c]).cast("double") for c in B.BOUNDS], [F.col(a) for a in B.AXES]))
    q = _in_cells(near, cell, found["levels"])

    def pieces(df: DataFrame, most: int) -> list[Row]:  # a row per `most` rows of the table at most
        return df.groupBy(*CELL).agg(F.ceil(F.count("*") / most).cast("int").alias("_n")).filter(F.col("_n") > 1).collect()

    p_hot, b_hot = pieces(q, CELL_POINTS), pieces(b, CELL_BOXES)

    def cut(df: DataFrame, own: str, other: str, by: Sequence[str]) -> DataFrame:
        for name, hot in (("_pp", p_hot), ("_bp", b_hot)):
            n = spark.createDataFrame(hot, "_level int, " + ", ".join(f"{c} long" for c in CELL[1:]) + f", {name} int")
            df = df.join(F.broadcast(n), CELL, "left").na.fill(1, [name]) if hot else df.withColumn(name, F.lit(1))
        return df.withColumn(own, F.pmod(F.xxhash64(*by), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    q = cut(q.groupBy(*CELL, *B.AXES).agg(F.count("*").cast("double").alias("_n"), F.count(value).cast("double").alias("_given"), F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("_sum")), "_pp", "_bp", B.AXES)
    sides = [cut(b, "_bp", "_pp", B.BOUNDS).select(*CELL, "_pp", "_bp", F.lit(0).alias("_side"), *(F.col(c).alias(f"_v{k}") for k, c in enumerate(B.BOUNDS)))]
    sides.append(q.select(*CELL, "_pp", "_bp", F.lit(1).alias("_side"), *(F.col(c).alias(f"_v{k}") for k, c in enumerate((*B.AXES, "_n", "_given", "_sum")))))
    met = sides[0].union(sides[1]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *CELL, "_pp", "_bp").sortWithinPartitions(*CELL, "_pp", "_bp", "_side")
    sums = met.mapInArrow(_cell_sums, ", ".join(f"{c} double" for c in B.BOUNDS) + ", _n long, _given long, _sum double").groupBy(*B.BOUNDS).agg(F.sum("_n").alias("n_points"), F.when(F.sum("_given") > 0, F.sum("_sum")).alias(value))
    return boxes.join(sums.hint("merge"), [*B.BOUNDS])


def union_cells(boxes: DataFrame, key: str) -> DataFrame:
    """key, boxes and bounds of the cells that make up the union of each set's axis boxes, none overlapping another.

    The cells between neighbouring coordinates that some box holds. Cells grow with the third power of the
    boxes in a set; meant for sets of up to a few dozen. Boxes that aren't valid hold nothing.
    """
    v = boxes.filter(B.is_valid(B.box()))
    s = v.groupBy(key).agg(F.collect_list(F.struct(*B.BOUNDS)).alias("_b"))
    for a in B.AXES:  # a field of an array of structs is the array of the field
        s = s.withColumn(f"_cut_{a}", F.array_sort(F.array_distinct(F.concat(F.col(f"_b.min_{a}"), F.col(f"_b.max_{a}")))))
    def intervals(a: str) -> Column:
        return F.zip_with(F.slice(F.col(f"_cut_{a}"), F.lit(1), F.size(f"_cut_{a}") - 1), F.slice(F.col(f"_cut_{a}"), F.lit(2), F.size(f"_cut_{a}") - 1), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    for a in B.AXES:
        s = s.withColumn(f"_i{a}", F.explode(intervals(a)))
    held = F.exists("_b", lambda x: B.product([((x[f"min_{a}"] <= F.col(f"_i{a}.lo")) & (x[f"max_{a}"] >= F.col(f"_i{a}.hi"))).cast("int") for a in B.AXES]) == 1)
    return s.filter(held).select(key, F.size("_b").alias("boxes"), *(F.col(f"_i{a}.lo").alias(f"min_{a}") for a in B.AXES), *(F.col(f"_i{a}.hi").alias(f"max_{a}") for a in B.AXES))


def union_volume(boxes: DataFrame, key: str) -> DataFrame:
    """Exact volume of the union of each set's axis boxes by coordinate compression: set, boxes, union_volume (see :func:`union_cells`)."""
    return union_cells(boxes, key).groupBy(key).agg(F.max("boxes").alias("boxes"), F.sum(B.volume(B.box())).alias("union_volume"))


def pair_overlaps(boxes: DataFrame, key: str, idx: str) -> DataFrame:
    """IoU of each two boxes (idx_a < idx_b) of one set."""
    a = boxes.select(key, F.col(idx).alias("idx_a"), *(F.col(c).alias(f"a_{c}") for c in B.BOUNDS))
    b = boxes.select(key, F.col(idx).alias("idx_b"), *(F.col(c).alias(f"b_{c}") for c in B.BOUNDS))
    j = a.join(b, key).filter(F.col("idx_a") < F.col("idx_b"))
    return j.select(key, "idx_a", "idx_b", B.iou(B.box("a_"), B.box("b_")).alias("iou"), B.volume(B.intersection(B.box("a_"), B.box("b_"))).alias("shared_volume"))


def edit_grid(boxes: DataFrame, s: int, unit: float) -> DataFrame:
    """Each box with each of its 6 * s bound edits and the recenter: coord_idx, scale_idx, action, delta and the edited bounds e_*.

    ``boxes`` has bbox_idx, the position of a box in its set.
    """
    per = 6 * B.check_scales(s) + 1
    g = boxes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    d = B.decode(F.col("_k"), s)
    g = g.select(*boxes.columns, d["coord_idx"].alias("coord_idx"), d["scale_idx"].alias("scale_idx"), (F.col("bbox_idx") * per + F.col("_k")).alias("action"), F.when(d["coord_idx"] == 6, 0.0).otherwise(B.step(d["scale_idx"], s) * unit).alias("delta"))
    return g.select(*g.columns, *(c.alias(f"e_{n}") for n, c in zip(B.BOUNDS, B.apply_edit(B.box(), F.col("coord_idx"), F.col("delta")))))


def proxy_rewards(points: DataFrame, boxes: DataFrame, key: str, s: int, unit: float, shape_volume: Column, last: Column, penalty: float, rate: float) -> DataFrame:
    """Reward of every bound edit when coverage is the weighted share of points in some box after the edit.

    ``points`` has the key, x, y, z, weight; ``boxes`` key, bbox_idx and bounds; ``shape_volume`` and ``last`` are columns of
    ``boxes``. An edit that makes its box invalid has reward -inf. Each (point, box) row is read once; points in another
    box of the set count for every edit of this one.
    """
    idx = boxes.withColumn("_v", B.volume(B.box())).withColumn("_all", F.sum("_v").over(W.partitionBy(key)))
    idx = idx.withColumn("_shape", shape_volume).withColumn("_last", last).select(key, "bbox_idx", *B.BOUNDS, "_v", "_all", "_shape", "_last")
    e = edit_grid(idx, s, unit).filter(F.col("coord_idx") < 6)
    p = [F.col(a) for a in B.AXES]
    side = [p[i] >= F.col(c) for i, c in enumerate(B.LOWS)] + [p[i] <= F.col(c) for i, c in enumerate(B.HIGHS)]
    sets = boxes.groupBy(key).agg(F.collect_list(F.struct("bbox_idx", *B.BOUNDS)).alias("_boxes"))
    j = salted_join(points.select(key, *B.AXES, "weight"), sets, key, F.xxhash64(*B.AXES), how="inner")
    j = j.withColumn("n_boxes", F.size(F.filter("_boxes", lambda x: B.contains([x[c] for c in B.BOUNDS], p))))
    j = j.select(key, *B.AXES, "weight", "n_boxes", F.explode("_boxes").alias("_x")).select(key, *B.AXES, "weight", "n_boxes", "_x.*")
    j = j.withColumn("_other", F.col("n_boxes") > B.contains(B.box(), p).cast("int"))
    # one sum per edit, all in one pass over the (point, box) rows
    sums = []
    for c, bound in enumerate(B.BOUNDS):
        rest = reduce(lambda x, y: x & y, side[:c] + side[c + 1 :])
        for k, d in enumerate(B.action_scales(s)):
            moved = F.col(bound) + d * unit
            hit = F.col("_other") | (rest & (p[c % 3] >= moved if c < 3 else p[c % 3] <= moved))
            sums.append(F.sum(F.when(hit, F.col("weight")).otherwise(0.0)).alias(f"_s{c * s + k}"))
    got = j.groupBy(key, "bbox_idx").agg(F.sum("weight").alias("_w"), *sums)
    cov = got.select(key, "bbox_idx", F.posexplode(F.array(*(F.col(f"_s{i}") / F.col("_w") for i in range(6 * s)))).alias("_k", "covered"))
    cov = cov.select(key, (F.col("bbox_idx") * (6 * s + 1) + F.col("_k")).alias("action"), "covered")
    edited = [F.col(f"e_{c}") for c in B.BOUNDS]
    r = e.join(cov, [key, "action"], "left").na.fill({"covered": 0.0})
    bvs = (F.col("_all") - F.col("_v") + B.volume(edited)) / F.col("_shape")
    reward = F.when(B.is_valid(edited), B.score(bvs, F.col("covered"), penalty, rate) - F.col("_last")).otherwise(F.lit(float("-inf")))
    return r.select(key, "bbox_idx", "coord_idx", "scale_idx", "action", bvs.alias("bvs"), "covered", reward.alias("reward"))


# --- meshes ---


def tet_faces(tets: DataFrame, mesh: str) -> DataFrame:
    """The four faces of each tetrahedron: mesh, tet_id, pos, face as given, key as sorted array."""
    v = [F.col(f"v{i}") for i in range(4)]
    f = F.array(*(F.struct(F.lit(p).alias("pos"), F.array(*(v[i] for i in t)).alias("face")) for p, t in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)))))
    return tets.select(mesh, "tet_id", F.explode(f).alias("f")).select(mesh, "tet_id", "f.*").withColumn("key", F.array_sort("face"))


def tet_adjacency(tets: DataFrame, mesh: str) -> DataFrame:
    """src, dst (both ways) of tetrahedra of one mesh that share a face."""
    f = tet_faces(tets, mesh).select(mesh, "key", "tet_id")
    owners = f.groupBy(mesh, "key").agg(F.array_sort(F.collect_set("tet_id")).alias("o")).filter(F.size("o") > 1)  # two owners in a valid mesh
    pair = owners.select(mesh, F.explode("o").alias("src"), "o").select(mesh, "src", F.explode("o").alias("dst"))
    return pair.filter(F.col("src") != F.col("dst")).distinct()


def face_ties(tets: DataFrame, mesh: str) -> DataFrame:
    """mesh, src (tet_id), dst (a negative number per face): tetrahedra tied to their shared faces.

    A row per owner of a face, however many own it; the pieces of this graph are those of :func:`tet_adjacency`.
    """
    f = tet_faces(tets, mesh).select(mesh, "key", "tet_id")
    shared = f.groupBy(mesh, "key").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(F.struct(mesh, "key").alias("_f"))
    f = salted_join(f.withColumn("_f", F.struct(mesh, "key")), shared, "_f", F.col("tet_id"), how="inner")
    return f.select(mesh, F.col("tet_id").alias("src"), (-F.pmod(F.xxhash64("key"), F.lit((1 << 62) - 1)) - 1).alias("dst"))


def surface_faces(tets: DataFrame, mesh: str) -> DataFrame:
    """Faces that belong to one tetrahedron only, in the orientation given there."""
    f = tet_faces(tets, mesh)
    return f.groupBy(mesh, "key").agg(F.count("*").alias("n"), F.min_by("face", F.struct("tet_id", "pos")).alias("face"), F.min("tet_id").alias("tet_id")).filter(F.col("n") == 1).select(mesh, "tet_id", "face")


def gather_corners(faces: DataFrame, vertices: DataFrame, mesh: str) -> DataFrame:
    """``faces`` (mesh, face_id, v0, v1, v2) with the coordinates ax ... cz of their corners; faces with a missing corner are left out."""
    c = faces.select(mesh, "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("_p", "vertex_id")).join(vertices.select(mesh, "vertex_id", *B.AXES), [mesh, "vertex_id"])
    named = {f"{n}{a}": F.max(F.when(F.col("_p") == i, F.col(a))).alias(f"{n}{a}") for i, n in enumerate("abc") for a in B.AXES}
    return c.groupBy(mesh, "face_id").agg(*named.values()).filter(F.col("ax").isNotNull() & F.col("bx").isNotNull() & F.col("cx").isNotNull())


def corner(n: str) -> list[Column]:
    return [F.col(n + a) for a in B.AXES]


def mesh_volumes(triangles: DataFrame, mesh: str) -> DataFrame:
    """|sum of signed tetrahedra| and surface area of each mesh from triangles with corners."""
    a, b, c = corner("a"), corner("b"), corner("c")
    return triangles.groupBy(mesh).agg(F.abs(F.sum(V.signed_volume(a, b, c))).alias("volume"), F.sum(V.norm(V.cross(V.sub(b, a), V.sub(c, a))) / 2).alias("area"), F.count("*").alias("faces"))


def nearest_distance(points: DataFrame, targets: DataFrame, key: str, block: int = 512) -> DataFrame:
    """key, d2: for each point the squared distance to the nearest target of its set; points of sets without targets are left out.

    The targets of a set are cut into blocks of about ``block`` by hash, and a point meets blocks, not targets: no pairs
    are emitted, no array grows with its set, and points of a hot set are spread.
    """
    n = targets.groupBy(key).agg(F.count("*").alias("_n"))
    t = salted_join(targets.select(key, *B.AXES), n, key, F.xxhash64(*B.AXES), how="inner")
    t = t.withColumn("_blk", F.pmod(F.xxhash64(*B.AXES), F.ceil(F.col("_n") / block))).groupBy(key, "_blk").agg(F.collect_set(F.struct(*B.AXES)).alias("_t"))
    p = points.select(key, *B.AXES).groupBy(key, *B.AXES).agg(F.count("*").alias("_same"))
    d2 = F.array_min(F.transform("_t", lambda y: V.distance2([F.col(a) for a in B.AXES], [y[a] for a in B.AXES])))
    near = salted_join(p, t.drop("_blk"), key, F.xxhash64(*B.AXES), how="inner").groupBy(key, *B.AXES).agg(F.min(d2).alias("d2"), F.max("_same").alias("n"))
    return near.select(key, "d2", "n")


def chamfer(points: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """Symmetric chamfer distance within each set: mean squared distance to the nearest point of the other side, both ways summed.

    ``left`` and ``right`` tell the sides; sets without one of them are left out.
    """
    a, b = points.filter(left).select(key, *B.AXES), points.filter(right).select(key, *B.AXES)
    mean = lambda d, n: d.groupBy(key).agg((F.sum(F.col("d2") * F.col("n")) / F.sum("n")).alias(n))
    j = mean(nearest_distance(a, b, key), "_l").join(mean(nearest_distance(b, a, key), "_r"), key)
    return j.select(key, (F.col("_l") + F.col("_r")).alias("chamfer"))


def nearest_rows(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """query_id, vec_id, rank, d2: the k rows of ``vectors`` nearest to each query (the row itself included), exactly.

    ``vectors`` and ``queries`` have vec_id and embedding. The queries go out in blocks of bounded size; each batch of
    vectors keeps its k best per query, and a window ranks what is left. Ties go to the lower id; null or differently
    long embeddings are left out.
    """
    spark = vectors.sparkSession
    schema, out = "query_id long, vec_id long, d2 double", None
    q = queries.filter(F.col("embedding").isNotNull())
    parts = max(1, -(-q.count() // block))
    for i in range(parts):
        own = (q if parts == 1 else q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == i)).select("vec_id", "embedding").collect()
        sent = spark.sparkContext.broadcast(([r.vec_id for r in own], np.array([r.embedding for r in own], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, m = np.array(sent.value[0], dtype=np.int64), sent.value[1]
            for b in batches:
                rows = [(v, e) for v, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if e is not None and m.ndim == 2 and len(e) == m.shape[1]]
                rows.sort(key=lambda r: r[0])
                vid, x = np.array([v for v, _ in rows], dtype=np.int64), np.array([e for _, e in rows], dtype=np.float64)
                if not len(vid):
                    continue
                # a matrix product finds who may be among the k nearest, within its rounding; their distances are then taken exactly
                x2, m2 = (x * x).sum(1), (m * m).sum(1)
                rough = x2[None] - 2 * (m @ x.T)
                top = min(k, len(vid)) - 1
                slack = 1e-12 * x.shape[1] * (x2.max(initial=0.0) + m2)[:, None]
                q, at = np.nonzero(rough <= np.partition(rough, top, axis=1)[:, top : top + 1] + slack)
                d2 = np.concatenate([((x[at[i : i + 65536]] - m[q[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(q), 65536)])
                order = np.lexsort((at, d2, q))
                q, at, d2 = q[order], at[order], d2[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[keep]]), pa.array(vid[at[keep]]), pa.array(d2[keep])], names=["query_id", "vec_id", "d2"])

        part = vectors.select("vec_id", "embedding").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    w = W.partitionBy("query_id").orderBy("d2", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
