"""Refining box sets by edits, all meshes at once: greedy edits, rollouts with a mask per box, recentring.

Meshes of at most :data:`TOGETHER` different points travel as one row of arrays each and are refined many at a time in
array arithmetic; a larger mesh keeps a row per point, and all larger meshes are refined in rounds of
DataFrame steps. Both give the same edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.operators import spatial as S
from meshquarry.operators.loops import principal_frames
from meshquarry.session import release, salted_join, spill

#: Different points up to which a mesh is refined within one row.
TOGETHER = 4096
#: Numbers held at once by a task that refines small meshes.
_ROOM = 1 << 22
#: Rounds after which a refinement without ``steps`` gives up (the largest max_step of the reference's configurations).
MOST_ROUNDS = 2000


def _score(bvs: np.ndarray, covered: np.ndarray, penalty: float, rate: float) -> np.ndarray:
    return -np.abs(bvs - 1) - (1 - covered) * rate * penalty


def _volumes(b: np.ndarray) -> np.ndarray:
    return np.maximum(b[..., 3:] - b[..., :3], 0).prod(-1)


def edit_sets(p: np.ndarray, w: np.ndarray, b: np.ndarray, there: np.ndarray, shape: np.ndarray, steps: int | None, scales: list[float], penalty: float, rate: float, stop: str, masked: bool) -> tuple[np.ndarray, ...]:
    """Bounds, score, steps and mask of padded meshes after their greedy edits.

    ``p`` (m, n, 3) and ``w`` (m, n) are points and weights (0: padding), ``b`` (m, k, 6) boxes and ``there`` (m, k) which
    of them exist. The edit of the highest reward, rounded to nine digits, goes first; ties go to the lowest action.
    """
    m, k = there.shape
    b, full = np.where(there[..., None], b, [np.inf] * 3 + [-np.inf] * 3), w.sum(1)
    inside = lambda p, b: ((p[:, None] >= b[:, :, None, :3]) & (p[:, None] <= b[:, :, None, 3:])).all(-1)
    cov = (inside(p, b).any(1) * w).sum(1) / full
    last = _score(np.where(there, _volumes(b), 0).sum(1) / shape, cov, penalty, rate)
    taken, mask, live = np.zeros(m, int), there.copy(), np.arange(m)
    for i in range(MOST_ROUNDS + 1 if steps is None else steps):
        if not len(live):
            break
        if i == MOST_ROUNDS and steps is None:
            raise RuntimeError(f"{len(live)} meshes still gain after {MOST_ROUNDS} rounds")
        q, v, own = p[live], w[live], b[live]
        vol = np.where(there[live], _volumes(own), 0.0)
        every = vol.sum(1)
        side = np.concatenate((q[:, None] >= own[:, :, None, :3], q[:, None] <= own[:, :, None, 3:]), axis=-1)  # (m, k, n, 6)
        held = side.all(-1)
        other = held.sum(1)[:, None] - held > 0
        missing = (~side).sum(-1)
        reward = np.full((len(live), k, 6, len(scales)), -np.inf)
        for c in range(6):
            rest = (missing - ~side[..., c]) == 0
            at = q[:, None, :, c % 3]
            for j, d in enumerate(scales):
                edited = own.copy()
                edited[..., c] += d
                moved = edited[..., c][..., None]
                hit = other | (rest & (at >= moved if c < 3 else at <= moved))
                covered = (hit * v[:, None]).sum(-1) / full[live][:, None]
                bvs = (every[:, None] - vol + _volumes(edited)) / shape[live][:, None]
                gain = _score(bvs, covered, penalty, rate) - last[live][:, None]
                reward[:, :, c, j] = np.where((edited[..., :3] < edited[..., 3:]).all(-1) & mask[live], gain, -np.inf)
        flat = np.round(reward, 9).reshape(len(live), -1)
        best = flat.argmax(1)
        top = flat[np.arange(len(live)), best]
        bar = 0.0 if stop == "positive" else np.maximum(0.0, -np.abs(every / shape[live] - 1) - last[live])
        if masked:
            mask[live] &= flat.reshape(len(live), k, -1).max(-1) >= 0
        go = top > bar
        live, best = live[go], best[go]
        box, c, j = np.unravel_index(best, (k, 6, len(scales)))
        b[live, box, c] += np.array(scales)[j]
        last[live] += reward.reshape(len(go), -1)[go, best]
        taken[live] += 1
    return b, last, taken, mask


def _small(sets: DataFrame, mesh: str, steps: int | None, scales: list[float], penalty: float, rate: float, stop: str, masked: bool) -> DataFrame:
    """Refined boxes of the meshes whose points and boxes stand in one row each."""
    kind = sets.schema[mesh].dataType.simpleString()
    out = f"{mesh} {kind}, bbox_idx int, {', '.join(f'{c} double' for c in B.BOUNDS)}, score double, steps int, open boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, pts, boxes, shape = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
            order = sorted(range(len(pts)), key=lambda i: len(pts[i]))
            while order:
                n = len(pts[order[0]])
                take = [i for i in order if len(pts[i]) <= max(16, 2 * n)]
                k = max(len(boxes[i]) for i in take)
                most = max(len(pts[i]) for i in take)
                take = take[: max(1, _ROOM // (most * k * 6))]
                order = order[len(take) :]
                m, most = len(take), max(len(pts[i]) for i in take)
                p, w, b, there = np.zeros((m, most, 3)), np.zeros((m, most)), np.zeros((m, k, 6)), np.zeros((m, k), bool)
                for r, i in enumerate(take):
                    got = np.array([list(x.values()) for x in pts[i]], float)
                    p[r, : len(got)], w[r, : len(got)] = got[:, :3], got[:, 3]
                    own = np.array([list(x.values()) for x in boxes[i]], float)
                    b[r, : len(own)], there[r, : len(own)] = own[:, 1:], True
                b, last, taken, mask = edit_sets(p, w, b, there, shape[take], steps, scales, penalty, rate, stop, masked)
                r, c = np.nonzero(there)
                idx = [boxes[take[x]][y]["bbox_idx"] for x, y in zip(r, c)]
                cols = [key.take(pa.array(np.array(take)[r])), pa.array(idx, type=pa.int32()), *(pa.array(b[r, c, x]) for x in range(6)), pa.array(last[r]), pa.array(taken[r].astype(np.int32)), pa.array(mask[r, c])]
                yield pa.RecordBatch.from_arrays(cols, names=[mesh, "bbox_idx", *B.BOUNDS, "score", "steps", "open"])

    return sets.select(mesh, "_p", "_b", "_shape").mapInArrow(run, out)


def greedy_refine(points: DataFrame, boxes: DataFrame, mesh: str, shape: Column, s: int, unit: float, steps: int | None = None, penalty: float = 100.0, rate: float = 1.0, stop: str = "positive", masked: bool = False, together: int = TOGETHER) -> DataFrame:
    """mesh, bbox_idx, bounds, score, steps, open: each round every mesh applies the edit of the highest proxy reward, until none gains.

    ``stop`` says what an edit must beat: ``positive`` a reward of 0, ``bound`` what the mesh would gain by full coverage without
    an edit (an edit must then win more than the coverage still missing). With ``masked`` a box leaves the search for good
    when its best edit loses; ``open`` tells the boxes that haven't. Meshes are edited at most ``steps`` times; without it
    rounds go on until no mesh gains, and a mesh that gains after ``MOST_ROUNDS`` is an error. Points of no weight, and
    meshes without points, boxes or a positive shape, are left out.
    """
    own = boxes.withColumn("_shape", shape).filter(F.col("_shape") > 0).select(mesh, "bbox_idx", *B.BOUNDS, "_shape")
    p = points.filter(F.col("weight") > 0).groupBy(mesh, *B.AXES).agg(F.sum("weight").alias("weight"))
    p = spill(salted_join(p, own.select(mesh).distinct(), mesh, F.xxhash64(*B.AXES), how="inner").select(mesh, *B.AXES, "weight"), "points")
    n = p.groupBy(mesh).agg(F.count("*").alias("_n"))
    size = spill(n, "sizes")
    small, large = size.filter(F.col("_n") <= together).select(mesh), size.filter(F.col("_n") > together).select(mesh)
    few = p.join(small, mesh, "left_semi").groupBy(mesh).agg(F.collect_list(F.struct(*B.AXES, "weight")).alias("_p"))
    sets = own.groupBy(mesh).agg(F.array_sort(F.collect_list(F.struct("bbox_idx", *B.BOUNDS))).alias("_b"), F.max("_shape").alias("_shape"))
    scales = [k * unit for k in B.action_scales(s)]
    out = _small(few.join(sets, mesh), mesh, steps, scales, penalty, rate, stop, masked)
    if large.isEmpty():
        return out
    big = large  # at most all points / together of them
    return out.unionByName(_rounds(p.join(big, mesh, "left_semi"), own.join(big, mesh, "left_semi"), mesh, s, unit, steps, penalty, rate, stop, masked))


def _rounds(points: DataFrame, boxes: DataFrame, mesh: str, s: int, unit: float, steps: int | None, penalty: float, rate: float, stop: str, masked: bool) -> DataFrame:
    """:func:`greedy_refine` for meshes of any size, a round of DataFrame steps per edit."""
    now = spill(boxes.withColumn("_steps", F.lit(0)).withColumn("open", F.lit(True)), "refine")
    points = spill(points.select(mesh, *B.AXES, "weight"), "points")
    cov = S.covered(points, now, mesh).groupBy(mesh).agg((F.sum(F.when(F.col("n_boxes") > 0, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("_cov"))
    bvs = now.groupBy(mesh).agg((F.sum(B.volume(B.box())) / F.max("_shape")).alias("_bvs"))
    first = cov.join(bvs, mesh).select(mesh, B.score(F.col("_bvs"), F.col("_cov"), penalty, rate).alias("_last"))
    now = spill(now.join(first, mesh), "refine")
    done, live = [], now.select(mesh).distinct().count()
    for i in range(MOST_ROUNDS + 1 if steps is None else steps):
        r = S.proxy_rewards(points, now, mesh, s, unit, F.col("_shape"), F.col("_last"), penalty, rate)
        r = r.join(now.filter("open").select(mesh, "bbox_idx"), [mesh, "bbox_idx"]).withColumn("gain", F.round("reward", 9))
        r = r.groupBy(mesh, "bbox_idx").agg(F.max(F.struct("gain", (-F.col("action")).alias("a"), "bbox_idx", "coord_idx", "scale_idx", "reward")).alias("b"))
        r = spill(r, "best") if masked else r
        best = r.groupBy(mesh).agg(F.max("b").alias("b"))
        full = now.groupBy(mesh).agg((-F.abs(F.sum(B.volume(B.box())) / F.max("_shape") - 1) - F.max("_last")).alias("_full"))
        bar = F.lit(0.0) if stop == "positive" else F.greatest(F.lit(0.0), F.col("_full"))
        won = spill(best.join(full, mesh).filter(F.col("b.gain") > bar).select(mesh, "b.*"), "won")
        gaining = won.count()
        if masked:
            shut = now.join(r.select(mesh, "bbox_idx", F.col("b.gain").alias("_g")), [mesh, "bbox_idx"], "left")
            now = spill(shut.withColumn("open", F.col("open") & (F.coalesce("_g", F.lit(-1.0)) >= 0)).drop("_g"), "refine")
        if not gaining:
            break
        if i == MOST_ROUNDS and steps is None:
            raise RuntimeError(f"{gaining} meshes still gain after {MOST_ROUNDS} rounds")
        if 2 * gaining <= live:  # set the finished aside with their points
            done.append(spill(now.join(won.select(mesh), mesh, "left_anti"), "done"))
            now, live = now.join(won.select(mesh), mesh, "left_semi"), gaining
            fewer = spill(points.join(won.select(mesh), mesh, "left_semi"), "points")
            release(points)
            points = fewer
        w = won.select(mesh, "reward", F.col("bbox_idx").alias("_k"), F.col("coord_idx").alias("_c"), (B.step(F.col("scale_idx"), s) * unit).alias("_d"))
        j = now.join(w, mesh, "left")
        hit = F.col("_k") == F.col("bbox_idx")
        edited = B.apply_edit(B.box(), F.when(hit, F.col("_c")).otherwise(6), F.col("_d"))
        after = spill(j.select(mesh, "bbox_idx", *(F.coalesce(e, F.col(c)).alias(c) for c, e in zip(B.BOUNDS, edited)), "_shape", (F.col("_steps") + F.when(F.col("reward").isNotNull(), 1).otherwise(0)).alias("_steps"), "open", (F.col("_last") + F.coalesce("reward", F.lit(0.0))).alias("_last")), "refine")
        release(now, won)
        now = after
    for d in done:
        now = now.unionByName(d)
    return now.select(mesh, F.col("bbox_idx").cast("int").alias("bbox_idx"), *B.BOUNDS, F.col("_last").alias("score"), F.col("_steps").alias("steps"), "open")


def recentred(points: DataFrame, boxes: DataFrame, mesh: str) -> DataFrame:
    """mesh, bbox_idx, bounds, rotation, moved: each oriented box re-fitted to the frame of the points in it.

    ``boxes`` has bbox_idx, bounds in the box's own frame and ``rotation`` (nine numbers, row major); ``points`` are the
    candidates, with ``in_x``, ``in_y``, ``in_z`` the place that decides whether a point belongs to a box (for a corner of
    a tetrahedron its centre). The new frame is that of the points' variances; the box keeps its extents, and its centre
    moves to that of the points' bounds in the new frame. Boxes with fewer than three points, or points without an area, stay.
    """
    own = boxes.select(mesh, "bbox_idx", *B.BOUNDS, "rotation")
    sets = own.groupBy(mesh).agg(F.collect_list(F.struct("bbox_idx", *B.BOUNDS, "rotation")).alias("_s"))
    j = salted_join(points.select(mesh, *B.AXES, "in_x", "in_y", "in_z"), sets, mesh, F.xxhash64(*B.AXES), how="inner")
    at = [F.col(f"in_{a}") for a in B.AXES]
    mine = F.filter("_s", lambda x: B.contains_oriented([x[c] for c in B.BOUNDS], x["rotation"], at))
    inside = spill(j.select(mesh, *B.AXES, F.explode(F.transform(mine, lambda x: x["bbox_idx"])).alias("bbox_idx")), "inside")
    f = principal_frames(inside, [mesh, "bbox_idx"]).filter((F.col("n") >= 3) & (F.col("variances")[1] > 1e-18)).select(mesh, "bbox_idx", F.col("frame"))
    f = spill(f, "frames")
    local = salted_join(inside.withColumn("_k", F.struct(mesh, "bbox_idx")), f.select(F.struct(mesh, "bbox_idx").alias("_k"), "frame"), "_k", F.xxhash64(*B.AXES), how="inner")
    turned = B.rotate(F.col("frame"), [F.col(a) for a in B.AXES])
    mid = local.select(mesh, "bbox_idx", *(t.alias(f"t{i}") for i, t in enumerate(turned))).groupBy(mesh, "bbox_idx").agg(*(((F.min(f"t{i}") + F.max(f"t{i}")) / 2).alias(f"m{i}") for i in range(3)))
    half = [(F.col(h) - F.col(l)) / 2 for l, h in zip(B.LOWS, B.HIGHS)]
    fit = F.col("frame").isNotNull() & F.least(*half).__gt__(0.5e-9)
    new = [F.col(f"m{i}") - half[i] for i in range(3)] + [F.col(f"m{i}") + half[i] for i in range(3)]
    r = own.join(f, [mesh, "bbox_idx"], "left").join(mid, [mesh, "bbox_idx"], "left")
    return r.select(mesh, "bbox_idx", *(F.when(fit, v).otherwise(F.col(c)).alias(c) for c, v in zip(B.BOUNDS, new)), F.when(fit, F.col("frame")).otherwise(F.col("rotation")).alias("rotation"), fit.alias("moved"))
