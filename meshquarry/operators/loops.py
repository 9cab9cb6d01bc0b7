"""Fixpoints and greedy procedures as rounds of DataFrame steps, all meshes at once.

Every round works on the tables of all meshes and is cut by a written table, so a mesh is
never gathered into one task and lost executors only cost their part of a round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.functions import vectors as V
from meshquarry.operators import spatial as S
from meshquarry.session import release, salted_join, spill


def components(edges: DataFrame, mesh: str) -> DataFrame:
    """mesh, v, component: the least vertex of each connected piece of each mesh, by least labels and pointer jumping.

    ``edges`` has mesh, src, dst (longs); they count both ways.
    """
    k = F.col(mesh).alias("_k")
    e = spill(edges.select(k, "src", "dst").union(edges.select(k, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    label = e.groupBy("_k", F.col("src").alias("v")).agg(F.least(F.min("dst"), F.min("src")).alias("l"))
    label = spill(label, "label")
    while True:
        near = e.join(label.select("_k", F.col("v").alias("dst"), "l"), ["_k", "dst"]).groupBy("_k", F.col("src").alias("v")).agg(F.min("l").alias("n"))
        step = label.join(near, ["_k", "v"]).withColumn("to", F.least("l", "n"))
        jump = step.select("_k", F.col("v").alias("to"), F.col("to").alias("far"))
        new = step.join(jump, ["_k", "to"], "left").select("_k", "v", F.least("to", F.coalesce("far", "to")).alias("l2"), "l")
        new = spill(new, "label")
        release(label)
        if new.filter(F.col("l2") != F.col("l")).isEmpty():
            release(e)
            return new.select(F.col("_k").alias(mesh), "v", F.col("l2").alias("component"))
        label = new.select("_k", "v", F.col("l2").alias("l"))
        label._spilled = new._spilled


def suppress(boxes: DataFrame, mesh: str, idx: str, score: Column, limit: float) -> DataFrame:
    """Non-maximum suppression: the boxes kept when taken by score, each if its IoU with all kept is at most ``limit``.

    Ties go to the lower index. In each round every box none of whose open rivals scores higher is kept and its
    rivals fall; that gives the sequential result.
    """
    b = boxes.withColumn("_s", score)
    rank = F.struct(F.col("_s"), -F.col(idx))
    pair = S.pair_overlaps(b, mesh, idx).filter(F.col("iou") > limit)
    o = b.select(mesh, F.col(idx).alias("i"), rank.alias("r"))
    both = pair.join(o.select(mesh, F.col("i").alias("idx_a"), F.col("r").alias("ra")), [mesh, "idx_a"]).join(o.select(mesh, F.col("i").alias("idx_b"), F.col("r").alias("rb")), [mesh, "idx_b"])
    a_first = F.col("ra") > F.col("rb")
    beats = spill(both.select(mesh, F.when(a_first, F.col("idx_a")).otherwise(F.col("idx_b")).alias("hi"), F.when(a_first, F.col("idx_b")).otherwise(F.col("idx_a")).alias("lo")), "beats")
    open_ = spill(o.select(mesh, "i"), "open")
    kept = open_.limit(0)
    while not open_.isEmpty():
        live = beats.join(open_.withColumnRenamed("i", "hi"), [mesh, "hi"])
        win = spill(open_.join(live.select(mesh, F.col("lo").alias("i")).distinct(), [mesh, "i"], "left_anti"), "win")
        kept = kept.union(win)
        fall = beats.join(win.withColumnRenamed("i", "hi"), [mesh, "hi"]).select(mesh, F.col("lo").alias("i"))
        open_ = spill(open_.join(win.union(fall).distinct(), [mesh, "i"], "left_anti"), "open")
    return boxes.join(kept.withColumnRenamed("i", idx), [mesh, idx], "left_semi")


def farthest_points(points: DataFrame, mesh: str, pid: str, k: int) -> DataFrame:
    """mesh, pick (0 ...), pid: farthest-point sampling, all meshes at once; starts at the lowest id, ties to the lower id.

    Meshes of fewer different points give as many picks as they have.
    """
    p = points.select(mesh, pid, *B.AXES).dropDuplicates([mesh, pid])
    start = p.groupBy(mesh).agg(F.min_by(F.struct(pid, *B.AXES), F.col(pid)).alias("c"))
    state, chosen = spill(p.withColumn("d", F.lit(float("inf"))), "fps"), spill(start, "pick")
    out = chosen.select(mesh, F.lit(0).alias("pick"), F.col(f"c.{pid}").alias(pid))
    for i in range(1, k):
        d2 = V.distance2([F.col(a) for a in B.AXES], [F.col(f"c.{a}") for a in B.AXES])
        near = spill(salted_join(state, chosen, mesh, F.col(pid), how="inner").withColumn("d", F.least("d", d2)).drop("c").filter(F.col("d") > 0), "fps")
        release(state)  # a point at distance 0 from a pick is never picked again
        state = near
        best = state.groupBy(mesh).agg(F.max_by(F.struct(pid, *B.AXES), F.struct("d", -F.col(pid))).alias("c"))
        chosen = spill(best, "pick")
        out = out.union(chosen.select(mesh, F.lit(i).alias("pick"), F.col(f"c.{pid}").alias(pid)))
    return out


def greedy_merge(parts: DataFrame, adjacency: DataFrame, mesh: str, pid: str, shape: DataFrame, eps: float = 0.0, final_k: int | None = None) -> DataFrame:
    """mesh, pid, into, rounds: agglomerative merging of adjacent parts, one merge per mesh and round, until no mesh merges.

    Of a mesh's adjacent pairs the one is merged whose change of summed box volume over shape volume is closest to
    1 - bvs (ties: lower pair); it must have a reward above -|eps|, or with ``final_k`` the mesh more parts than that.
    ``parts`` has mesh, pid and bounds; ``adjacency`` mesh, l, r with l < r; ``shape`` mesh and shape. A pair carries the
    boxes of both sides and its mesh's totals, so a round is one aggregation and one join on the pairs of the meshes that
    still merge; the merges are logged and followed to the last part at the end.
    """
    known = spill(parts.select(mesh, pid, *B.BOUNDS).join(shape, mesh).withColumn("v", B.volume(B.box())), "parts")
    totals = known.groupBy(mesh).agg(F.sum("v").alias("all"), F.count("*").alias("n"))
    side = lambda c: known.select(mesh, F.col(pid).alias(c), F.struct(*B.BOUNDS).alias(f"{c}_box"), *(["shape"] if c == "l" else []))
    pairs = adjacency.select(mesh, "l", "r").filter(F.col("l") < F.col("r")).distinct().join(side("l"), [mesh, "l"]).join(side("r"), [mesh, "r"])
    pairs = spill(salted_join(pairs, totals, mesh, F.xxhash64("l", "r"), how="inner"), "pairs")
    of = lambda c: [F.col(f"{c}_box.{b}") for b in B.BOUNDS]
    union = [F.least(x, y) if b.startswith("min") else F.greatest(x, y) for b, x, y in zip(B.BOUNDS, of("l"), of("r"))]
    change = B.volume(union) - B.volume(of("l")) - B.volume(of("r"))
    bvs = F.col("all") / F.col("shape")
    log: DataFrame | None = None
    i = 0
    while True:
        i += 1
        scored = pairs.select(mesh, "l", "r", "n", F.round(F.abs(change / F.col("shape") - (1 - bvs)), 9).alias("gap"), B.merge_reward(bvs, B.volume(of("l")), B.volume(of("r")), B.volume(union), F.col("shape")).alias("reward"), change.alias("change"), F.struct(*(u.alias(b) for u, b in zip(union, B.BOUNDS))).alias("box"))
        best = scored.groupBy(mesh).agg(F.min_by(F.struct("l", "r", "reward", "n", "change", "box"), F.struct("gap", "l", "r")).alias("b"))
        go = F.col("b.n") > final_k if final_k is not None else F.col("b.reward") > -abs(eps)
        merge = spill(best.filter(go).select(mesh, F.lit(i).alias("round"), F.col("b.l").alias("new"), F.col("b.r").alias("old"), F.col("b.change").alias("change"), F.col("b.box").alias("box")), "merge")
        if merge.isEmpty():
            break
        log = merge.select(mesh, "round", "old", "new") if log is None else log.union(merge.select(mesh, "round", "old", "new"))
        j = salted_join(pairs, merge, mesh, F.xxhash64("l", "r"), how="inner")
        touched = lambda c: F.col(c).isin(F.col("old"), F.col("new"))
        box = lambda c: F.when(touched(c), F.col("box")).otherwise(F.col(f"{c}_box"))
        to = lambda c: F.when(touched(c), F.col("new")).otherwise(F.col(c))
        j = j.select(mesh, F.struct(to("l").alias("p"), box("l").alias("box")).alias("x"), F.struct(to("r").alias("p"), box("r").alias("box")).alias("y"), "shape", (F.col("all") + F.col("change")).alias("all"), (F.col("n") - 1).alias("n")).filter(F.col("x.p") != F.col("y.p"))
        lo, hi = F.when(F.col("x.p") < F.col("y.p"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x.p") < F.col("y.p"), F.col("y")).otherwise(F.col("x"))
        j = j.select(mesh, lo.alias("lo"), hi.alias("hi"), "shape", "all", "n")
        j = j.select(mesh, F.col("lo.p").alias("l"), F.col("hi.p").alias("r"), F.col("lo.box").alias("l_box"), F.col("hi.box").alias("r_box"), "shape", "all", "n")
        after = spill(j.dropDuplicates([mesh, "l", "r"]), "pairs")
        release(pairs)
        pairs = after
    if log is None:
        return known.select(mesh, pid, F.col(pid).alias("into"), F.lit(0).alias("rounds"))
    # every part vanishes at most once, so the log is a forest; pointers double until none moves
    at = spill(log.select(mesh, "old", "new"), "log")
    while True:
        nxt = at.select(mesh, F.col("old").alias("new"), F.col("new").alias("then"))
        after = spill(at.join(nxt, [mesh, "new"], "left").select(mesh, "old", F.coalesce("then", "new").alias("new"), F.col("then").isNotNull().alias("moved")), "log")
        moved = not after.filter("moved").isEmpty()
        release(at)
        at = after
        if not moved:
            break
    count = log.groupBy(mesh).agg(F.max("round").alias("rounds"))
    out = known.select(mesh, pid).join(at.select(mesh, F.col("old").alias(pid), "new"), [mesh, pid], "left").join(count, mesh, "left")
    return out.select(mesh, pid, F.coalesce("new", pid).alias("into"), F.coalesce("rounds", F.lit(0)).alias("rounds"))


def coverage_scale(points: DataFrame, boxes: DataFrame, mesh: str, target: float) -> DataFrame:
    """mesh, scale: the least factor by which all boxes of a mesh grow about their centres until ``target`` of its weight is covered.

    Each point's own least factor is found over the mesh's boxes; the answer is a weighted quantile of these, without
    trial runs. Boxes without extent are left out.
    """
    b = boxes.filter(B.is_valid(B.box())).groupBy(mesh).agg(F.collect_list(F.struct(*B.BOUNDS)).alias("_b"))
    need = F.array_min(F.transform("_b", lambda x: F.greatest(*(F.abs(F.col(a) - (x[f"min_{a}"] + x[f"max_{a}"]) / 2) / ((x[f"max_{a}"] - x[f"min_{a}"]) / 2) for a in B.AXES))))
    p = points.join(b, mesh).select(mesh, F.round(need, 9).alias("scale"), "weight").groupBy(mesh, "scale").agg(F.sum("weight").alias("weight"))
    w = W.partitionBy(mesh)
    c = p.withColumn("upto", F.sum("weight").over(w.orderBy("scale"))).withColumn("all", F.sum("weight").over(w))
    return c.filter(F.col("upto") >= target * F.col("all") - 1e-9).groupBy(mesh).agg(F.min("scale").alias("scale"))


def principal_frames(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, variances (3, falling), frame (9, row major): the axes of each group's points by variance.

    The covariance is a combining aggregation; only its six numbers meet the 3x3 eigen solver. Each axis points to the
    side of its largest component; the third is the product of the first two.
    """
    c = points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))

    @F.pandas_udf("struct<variances: array<double>, frame: array<double>>")
    def eigen(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([a.to_numpy(float) for a in row], -1) for row in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2)
        m = np.nan_to_num(m)
        val, vec = np.linalg.eigh(m)
        val, axes = val[:, ::-1], np.swapaxes(vec, 1, 2)[:, ::-1].copy()
        lead = np.take_along_axis(axes, np.abs(axes).argmax(2)[..., None], 2)
        axes *= np.where(lead < 0, -1.0, 1.0)
        axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
        return pd.DataFrame({"variances": list(np.maximum(val, 0)), "frame": list(axes.reshape(-1, 9))})

    out = c.withColumn("e", eigen(*(F.col(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz"))))
    return out.select(*keys, "n", "e.variances", "e.frame")
