"""Volumes, escape sets, assignment and training against literals and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.operators import selection as S
from meshquarry.operators import training as T
from meshquarry.operators import volumes as V
from meshquarry.plans import extras as X

BOX = "k long, " + ", ".join(f"{c} double" for c in B.BOUNDS)
TET = [0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_clipped_volumes_by_sampling():
    rnd = np.random.default_rng(1)
    tets = rnd.uniform(0, 1, (6, 4, 3))
    lo = rnd.uniform(0, 0.6, (6, 3))
    boxes = np.concatenate([lo, lo + rnd.uniform(0.2, 0.6, (6, 3))], 1)
    got = V.clipped_volumes(tets, boxes)
    for t, b, g in zip(tets, boxes, got):
        p = rnd.uniform(b[:3], b[3:], (200_000, 3))
        w = np.linalg.solve((t[1:] - t[0]).T, (p - t[0]).T)
        share = ((w >= 0).all(0) & (w.sum(0) <= 1)).mean()
        assert g == pytest.approx(share * np.prod(b[3:] - b[:3]), abs=2e-3)


def test_tet_box_metrics(spark):
    t = spark.createDataFrame([(k, *map(float, TET)) for k in (1, 2, 3)], "k long, " + ", ".join(f"{c} double" for c in V.CORNERS))
    b = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 0.5, 1.0, 1.0), (2, 0.25, 0.0, 0.0, 1.0, 1.0, 1.0), (3, 5.0, 5.0, 5.0, 6.0, 6.0, 6.0)], BOX)
    r = {x.k: x for x in V.tet_box_metrics(t, b, "k").collect()}
    assert r[1].bvs == pytest.approx(6) and r[1].covered == pytest.approx(1) and r[1].viou == pytest.approx(1 / 6)
    assert r[2].covered == pytest.approx(1) and r[2].bvs == pytest.approx(7.5) and r[3].covered == 0 and r[3].tov == pytest.approx(6)
    nine = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, float(i + 1)) for i in range(9)], BOX)
    x = V.tet_box_metrics(t, nine, "k").first()
    assert x.bvs == pytest.approx(270) and x.covered == pytest.approx(1) and x.tov == pytest.approx(53)


def test_overlap_metrics(spark):
    shape = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0, 1.0, 1.0)], BOX)
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 1.0, 0.0, 0.0, 3.0, 1.0, 1.0), (1, 9.0, 9.0, 9.0, 8.0, 9.0, 9.0)], BOX)
    r = V.overlap_metrics(shape, boxes, "k").first()
    assert (r.bvs, r.covered, r.tov, r.mov) == pytest.approx((1.5, 1, 0.5, 1)) and r.viou == pytest.approx(2 / 3)


def test_diverse_escape(spark):
    rows = [("s", a, b, c, float(v)) for a, b, c, v in [(0, 0, 0, 9), (1, 0, 0, 8), (2, 0, 1, 7), (3, 1, 0, 6), (4, 1, 1, 5)]] + [("t", 0, 0, 0, 1.0), ("t", 1, 0, 0, None)]
    d = spark.createDataFrame(rows, "g string, a long, b int, c int, v double")
    got = {r.g: r.picks for r in S.diverse_escape(d, ["g"], "v", "a", "b", "c", 3).collect()}
    assert got == {"s": [0, 2, 3], "t": [0]}


def test_greedy_assignment(spark):
    rnd = random.Random(2)
    rows = [(g, l, r, float(rnd.randint(0, 6))) for g in range(4) for l in range(5) for r in range(4)]
    want = set()
    for g in range(4):
        ls, rs = set(), set()
        for c, l, r in sorted((c, l, r) for x, l, r, c in rows if x == g):
            if l not in ls and r not in rs:
                ls.add(l), rs.add(r), want.add((g, l, r))
    got = S.greedy_assignment(spark.createDataFrame(rows, "g long, l long, r long, c double"), "g", "l", "r", "c")
    assert {(x.g, x.l, x.r) for x in got.collect()} == want


def test_softmax_training(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(60, 2))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    d = spark.createDataFrame([(float(a), float(b), int(k), 1.0 + i % 3) for i, ((a, b), k) in enumerate(zip(x, y))] + [(None, 1.0, 0, 1.0)], "a double, b double, y int, w double")
    w, b, loss = T.fit_softmax(d, ["a", "b"], "y", 3, "w", 6, 0.5, 0.01)
    W, bb, sw = np.zeros((3, 2)), np.zeros(3), 1.0 + np.arange(60) % 3
    for _ in range(6):
        z = x @ W.T + bb
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(3)[y]) * sw[:, None]
        W, bb = W - 0.5 * (g.T @ x / sw.sum() + 0.01 * W), bb - 0.5 * g.sum(0) / sw.sum()
    assert np.allclose(w, W) and np.allclose(b, bb) and all(p > q for p, q in itertools.pairwise(loss))


def test_small_kernels(spark):
    b = [F.lit(float(v)) for v in (0, 0, 0, 1, 2, 3)]
    major, minor = B.axis_rank(b)
    r = spark.range(1).select(major.alias("a"), minor.alias("i"), B.role(F.lit(0), F.lit(-1.0)).alias("e"), B.role(F.lit(4), F.lit(-1.0)).alias("s"), B.role(F.lit(6), F.lit(0.0)).alias("c"), B.named_bucket(F.lit(2.0), [1.0, 2.0], ["x", "y", "z"]).alias("n"), B.td_target(F.lit(1.0), F.lit(False), F.lit(2.0), 0.5).alias("t"), B.blended(F.array(F.lit(1.0)), F.array(F.lit(3.0)), 0.25).alias("m"), B.soft_inside(b, [F.lit(0.5), F.lit(1.0), F.lit(1.5)], 50.0).alias("o")).first()
    assert (r.a, r.i, r.e, r.s, r.c, r.n, r.t, r.m) == (2, 0, "expand", "shrink", "recenter", "z", 2.0, [2.5]) and r.o == pytest.approx(1)


def test_untried_actions_of_all_events(spark, tmp_path):
    rows = [(1, '{"k": 0}'), (1, '{"k": 16}'), (1, '{"k": 12}'), (2, '{"k": 7}'), (3, None)]
    spark.createDataFrame(rows, "user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: (r.masked, r.untried) for r in X.untried_actions(spark, str(tmp_path)).collect()}
    assert got == {1: (5, "4,5,6,7,8,9,10,11"), 2: (2, "0,1,2,3,4,5,8,9,10,11,12"), 3: (0, ",".join(map(str, range(13))))}


def test_readiness_of_all_meshes(spark, tmp_path):
    stages = ["normalize", "tetra", "merge", "refine"]
    rows = [("a", s, st) for s, st in zip(stages, ["success", " OK", "Succeeded", "success"])] + [("x/A.obj", "merge", "failed"), ("b", "merge", "failed"), ("b", "refine", None), ("c", "tetra", "ok"), ("d", "mcts", "success")]
    spark.createDataFrame(rows, "mesh_id string, stage string, status string").write.parquet(str(tmp_path / "stage_record.parquet"))
    got = {r.lacking: (r.meshes, r.ready) for r in X.readiness(spark, str(tmp_path)).collect()}
    assert got == {"": (1, True), "normalize,merge,refine": (1, False), "normalize,tetra,merge,refine": (2, False)}


def test_many_boxes_are_cut_into_cells(spark):
    from meshquarry.functions import boxes as B
    from meshquarry.operators import volumes as V

    # ten boxes side by side and one around the first nine: more than inclusion and exclusion takes
    rows = [("m", float(i), 0.0, 0.0, i + 1.0, 1.0, 1.0) for i in range(10)] + [("m", 0.0, 0.0, 0.0, 9.0, 1.0, 1.0), ("few", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    b = spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in B.BOUNDS))
    corner = (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    t = spark.createDataFrame([("m", *corner), ("few", *corner)], "k string, " + ", ".join(f"{c} double" for c in V.CORNERS))
    got = {r.k: r for r in V.tet_box_metrics(t, b, "k").collect()}
    assert abs(got["m"].covered - 1) < 1e-9 and abs(got["m"].bvs - 19 * 6) < 1e-9 and abs(got["m"].tov - (10 - 1 / 6) * 6) < 1e-9 and abs(got["few"].tov - 5) < 1e-9


def test_gelu_and_auc_of_one_group(spark):
    import math

    from pyspark.sql import functions as F

    from meshquarry.operators import scoring as S

    d = spark.createDataFrame([(x,) for x in (-3.0, 0.0, 1.0, None)], "x double")
    want = [0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in (-3.0, 0.0, 1.0)]
    assert [r.g for r in d.select(S.gelu(F.col("x")).alias("g")).collect()][:3] == want
    rows = [(i % 2, (i * 7919 % 101) / 10.0) for i in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    r = S.roc_auc(spark.createDataFrame(rows, "y int, s double").repartition(7), F.col("y"), F.col("s")).first()
    assert abs(r.auc - auc) < 1e-12 and (r.positives, r.negatives) == (200, 200)
