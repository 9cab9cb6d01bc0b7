"""Literal cases of the scalar kernels."""

import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.functions import search as X
from meshquarry.functions import text as T
from meshquarry.functions import vectors as V
from meshquarry.operators import scoring as C
from meshquarry.operators import spatial as S
from meshquarry.plans import geometry as G


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def lits(*v):
    return [F.lit(float(x)) for x in v]


def boxes(spark, *rows):
    return spark.createDataFrame([(i, k, *map(float, b)) for i, k, b in rows], "mesh long, bbox_idx int, " + ", ".join(f"{c} double" for c in B.BOUNDS))


def test_box_volume_validity_union(spark):
    r = one(spark, v=B.volume(lits(0, 0, 0, 1, 2, 3)), bad=B.volume(lits(1, 0, 0, 0, 2, 3)), ok=B.is_valid(lits(0, 0, 0, 1, 2, 3)), no=B.is_valid(lits(1, 0, 0, 1, 2, 3)))
    assert (r.v, r.bad, r.ok, r.no) == (6.0, 0.0, True, False)
    b = boxes(spark, (1, 0, (0, 0, 0, 1, 2, 3)), (1, 1, (0, 0, 0, 2, 2, 2)))
    assert b.agg(F.sum(B.volume(B.box()))).first()[0] == 14
    u = boxes(spark, (1, 0, (0, 0, 0, 1, 1, 1)), (1, 1, (-1, 0, 0, 0.5, 2, 1)))
    assert S.union_volume(u, "mesh").first().union_volume == pytest.approx(1 + 3 - 0.5)


def test_coverage_closed_and_oriented(spark):
    half = math.sqrt(0.5)
    rot = lits(half, half, 0, -half, half, 0, 0, 0, 1)
    r = one(spark, a=B.contains(lits(-1, -1, -1, 1, 1, 1), lits(0, 0, 0)), b=B.contains(lits(-1, -1, -1, 1, 1, 1), lits(2, 0, 0)), edge=B.contains(lits(-1, -1, -1, 1, 1, 1), lits(1, 1, 1)), o=B.contains_oriented(lits(0, -0.1, -1, 1.5, 0.1, 1), rot, lits(1, 1, 0)), nan=B.contains_oriented(lits(-1, -1, -1, 1, 1, 1), lits(1, 0, 0, 0, 1, 0, 0, 0, 1), lits(math.nan, 0, 0)))
    assert (r.a, r.b, r.edge, r.o, r.nan) == (True, False, True, True, False)


def test_proposals(spark):
    six = F.array(*lits(0, 0, 0, 2, 2, 2))
    twelve = F.array(*lits(0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1))
    r = one(spark, v6=B.proposal_volume(six), v12=B.proposal_volume(twelve), i=B.contains_proposal(six, lits(1, 1, 1)), j=B.contains_proposal(twelve, lits(1.1, 0, 0)))
    assert (r.v6, r.v12, r.i, r.j) == (8.0, 8.0, True, False)


def test_actions(spark):
    assert B.action_count(3, 2) == 39 and B.action_scales(4) == [-2, -1, 1, 2]
    with pytest.raises(ValueError):
        B.action_scales(3)
    got = [r[0] for r in spark.range(13).select(B.opposite(F.col("id"), 2)).collect()]
    assert got == [1, 0, 3, 2, 5, 4, 7, 6, 9, 8, 11, 10, 12]
    d = B.decode(F.col("id"), 2)
    back = spark.range(39).select((B.encode(d["bbox_idx"], d["coord_idx"], d["scale_idx"], 2) == F.col("id")).alias("x")).collect()
    assert all(r.x for r in back)


def test_edit_upper_bounds(spark):
    g = S.edit_grid(boxes(spark, (1, 0, (0, 0, 0, 1, 1, 1))), 2, 0.1)
    r = {x.action: x.u for x in g.select("action", B.upper_reward(B.volume([F.col(f"e_{c}") for c in B.BOUNDS]), F.lit(1.0), F.lit(0.0)).alias("u")).collect()}
    assert len(r) == 13 and r[0] == pytest.approx(-0.1) and r[1] == pytest.approx(-0.1) and r[12] == 0


def test_centroid_proxy(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.5), (1, 1.2, 0.5, 0.5, 0.5)], "mesh long, x double, y double, z double, weight double")
    r = S.proxy_rewards(p, boxes(spark, (1, 0, (0, 0, 0, 1, 1, 1))), "mesh", 2, 0.3, F.lit(1.0), F.lit(0.0), 100.0, 1.0).orderBy(F.desc("reward"), "action").collect()
    assert len(r) == 12 and [x.action for x in r[:3]] == [7, 0, 1]
    by = {x.action: x.reward for x in r}
    assert by[7] == pytest.approx(-0.3) and by[0] < -50


def test_scores(spark):
    r = one(spark, a=B.bavf(F.lit(1.0), F.lit(2.0), 100.0), z=B.bavf(F.lit(1.0), F.lit(0.0), 100.0), m=B.merge_reward(*lits(1.8, 0.5, 0.4, 0.7, 1)))
    assert (r.a, r.z) == (50.0, 0.0) and r.m == pytest.approx(0.2)


def test_search(spark):
    r = one(spark, d=X.discounted(F.array(*lits(1, 2, 3)), 0.5), e=X.discounted(F.array().cast("array<double>"), 0.5), m=X.running_average(F.array(*lits(2, 2, 2, 6))), u1=X.ucb(F.lit(1.0), F.lit(2), F.lit(10), 0.5), u2=X.ucb(F.lit(2.0), F.lit(5), F.lit(10), 0.5), inf=X.ucb(F.lit(1.0), F.lit(0), F.lit(10), 0.5), s=X.skip_probability(F.lit(9.0), F.lit(1.0), 0.7), n=X.weighted_score(F.lit(math.nan), F.lit(0.0), F.lit(0.0), 1.0, 1.0, 1.0), l=X.linear_schedule(F.lit(0.5), 1.0, 0.0, 0.25))
    assert r.d == 2.75 and r.e == 0 and r.m == pytest.approx(3) and r.u2 > r.u1 and r.inf == math.inf and r.s == 0.7 and r.n == -math.inf and r.l == 0
    v = [x[0] for x in spark.createDataFrame([(100.0,), (101.0,)], "v double").select(X.softmax(F.col("v"), W.partitionBy(F.lit(0)), 100.0)).collect()]
    assert sum(v) == pytest.approx(1) and v[1] > v[0]


def test_vectors(spark):
    o, x, y, z = lits(0, 0, 0), lits(1, 0, 0), lits(0, 1, 0), lits(0, 0, 1)
    r = one(spark, v=V.tet_volume(o, x, y, z), c=F.array(*V.tet_centroid(o, x, y, z)), d=V.cuboid_distance(lits(2, 0, 0), lits(1, 1, 1)), i=V.cuboid_distance(o, lits(1, 1, 1)), hit=V.ray_hits(o, lits(1, -1, -1), lits(1, 2, -1), lits(1, -1, 2)), miss=V.ray_hits(lits(2, 0, 0), lits(1, -1, -1), lits(1, 2, -1), lits(1, -1, 2)))
    assert r.v == pytest.approx(1 / 6) and r.c == [0.25] * 3 and r.d == 1 and r.i == -1 and r.hit and not r.miss


def test_two_tet_mesh(spark):
    t = spark.createDataFrame([(1, 0, 0, 1, 2, 3), (1, 1, 0, 1, 2, 4)], "mesh long, tet_id long, v0 long, v1 long, v2 long, v3 long")
    assert S.surface_faces(t, "mesh").count() == 6
    assert sorted((r.src, r.dst) for r in S.tet_adjacency(t, "mesh").collect()) == [(0, 1), (1, 0)]


def test_chamfer_and_neighbours(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0, "a"), (1, 2.0, 0.0, 0.0, "a"), (1, 0.0, 0.0, 0.0, "b"), (2, 1.0, 1.0, 1.0, "a")], "mesh long, x double, y double, z double, side string")
    assert [(r.mesh, r.chamfer) for r in S.chamfer(p, "mesh", F.col("side") == "a", F.col("side") == "b").collect()] == [(1, 2.0)]
    e = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [9.0])], "vec_id long, embedding array<float>")
    got = S.nearest_rows(e, e.filter("vec_id = 1"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.d2) for r in got] == [(1, 0.0), (2, 1.0)]


def test_grid_join_equals_cross(spark):
    import random

    rnd = random.Random(4)
    pts = [(i, *(rnd.uniform(-20, 20) for _ in range(3))) for i in range(200)] + [(200, 0.0, 0.0, 0.0)]
    bx = []
    for i in range(40):
        lo = [rnd.uniform(-20, 20) for _ in range(3)]
        bx.append((i, *lo, *(a + rnd.choice([0.0, 1.0, 9.0, 500.0]) for a in lo)))
    p = spark.createDataFrame(pts, "pid long, x double, y double, z double")
    b = spark.createDataFrame(bx, "bid long, " + ", ".join(f"{c} double" for c in B.BOUNDS))
    want = {(q[0], c[0]) for q in pts for c in bx if all(c[1 + k] <= q[1 + k] <= c[4 + k] for k in range(3))}
    assert {(r.pid, r.bid) for r in S.grid_join(p, b, (1.0, 1.0, 1.0), most_cells=500).select("pid", "bid").collect()} == want
    assert S.grid_join(p, b.limit(0), (1.0, 1.0, 1.0)).count() == 0


def test_grid_join_sends_no_boxes_out_that_fill_many_cells(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = spark.createDataFrame([(0, 0.5, 0.5, 0.5)], "pid long, x double, y double, z double")
    b = boxes(spark, *((1, i, (0, 0, 0, 15, 15, 15)) for i in range(40)))  # 40 rows, 163,840 cells
    assert "BroadcastHashJoin" not in plan(S.grid_join(p, b, (1.0, 1.0, 1.0)))
    assert "BroadcastHashJoin" in plan(S.grid_join(p, b, (16.0, 16.0, 16.0)))
    assert S.grid_join(p, b, (1.0, 1.0, 1.0)).count() == S.grid_join(p, b, (16.0, 16.0, 16.0)).count() == 40
    assert "BroadcastHashJoin" not in plan(G.box_grid_coverage(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("most", [None, 7])
def test_grid_sums_equal_the_pairs(spark, monkeypatch, most):
    import random

    if most:  # each cell in pieces
        monkeypatch.setattr(S, "CELL_POINTS", most)
        monkeypatch.setattr(S, "CELL_BOXES", most)
    rnd, nan = random.Random(5), math.nan
    near = lambda: rnd.choice([rnd.uniform(-20, 20), float(rnd.randint(-3, 3)), -0.0])
    pts = [(near(), near(), near(), rnd.choice([None, 1.5, -2.0])) for _ in range(300)]
    pts += pts[:20] * 3 + [(nan, 1.0, 1.0, 4.0), (1.0, nan, 1.0, 8.0), (None, 1.0, 1.0, 16.0), (50.0, 50.0, 50.0, None)]
    bx = []
    for i in range(60):
        lo = [near() for _ in range(3)]
        bx.append((i, *lo, *(a + rnd.choice([0.0, 1.0, 9.0, 500.0]) for a in lo)))
    bx += [(60 + i, *b[1:]) for i, b in enumerate(bx[:10])] + [(5, *bx[7][1:]), (80, 0.0, nan, 0.0, 2.0, nan, 2.0), (81, None, 0.0, 0.0, 9.0, 9.0, 9.0), (82, 3.0, 0.0, 0.0, -3.0, 9.0, 9.0), (83, 49.0, 49.0, 49.0, 51.0, 51.0, 51.0)]
    p = spark.createDataFrame(pts, "x double, y double, z double, weight double")
    b = spark.createDataFrame(bx, "bid long, " + ", ".join(f"{c} double" for c in B.BOUNDS))
    want = p.crossJoin(b).filter(B.contains(B.box(), [F.col(a) for a in B.AXES])).groupBy("bid").agg(F.count("*"), F.sum("weight")).collect()
    got = S.grid_sums(p, b, (1.0, 1.0, 1.0), "weight", most_cells=500).groupBy("bid").agg(F.sum("n_points"), F.sum("weight")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {(80, 1, 8.0), (83, 1, None)} <= set(map(tuple, got))
    assert S.grid_sums(p, b.limit(0), (1.0, 1.0, 1.0), "weight").count() == S.grid_sums(p.limit(0), b, (1.0, 1.0, 1.0), "weight").count() == 0


def test_cell_sums_over_batches_and_trees(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(S, "TREE_POINTS", 64)
    monkeypatch.setattr(S, "TREE_PAIRS", 16)
    rnd, rows, want = np.random.default_rng(6), [], {}
    for c in range(3):
        lo = rnd.uniform(0, 5, (30, 3))
        hi, p = lo + rnd.choice([0.5, 3.0, 9.0], (30, 3)), np.column_stack([rnd.integers(0, 6, (200, 3)), np.ones((200, 2)), rnd.integers(1, 9, 200)]).astype(float)
        rows += [(0, c, 0, 0, 0, 0, 0, *l, *h) for l, h in zip(lo, hi)] + [(0, c, 0, 0, 0, 0, 1, *x) for x in p]
        held = ((p[None, :, :3] >= lo[:, None]) & (p[None, :, :3] <= hi[:, None])).all(2)
        want |= {(*l, *h): (n, n, w) for l, h, (n, _, w) in zip(lo, hi, held @ p[:, 3:]) if n}
    batches = [pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows[i : i + 37])], names=[f"c{k}" for k in range(13)]) for i in range(0, len(rows), 37)]
    got = {tuple(r.values())[:6]: tuple(r.values())[6:] for b in S._cell_sums(iter(batches)) for r in b.to_pylist()}
    assert got == want


def test_scoring(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (None, 0.5)], "y int, p double")
    a = C.roc_auc(d, F.col("y"), F.col("p")).first()
    assert a.auc == pytest.approx(3.5 / 4)
    assert C.roc_auc(d.filter("y = 1"), F.col("y"), F.col("p")).first().auc is None
    best = C.best_f1(C.confusion(d, F.col("y"), F.col("p"), [0.05, 0.3, 0.5])).first()
    assert (best.threshold, best.tp, best.fp) == (0.3, 2, 1)
    r = one(spark, m=C.mlp(lits(1, 2), [[1, 0], [0, 1]], [0, 0], [1, 1], 0.5), n=C.layer_norm(F.array(*lits(1, 3))), s=C.sigmoid(F.lit(1000.0)))
    assert r.m == pytest.approx(math.tanh(1) + math.tanh(2) + 0.5) and r.n == pytest.approx([-1, 1], abs=1e-4) and r.s < 1.0000001


NAMES = {" A/B/MODEL.OBJ\t": "model", "x\\Mesh_1": "mesh1", "macro-skill": "macroskill", "Macroskill": "macroskill", "mcts.jsonl": "mcts", "": "", None: None}


@pytest.mark.parametrize("raw", list(NAMES))
def test_name_keys(spark, raw):
    c = F.lit(raw).cast("string")
    r = one(spark, k=T.name_key(c), a=T.author_key(c), ok=T.is_success(c))
    assert r.k == NAMES[raw] and r.ok is False


def test_other_keys(spark):
    r = one(spark, a=T.author_key(F.lit("@The_Shop ")), n=T.author_key(F.lit(" N/A")), c=T.category_key(F.lit("ShapeNet Airplane ")), u=T.category_key(F.lit("unknown")), s=T.source_key(F.lit(" Opencue.example")), ms=T.epoch_seconds(F.lit(1.7e12)), z=T.epoch_seconds(F.lit(0.0)), ok=T.is_success(F.lit(" Succeeded")))
    assert (r.a, r.n, r.c, r.u, r.s, r.ms, r.z, r.ok) == ("theshop", None, "airplane", None, "opencue", 1.7e9, None, True)
