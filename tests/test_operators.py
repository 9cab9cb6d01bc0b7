"""Operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.operators import drift as D
from meshquarry.operators import refine as R
from meshquarry.operators import loops as L
from meshquarry.operators import manifest as M
from meshquarry.operators import selection as S
from meshquarry.operators import traces as T
from meshquarry.operators.ranking import row_numbers
from meshquarry.plans import procedures as P

BOX = "mesh long, bbox_idx int, w double, " + ", ".join(f"{c} double" for c in B.BOUNDS)


def iou(a, b):
    cut = [max(0, min(a[i + 3], b[i + 3]) - max(a[i], b[i])) for i in range(3)]
    va, vb = (math.prod(x[i + 3] - x[i] for i in range(3)) for x in (a, b))
    i = math.prod(cut)
    return i / (va + vb - i)


def test_suppression_is_sequential(spark):
    rnd = random.Random(1)
    rows = []
    for mesh in range(3):
        for i in range(12):
            lo = [rnd.uniform(0, 2) for _ in range(3)]
            rows.append((mesh, i, float(rnd.randint(0, 3)), *lo, *(x + rnd.uniform(1, 2) for x in lo)))
    want = set()
    for mesh in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == mesh), key=lambda r: (-r[2], r[1])):
            if all(iou(r[3:], k[3:]) <= 0.2 for k in kept):
                kept.append(r)
        want |= {(mesh, r[1]) for r in kept}
    got = L.suppress(spark.createDataFrame(rows, BOX), "mesh", "bbox_idx", F.col("w"), 0.2)
    assert {(r.mesh, r.bbox_idx) for r in got.collect()} == want
    assert L.suppress(spark.createDataFrame([], BOX), "mesh", "bbox_idx", F.col("w"), 0.2).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 5, 4), (1, 4, 9), (1, 7, 8), (2, 1, 2), (2, 2, 1)] + [(3, i, i + 1) for i in range(40)], "mesh long, src long, dst long")
    got = {(r.mesh, r.v): r.component for r in L.components(e, "mesh").collect()}
    assert got[1, 9] == 4 and got[1, 8] == 7 and got[2, 2] == 1 and {got[3, i] for i in range(41)} == {0}


def greedy_reference(parts, adj, shape, eps):
    parts, adj, into = dict(parts), set(adj), {p: p for p in parts}
    vol = lambda b: math.prod(max(0.0, b[i + 3] - b[i]) for i in range(3))
    while True:
        bvs = sum(map(vol, parts.values())) / shape
        best = None
        for l, r in sorted(adj):
            u = [min(x, y) for x, y in zip(parts[l][:3], parts[r][:3])] + [max(x, y) for x, y in zip(parts[l][3:], parts[r][3:])]
            delta = (vol(u) - vol(parts[l]) - vol(parts[r])) / shape
            key = (round(abs(delta - (1 - bvs)), 9), l, r)
            if best is None or key < best[0]:
                best = (key, l, r, u, -abs(bvs + delta - 1) + abs(bvs - 1))
        if best is None or best[4] <= -abs(eps):
            return into
        _, l, r, u, _ = best
        parts[l] = u
        del parts[r]
        adj = {tuple(sorted((l if x == r else x, l if y == r else y))) for x, y in adj}
        adj = {(x, y) for x, y in adj if x != y}
        into = {p: l if q == r else q for p, q in into.items()}


def test_greedy_merge(spark):
    rnd = random.Random(2)
    rows, adj, shapes, want = [], [], [], {}
    for mesh in range(3):
        parts = {}
        for p in range(6):
            lo = [rnd.uniform(0, 3) for _ in range(3)]
            parts[p] = lo + [x + rnd.uniform(0.5, 2) for x in lo]
            rows.append((mesh, p, *parts[p]))
        pairs = {(a, b) for a in range(6) for b in range(a + 1, 6) if rnd.random() < 0.6}
        adj += [(mesh, a, b) for a, b in pairs]
        shapes.append((mesh, 9.0))
        want |= {(mesh, p): q for p, q in greedy_reference(parts, pairs, 9.0, 0.05).items()}
    p = spark.createDataFrame(rows, "mesh long, pid long, " + ", ".join(f"{c} double" for c in B.BOUNDS))
    got = L.greedy_merge(p, spark.createDataFrame(adj, "mesh long, l long, r long"), "mesh", "pid", spark.createDataFrame(shapes, "mesh long, shape double"), eps=0.05)
    assert {(r.mesh, r.pid): r.into for r in got.collect()} == want and any(k[1] != v for k, v in want.items())


def test_refine_never_worse(spark):
    p = spark.createDataFrame([(1, float(x), float(y), 0.5, 1.0) for x in range(4) for y in range(3)], "mesh long, x double, y double, z double, weight double")
    b = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0, 2.0, 2.0, 1.0)], BOX)
    r = R.greedy_refine(p, b, "mesh", F.lit(6.0), 2, 1.0, 5).first()
    assert r.max_x == 3.0 and r.score == pytest.approx(0.0) and r.steps == 1
    s = R.greedy_refine(p, b, "mesh", F.lit(6.0), 2, 1.0, 5, stop="bound").first()
    assert s.score <= r.score


def test_refine_bound_counts_the_missing_coverage(spark):
    # a box four times too large that covers little: full coverage without an edit would gain 0.45 * penalty, an edit gains more
    p = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.55), (1, 4.5, 0.5, 0.5, 0.45)], "mesh long, x double, y double, z double, weight double")
    b = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0, 4.0, 1.0, 1.0)], BOX)
    for together in (0, 100):
        r = R.greedy_refine(p, b, "mesh", F.lit(1.0), 2, 1.0, 1, penalty=1.0, stop="bound", together=together).first()
        assert r.steps == 1 and r.max_x == 3.0 and r.score == pytest.approx(-2.45)


@pytest.mark.parametrize("how", [{}, {"steps": 3}, {"stop": "bound"}, {"masked": True}, {"masked": True, "steps": 2}])
def test_small_and_large_meshes_are_refined_alike(spark, how):
    rnd = random.Random(5)
    pts = [(m, *(rnd.randint(0, 9) / 2 for _ in range(3)), rnd.randint(0, 3) / 2) for m in range(6) for _ in range(rnd.randint(1, 40))]
    boxes = []
    for m in range(6):
        for k in (0, 2, 3)[: rnd.randint(1, 3)]:
            lo = [rnd.randint(0, 4) / 2 for _ in range(3)]
            boxes.append((m, k, 1.0, *lo, *(x + rnd.randint(1, 5) / 2 for x in lo)))
    p, b = spark.createDataFrame(pts, "mesh long, x double, y double, z double, weight double"), spark.createDataFrame(boxes, BOX)
    got = [sorted((r.mesh, r.bbox_idx, *(round(r[c], 6) for c in B.BOUNDS), round(r.score, 6), r.steps, r.open) for r in R.greedy_refine(p, b, "mesh", F.lit(9.0), 2, 0.5, together=t, penalty=4.0, **how).collect()) for t in (1000, 0)]
    assert got[0] == got[1] and len(got[0]) == len(boxes) and (how.get("stop") == "bound" or any(r[9] for r in got[0]))


def test_recentred(spark):
    rnd = np.random.default_rng(1)
    a = 0.4
    turn = np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]])
    x = (rnd.uniform(-1, 1, (400, 3)) * [3, 1, 0.3]) @ turn + [5, 5, 5]
    p = spark.createDataFrame([(1, *map(float, r), *map(float, r)) for r in x] + [(2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "mesh long, x double, y double, z double, in_x double, in_y double, in_z double")
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    b = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0, 10.0, 9.0, 8.0, eye), (2, 0, 1.0, -1.0, -1.0, -1.0, 1.0, 1.0, 1.0, eye)], BOX + ", rotation array<double>")
    r = {r.mesh: r for r in R.recentred(p, b, "mesh").collect()}
    f = np.reshape(r[1].rotation, (3, 3))
    mid = [(r[1][lo] + r[1][hi]) / 2 for lo, hi in zip(B.LOWS, B.HIGHS)]
    assert abs(f[0] @ turn[0]) > 0.999 and np.linalg.det(f) == pytest.approx(1) and r[1].moved and not r[2].moved
    assert f.T @ mid == pytest.approx([5, 5, 5], abs=0.1) and [round(r[1][hi] - r[1][lo], 9) for lo, hi in zip(B.LOWS, B.HIGHS)] == [10, 9, 8]


def test_principal_frames(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(50, 3)) * [3, 1, 0.2]
    p = spark.createDataFrame([(1, *map(float, r), 1.0) for r in x] + [(2, 1.0, 1.0, 1.0, 1.0)], "mesh long, x double, y double, z double, weight double")
    got = {r.mesh: r for r in L.principal_frames(p, ["mesh"]).collect()}
    val = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert got[1].variances == pytest.approx(val) and np.linalg.det(np.reshape(got[1].frame, (3, 3))) == pytest.approx(1)
    assert got[2].variances == [0, 0, 0]


def test_latest_and_ties(spark):
    d = spark.createDataFrame([("a", 1.0, 1, "x"), ("a", 1.0, 2, "y"), ("b", None, 3, "z"), (None, 5.0, 4, "n"), (None, 4.0, 5, "m")], "k string, at double, seq int, v string")
    got = {r.k: r.v for r in M.latest(d, ["k"], [F.col("at"), F.col("seq")]).collect()}
    assert got == {"a": "y", "b": "z", None: "n"}


def test_row_numbers_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 7919 % 1000, i) for i in range(600)] + [(None, 1, 9999)]
    got = row_numbers(spark.createDataFrame(rows, "g string, o int, i int"), ["g"], [F.col("o"), F.col("i")]).collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2]))
    want = {(g, i): k + 1 for g, v in by.items() for k, (_, i) in enumerate(sorted(v))}
    assert {(r.g, r.i): r.rn for r in got} == want


def test_guarded_choice(spark):
    m = {"bvs": (False, 0.01), "covered": (True, 0.01)}
    rows = [("c", "base", 2.0, 0.9), ("c", "good", 1.5, 0.9), ("c", "bad", 1.0, 0.5), ("d", "base", 1.0, 0.9), ("d", "same", 1.0, 0.9), ("e", "only", 1.0, None)]
    got = {r.k: r.chosen for r in S.guarded_choice(spark.createDataFrame(rows, "k string, label string, bvs double, covered double"), ["k"], "label", "base", m).collect()}
    assert got == {"c": "good", "d": "base", "e": "only"}


def test_priority_draws(spark):
    d = spark.createDataFrame([(i, float(i % 5)) for i in range(100)], "id long, p double")
    r = T.priority_draws(d, "id", F.col("p"), 400, 0.5).collect()
    assert len(r) == 400 and all(x.id % 5 for x in r) and max(x.weight for x in r) == pytest.approx(1)
    four = sum(x.id % 5 == 4 for x in r)
    assert four == pytest.approx(160, abs=20)


def test_prior_fills_the_grid(spark):
    d = spark.createDataFrame([(0, 1, 4.0), (0, 1, 1.0), (6, 0, -3.0)], "coord int, scale int, reward double")
    p = T.smoothed_prior(d, T.key_grid(d, F.greatest(F.max("scale") + 1, F.lit(2))), F.col("reward"), 0.0, 0.5, 1.0).collect()
    by = {(r.coord, r.scale): math.exp(r.log_prior) for r in p}
    assert len(p) == 13 and sum(by.values()) == pytest.approx(1) and by[0, 1] == pytest.approx(4 / 16)


# --- drift ---


def lines(spark, files):
    rows, i = [], 0
    for t, (name, payloads) in enumerate(files):
        for k, p in enumerate(payloads):
            i += 1
            rows.append((i, name, 1000.0 * t + k, k + 1, p if p is None or isinstance(p, str) else json.dumps(p)))
    d = spark.createDataFrame(rows, "line_id long, trace_file string, t double, line_no int, payload string")
    return d.withColumn("written_at", F.timestamp_seconds("t"))


def changes(spark, files):
    return sorted((r.trace_file, r.field_name, r.change_kind) for r in D.schema_changes(lines(spark, files)).collect())


def test_drift_kinds(spark):
    base = [{"step": i, "num_action_scale": 2, "reward_backend": "proxy", "pen_rate": 0.5} for i in range(20)]
    two = [{"step": i, "scales": 4, "reward_backend": i, "max_step": 9} for i in range(20)]
    three = [{"step": None, "scales": None, "reward_backend": i, "max_step": 9, "odd": 1} if i == 3 else {"step": 1, "scales": None, "reward_backend": i, "max_step": 9} for i in range(20)]
    four = [{"step": "a", "scales": 2.5, "max_step": [9]} for i in range(20)] + ['{"step": 1', "", None, '{"reward": NaN, "step": "b", "scales": 1, "max_step": [1]}']
    got = changes(spark, [("trace_w1_a.jsonl", base), ("trace_w2_a.jsonl", two), ("trace_w1_b.jsonl", two), ("trace_w1_c.jsonl", three), ("trace_w1_d.jsonl", four)])
    assert got == [
        ("trace_w1_b.jsonl", "max_step", "added"), ("trace_w1_b.jsonl", "pen_rate", "removed"), ("trace_w1_b.jsonl", "reward_backend", "retyped"), ("trace_w1_b.jsonl", "scales", "renamed"),
        ("trace_w1_d.jsonl", "max_step", "retyped"), ("trace_w1_d.jsonl", "reward_backend", "removed"), ("trace_w1_d.jsonl", "step", "retyped"),
    ]


def test_type_is_kept_through_nulls_and_renames(spark):
    f = lambda n, v: [{"step": 1, n: v}] * 4
    got = changes(spark, [("trace_w_a.jsonl", f("reward_backend", "x")), ("trace_w_b.jsonl", f("backend", None)), ("trace_w_c.jsonl", f("backend", None)), ("trace_w_d.jsonl", f("backend", 1)), ("trace_w_e.jsonl", f("backend", 2.5))])
    assert got == [("trace_w_b.jsonl", "backend", "renamed"), ("trace_w_d.jsonl", "backend", "retyped")]


def test_drift_empty(spark):
    assert changes(spark, [("trace_w1_a.jsonl", ["", "{", None])]) == []
    assert D.schema_changes(lines(spark, [("x", ["{}"])]).limit(0)).count() == 0


ALIASES = [["num_action_scale", "scales", "n_action_scales", "action_scale_count", "numActionScale"], ["manifold_volume_method", "vol_method", "volume_method", "mvMethod"], ["reward_backend", "rewardBackend", "reward_engine", "backend"]]
OTHERS = ["max_step", "pen_rate", "trace_seed", "candidate_backend", "branch_group", "selected"]


def test_flooding_separates_meanings():
    f = lambda n, v=None: {"name": n, "type": "number", "keys": None, "values": v}
    for k, g in enumerate(ALIASES):
        for a in g:
            for b in g:
                if a != b:
                    # no list says that an engine is a backend: two names without a common word need common values
                    if {a, b} != {"reward_engine", "backend"}:
                        assert D.correspondences([f(a)], [f(b)]) == [(a, b)], (a, b)
                    assert D.correspondences([f(a, [f"v{k}", "w"])], [f(b, [f"v{k}", "w"])]) == [(a, b)], (a, b)
            for b in [x for h in ALIASES if h is not g for x in h] + [o for o in OTHERS if o != "candidate_backend"]:
                assert D.correspondences([f(a)], [f(b)]) == [], (a, b)
                assert D.correspondences([f(a, ["x"])], [f(b, ["y"])]) == [], (a, b)


def test_flooding_spreads_through_words_and_nesting():
    f = lambda n, v=None, k=None: {"name": n, "type": "object", "keys": k, "values": v}
    # one pair of fields with common values lends likeness to another through the words both names hold
    some = lambda v: D.flood([f("reward_backend", v), f("backend")], [f("reward_engine", v), f("engine")], [])
    assert some(["p", "q"])[1, 1] > some(None)[1, 1]
    assert D.correspondences([f("alpha", k=["lo", "hi"])], [f("omega", k=["lo", "hi"])]) == [("alpha", "omega")]
    # a word in many kept names says little
    many = [f(f"step_{c}") for c in "abcdefgh"]
    assert D.flood([f("step_x")], [f("step_y")], many)[0, 0] < D.flood([f("step_x")], [f("step_y")], [])[0, 0]


def test_long_rename_chain_has_one_name(spark):
    names = [f"field{i:02d}" for i in range(20)] + ["reward_backend"]
    rows = [(a, b, "renamed") for a, b in zip(names, names[1:])] + [("other", "another", "renamed"), ("x", "y", "added")]
    got = {r.name: r.canonical for r in D.canonical_names(spark.createDataFrame(rows, "old_name string, field_name string, change_kind string")).collect()}
    assert {got[n] for n in names} == {"reward_backend"} and got["another"] == got["other"] == "other" and "x" not in got


def test_nested_names_and_long_values(spark):
    deep = {"a": {"b": [{"c": 1}]}, "d": 2}
    got = {f.name: f for f in D.file_fields(lines(spark, [("trace_w_a.jsonl", [{"o": deep, "s": "x" * 200}, {"o": {"e": None}}])])).first().fields}
    assert sorted(got["o"]["keys"]) == ["a", "b", "c", "d", "e"] and len(got["s"]["values"]) == 2 and got["s"]["type"] == "string"


def test_consistent_table(spark):
    a = [{"step": 1, "num_action_scale": 2, "reward": 0.5, "extra": 1}] * 5
    b = [{"step": 2, "scales": 4, "reward": 1}] * 5 + ['{"step": 3, "scales": 6, "reward": NaN}']
    t = D.consistent_table(lines(spark, [("trace_w1_a.jsonl", a), ("trace_w1_b.jsonl", b)])).orderBy("line_id").collect()
    assert [r.num_action_scale for r in t] == [2] * 5 + [4] * 5 + [6] and t[0].rest == '{"extra":"1"}' and math.isnan(t[10].reward)


def test_reward_pairs_of_all_positives(spark):
    rnd = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, float(rnd.randint(-6, 6))) for i in range(120)]
    all_ = [(g, a, b, x - y) for g, a, x in rows if x > 0 for h, b, y in rows if g == h and y <= 0]
    d = spark.createDataFrame(rows, "g string, id long, t double")
    for k in (1, 7, 200, 100_000):
        want = sorted(all_, key=lambda r: (-r[3], r[1], r[2]))[:k]
        got = [(r.g, r.hi, r.lo, r.gap) for r in T.reward_pairs(d, "g", "id", "t", k).collect()]
        assert sorted(got) == sorted(want)


def test_box_refinement_until_none_gains(spark, tmp_path):
    item = lambda m, x, y, z, st: (m, "A", float(x), y * 1000.0, z / 100, st)
    rows = [item(m, x, y, z, "F") for m in (1, 2) for x, y, z in [(10, 0, 0), (20, 2, 2), (10, 2, 0), (20, 0, 2)]] + [item(1, 20 + i, 2 * (i % 2), 2 * (i // 2 % 2), "O") for i in range(1, 7)]
    spark.createDataFrame(rows, "l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.mesh: (r.min_x, r.max_x, r.max_y, r.max_z, r.steps) for r in P.box_refinement(spark, str(tmp_path)).collect()}
    assert got == {1: (10.0, 26.0, 2.0, 2.0, 6), 2: (10.0, 20.0, 2.0, 2.0, 0)}
