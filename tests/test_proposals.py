"""Matching, excess, initial boxes, samples, first segmentation."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.operators import proposals as P

BOX = ", ".join(f"{c} double" for c in B.BOUNDS)


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 4), (5, 3), (4, 4)])
def test_least_assignment(shape):
    rnd = np.random.default_rng(sum(shape))
    for _ in range(20):
        c = rnd.integers(0, 9, shape).astype(float)
        got = P.least_assignment(c)
        small, big = sorted(shape)
        m = c if shape[0] <= shape[1] else c.T
        want = min(sum(m[i, j] for i, j in enumerate(p)) for p in permutations(range(big), small))
        assert len(got) == small and sum(c[r, k] for r, k in got) == want and len({r for r, _ in got}) == len({k for _, k in got}) == small


def test_assignment_of_sets(spark):
    rows = [("a", 0, 5, 1.0), ("a", 0, 6, 2.0), ("a", 1, 5, 1.0), ("a", 1, 6, 9.0), (None, 3, 3, 4.0), ("gap", 0, 0, 1.0), ("gap", 1, 0, 0.5)]
    d = spark.createDataFrame(rows, "k string, l long, r long, c double").withColumn("p", F.lit(1))
    got = sorted((str(x.k), x.l, x.r) for x in P.optimal_assignment(d, "k", "l", "r", "c").collect())
    assert got == [("None", 3, 3), ("a", 0, 6), ("a", 1, 5), ("gap", 1, 0)]
    assert P.optimal_assignment(d.limit(0), "k", "l", "r", "c").count() == 0


def test_excess_matrix(spark):
    solid = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 0.5, 0.0, 0.0, 2.0, 1.0, 1.0)], "m long, " + BOX)
    parts = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0), (1, 1, 3.0, 0.0, 0.0, 4.0, 1.0, 1.0, 1.0), (2, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.5), (2, 1, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0)], "m long, i long, " + BOX + ", volume double")
    got = {(r.m, r.i, r.j): round(r.value, 6) for r in P.excess_matrix(parts, solid, "m", "i").collect()}
    assert got == {(1, 0, 0): 0.0, (1, 1, 1): -1.0, (1, 0, 1): 0.0, (1, 1, 0): 0.0, (2, 0, 0): -2.0}


def test_top_boxes(spark):
    b = spark.createDataFrame([("m", 0.0, 0.0, 0.0, float(k), 1.0, 1.0) for k in (1, 3, 2, 3)], "m string, " + BOX)
    r = P.top_boxes(b, F.col("m"), 3).first()
    assert [x.volume for x in r.boxes] == [3, 3, 2] and len(r.boxes[0].corners) == 24 and P.top_boxes(b.limit(0), F.col("m")).count() == 0


def test_drawn_boxes_and_points(spark):
    d = spark.range(2000).withColumnRenamed("id", "k")
    b = P.random_boxes(d, "k", 2)
    x = np.array([[r[c] for c in B.BOUNDS] for r in b.collect()])
    assert (x[:, :3] <= x[:, 3:]).all() and abs(np.concatenate((x[:, :3], x[:, 3:])).std() - 0.3) < 0.01 and b.exceptAll(P.random_boxes(d.repartition(7), "k", 2)).count() == 0
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4.0, 2.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "k long, " + BOX)
    p = np.array([(r.x, r.y, r.z) for r in P.surface_points(box, ["k"], 8000).collect()])
    at = (np.isin(p, [0]) | (p == [4, 2, 1])).any(1)
    z = np.isin(p[:, 2], [0, 1]).mean()
    assert len(p) == 8000 and at.all() and abs(z - 8 / 14) < 0.02 and (p <= [4, 2, 1]).all() and (p >= 0).all()


def test_padding(spark):
    d = spark.createDataFrame([([[1.0, 2.0]],), ([],), ([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]],)], "r array<array<double>>")
    assert [r.p for r in d.select(P.padded(F.col("r"), 2, 2).alias("p")).collect()] == [[1, 2, 0, 0], [0, 0, 0, 0], [1, 2, 3, 4]]
    assert spark.range(3).select(P.one_hot(F.col("id") + 1, 3).alias("o")).collect()[2].o == [0, 0, 0]


def test_presegment(spark):
    """Against the same steps on dictionaries."""
    rnd = random.Random(6)
    tets, edges = [], set()
    for m in range(4):
        for t in range(40):
            lo = [rnd.randint(0, 3) * 1.0 for _ in range(3)]
            tets.append((m, t, rnd.choice(["a", "a", "b", "", None]), rnd.choice([0.001, 1.0]), *lo, *(x + rnd.randint(0, 2) for x in lo)))
        edges |= {(m, a, b) for a, b in ((rnd.randrange(40), rnd.randrange(40)) for _ in range(60)) if a != b}
    edges |= {(m, b, a) for m, a, b in edges}
    want = {}
    for m in range(4):
        own = {t[1]: t for t in tets if t[0] == m}
        near = {a: {y for k, x, y in edges if k == m and x == a} for a in own}

        def flood(free, ok):
            out, left = {}, set(free)
            while left:
                a = min(left)
                todo, seen = [a], {a}
                while todo:
                    x = todo.pop()
                    for y in near[x]:
                        if y in left and y not in seen and ok(x, y):
                            seen.add(y)
                            todo.append(y)
                out |= dict.fromkeys(seen, a)
                left -= seen
            return out

        piece = flood([t for t in own if own[t][2]], lambda x, y: own[x][2] == own[y][2])
        size = {}
        for t, p in piece.items():
            size[p] = size.get(p, 0) + own[t][3]
        every = sum(t[3] for t in own.values())
        piece = {t: p for t, p in piece.items() if size[p] >= P.LEAST_PIECE * every}
        vol = lambda b: np.prod(np.maximum(np.array(b[3:]) - b[:3], 0))
        while True:
            box = {}
            for t, p in piece.items():
                b = own[t][4:]
                o = box.get(p, (*b,))
                box[p] = (*map(min, o[:3], b[:3]), *map(max, o[3:], b[3:]))
            new = {}
            for t in own:
                if t not in piece:
                    for p in sorted({piece[y] for y in near[t] if y in piece}):
                        b = own[t][4:]
                        g = (*map(min, box[p][:3], b[:3]), *map(max, box[p][3:], b[3:]))
                        if abs(vol(g) - vol(box[p])) <= P.SAME_BOX:
                            new[t] = p
                            break
            if not new:
                break
            piece |= new
        piece |= flood([t for t in own if t not in piece], lambda x, y: True)
        least = {}
        for t, p in piece.items():
            least[p] = min(least.get(p, t), t)
        want |= {(m, t): least[p] for t, p in piece.items()}
    d = spark.createDataFrame(tets, "m long, tet_id long, label string, volume double, " + BOX)
    e = spark.createDataFrame(sorted(edges), "m long, src long, dst long")
    assert {(r.m, r.tet_id): r.piece for r in P.presegment(d, e, "m").collect()} == want
