"""Bounds that prune, learned order, cuts of folds."""

import random

from pyspark.sql import functions as F

from meshquarry.operators import scoring as C
from meshquarry.operators import selection as S


def test_bounded_best(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 4}", i, rnd.randint(0, 50) / 2, rnd.randint(0, 4)) for i in range(300)] + [(None, 999, 1.0, 0)]
    d = spark.createDataFrame(rows, "g string, k long, e double, slack int").withColumn("checked", F.lit("x"))
    got = {r.g: r for r in S.bounded_best(d, ["g"], F.col("e") + F.col("slack"), F.col("e"), "k", 3).collect()}
    for g in {r[0] for r in rows}:
        own = [(e, -k, e + s, k) for h, k, e, s in rows if h == g]
        first = sorted(own, key=lambda r: (-r[2], r[3]))[:3]
        found = max(r[0] for r in first)
        done = sum(r in first or r[2] > found for r in own)
        if g is not None:  # a null group has no equal, so it is left out
            assert (got[g].exact, -got[g].k) == max(own)[:2] and got[g].checked == done and got[g].skipped == len(own) - done
    assert S.bounded_best(d.limit(0), ["g"], F.col("e"), F.col("e"), "k", 3).count() == 0


def test_learned_order(spark):
    d = spark.createDataFrame([("g", 1, 2.0, 0), ("g", 2, None, 1), ("g", 3, float("nan"), 2), ("h", 4, None, 0)], "g string, k long, s double, r int")
    got = {r.k: r.value for r in S.learned_order(d, ["g"], "s", F.lit(0.5), F.col("r")).collect()}
    assert got[1] > got[2] > got[3] > 2.0 and abs(got[4] - 5e-10) < 1e-11


def test_fold_thresholds(spark):
    rows = [("a", 1, 1.0), ("a", 0, 3.0), ("b", 1, 4.0), ("b", 0, 0.0), ("c", 1, 9.0), (None, 1, 1.0), ("c", None, 1.0), ("c", 1, float("nan"))]
    got = {r.f: (r.held_out, r.threshold, r.accuracy) for r in C.fold_thresholds(spark.createDataFrame(rows, "f string, y int, x double"), "f", F.col("y"), F.col("x")).collect()}
    assert got == {"a": (2, 3.25, 0.5), "b": (2, 4.0, 1.0), "c": (1, 2.0, 1.0)}
    one = C.fold_thresholds(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "f string, y int, x double"), "f", F.col("y"), F.col("x")).collect()
    assert all(r.threshold is None and r.accuracy == 1.0 and r.mean_label == 1.0 for r in one)
