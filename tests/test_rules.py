"""Budgets, scores and ranks of rules."""

import hashlib

from pyspark.sql import functions as F

from meshquarry.operators import rules as R


def test_linear_gate(spark):
    d = spark.createDataFrame([(1.0,), (1000.0,), (None,), (float("nan"),)], "x double")
    s = [r.s for r in d.select(R.linear_gate({"x": F.col("x")}, {"x": 2.0}, {"x": 0.0}, {"x": 0.5}).alias("s")).collect()]
    assert s == [-0.5, 5.0, -1.0, -1.0]
    b = spark.createDataFrame([(0.1,), (0.2,)], "s double").select(R.gate_budget(F.col("s"), F.lit(0.2), 1, 5).alias("b"))
    assert [r.b for r in b.collect()] == [1, 5]


def test_program_and_repeats(spark):
    d = spark.createDataFrame([(0.1, 0.0, "recenter_then_shrink", "x", 5), (0.1, 0.0, "recenter_then_shrink", "x", 4), (None, -3.0, "shrink_slack_face", "table", 0)], "d double, n double, f string, c string, l int")
    assert [round(r.s, 9) for r in d.select(R.program_score(*(F.col(x) for x in "dnfcl")).alias("s")).collect()] == [0.75, 0.1, 0.15]
    e = spark.createDataFrame([("recenter", 4, 9, "score_stalls"), ("x", 4, 9, "a|score_stalls"), ("x", 4, 9, "fixed"), ("x", None, None, None), ("x", 7, 3, "coverage_recovered"), ("x", 99, 3, "")], "o string, n int, m int, u string")
    for median, want in ((False, [1, 9, 4, 1, 7, 12]), (True, [1, 4, 4, 1, 7, 12])):
        assert [r.b for r in e.select(R.repeat_budget(*(F.col(x) for x in "onmu"), 12, median).alias("b")).collect()] == want


def test_memory_portfolio_bucket(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x")], "c string, p string")
    t = {"c": (spark.createDataFrame([("a", 2.0)], "c string, score double"), ["c"]), "p": (spark.createDataFrame([("x", 1.0)], "p string, score double"), ["p"])}
    got = {(r.c, r.p): r.memory_score for r in R.memory_score(d, t, {"c": 1.0, "p": -0.5, "q": 0.0}, 0.3).collect()}
    assert got[("a", "x")] == 1.0 and abs(got[("b", "y")] - 0.1) < 1e-12 and abs(got[(None, "x")] + 0.2 / 1.5) < 1e-12
    p = spark.createDataFrame([("c", "k1", 1.0, 2), ("c", "k2", 1.0, 3), ("c", "k3", None, 9)], "c string, k string, d double, n int")
    assert [r.k for r in R.portfolio_rank(p, "c", "k", "d", "n").orderBy("rank").collect()] == ["k2", "k1", "k3"]
    b = spark.createDataFrame([("é",), (None,), ("é",)], "n string").select(R.stable_bucket(F.col("n"), 64).alias("b")).collect()
    want = int.from_bytes(hashlib.blake2b("é".encode(), digest_size=8).digest(), "little") % 64
    assert [r.b for r in b] == [want, None, want]
