"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquarry.llm import components as CO
from meshquarry.llm import cutoffs as CU
from meshquarry.llm import leaks as LE
from meshquarry.llm import mixture as MI
from meshquarry.llm import percentiles as PE
from meshquarry.llm import quota_sample as QS
from meshquarry.llm import stuffing as ST
from meshquarry.llm import survivors as SU
from meshquarry.llm import subtitles as SB
from meshquarry.llm import thresholds as TH

STAGE = "record_id long, stage string, category string, mesh_id string, status string, started_at double, finished_at double, output_path string, log_path string, command array<string>, error string, metadata string, survivor int, w double"


def stage(spark, rows):
    return spark.createDataFrame([(i, s, "c", m, st, None, at, out, None, None, None, None, 1, 1.0) for i, s, m, st, at, out in rows], STAGE)


# --- 1: survivors ---


def test_survivors(spark):
    rows = [
        (1, "Merge", "x/A.obj", "failed", 2e9, None), (2, "merge.jsonl", "a", " SUCCEEDED", 1.5e9, "p"), (3, "MERGE", "A ", "ok", 1.6e12, "q"), (4, "merge", "a", "success", 0.0, "q"),
        (5, "merge", "a_v2", "failed", None, None), (6, "merge", "a_v2", None, None, None), (7, None, None, None, None, None), (8, "m", "b", "ok", 1e9, None), (9, "m", "b", "ok", 1e9, "z"),
    ]
    got = {(r.stage_key, r.mesh_key): r for r in SU.stage_survivors(stage(spark, rows)).collect()}
    assert got["merge", "a"].survivor == 3 and got["merge", "a"].output_path == "q" and got["merge", "a"].status == "success"
    assert got["merge", "av2"].survivor == 6 and got["", ""].survivor == 7 and got["m", "b"].survivor == 9
    assert sorted(r.record_id for r in SU.superseded(stage(spark, rows)).collect()) == [1, 2, 4, 5, 8]


def test_survivors_hot_group_and_empty(spark):
    rnd = random.Random(3)
    rows = [(i, "s", "hot" if i % 2 else f"m{i % 50}", rnd.choice(["ok", "failed", None]), rnd.choice([None, 0.0, 1e9, 2e9]), None) for i in range(500)]
    by = {}
    for i, _, m, st, at, _ in rows:
        by.setdefault(m, []).append(((st == "ok"), at or -1, i))
    want = sorted(i for v in by.values() for _, _, i in sorted(v)[:-1])
    assert sorted(r.record_id for r in SU.superseded(stage(spark, rows)).collect()) == want
    assert SU.superseded(stage(spark, rows).limit(0)).count() == 0


def test_survivors_keep_all_fields(spark):
    rows = [
        (1, "Merge", "c", "x/A.obj", "failed", 1e9, 1.6e9, None, None, ["m", "1"], "boom", None, 1, 1.0),
        (2, "merge", "c", "a", "ok", 1.5e12, 1.6e9, None, None, ["m", None, "2"], None, None, 1, 1.0),
        (3, "merge", "c", "A", "ok", None, 1.61e9, None, None, None, None, None, 1, 1.0),
        (4, "merge", "c", "b", "failed", 1e9, 1.6e9, None, None, [], "first", None, 1, 1.0), (5, "merge", "c", "b", "failed", 0.0, 1.7e9, None, None, None, None, None, 1, 1.0),
        (6, None, "c", None, None, None, None, None, None, None, None, None, 1, 1.0),
    ]
    out = SU.stage_survivors(spark.createDataFrame(rows, STAGE))
    assert dict(out.dtypes)["command"] == "array<string>" and {c for c in STAGE.split() if c in ("stage", "mesh_id", "started_at", "command", "error", "metadata")} <= set(out.columns)
    got = {r.mesh_key: (r.survivor, r.stage, r.mesh_id, r.started_at, r.error, r.command) for r in out.collect()}
    assert got["a"] == (3, "merge", "A", 1.5e9, None, ["m", None, "2"])
    assert got["b"] == (5, "merge", "b", 1e9, "first", []) and got[""] == (6, None, None, None, None, None)


def test_votes_sum(spark):
    d = spark.createDataFrame([("k", "x", 1.0, 100.0, 1), ("k", "y", 0.6, 100.0, 2), ("k", "Y", 0.6, 90.0, 3), ("k", None, 9.0, 100.0, 4)], "k string, v string, t double, at double, i long")
    r = SU.vote(d, ["k"], [SU.Field("v", F.col("v"), F.lower("v"))], F.col("t"), F.col("at"), F.col("i")).first()
    assert r.v == "y"  # two weaker votes for one value beat a stronger one; its latest spelling survives


# --- 2: components and splits ---


def union_find(pairs, verts):
    up = {v: v for v in verts}

    def find(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in pairs:
        up[find(a)] = find(b)
    out = {}
    for v in verts:
        out.setdefault(find(v), set()).add(v)
    return {frozenset(s) for s in out.values() if len(s) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(5, 5)]
    e = spark.createDataFrame([*pairs, (None, 1)], "a long, b long")
    got = {}
    for r in CO.components(e).collect():
        got.setdefault(r.component, set()).add(r.v)
    assert {frozenset(s) for s in got.values()} == union_find(pairs, {x for p in pairs for x in p})
    assert CO.components(e.limit(0)).count() == 0


MESH = "mesh_no long, mesh_id string, category string, author string, derived_from string, vertex_count int"
EVAL = "eval_id long, mesh_id string, mesh_path string, surface_path string, bbox_path string, component int"


def related(spark):
    m = [(0, "aaa", None, "Foo Lab", None), (1, "bbb", None, "@foo_lab", None), (2, "aaa_v2", None, None, None), (3, "ccc", None, "n/a", "x/AAA.obj"), (4, "ddd", None, "N/A", "gone"), (5, "eee", None, None, None), (6, "fff", None, None, None), (7, "aaax", None, "", None), (8, "ggg", None, None, None), (9, "ggg-copy_q", None, None, None)]
    meshes = spark.createDataFrame([(*r, 1) for r in m], MESH)
    gates = spark.createDataFrame([(1, '["x\\\\DDD", "eee.obj"]'), (2, "fff + nowhere"), (3, None), (4, "fff|zzz;yyy")], "gate_id long, mesh_id string")
    evals = spark.createDataFrame([(1, "EEE ", "norm/c/eee/model.obj", None, "runs/m/fff/bbox.json", 0), (2, None, None, None, None, 0), (3, "qqq", None, None, "runs/m/ggg/bbox.json", 0), (1, "EEE ", "norm/c/eee/model.obj", None, "runs/m/fff/bbox.json", 0)], EVAL)
    return meshes, gates, evals


def test_related_meshes(spark):
    got = {(r.mesh_no_a, r.mesh_no_b) for r in CO.tied_pairs(CO.mesh_components(*related(spark))).collect()}
    want = {p for g in ([0, 1, 2, 3], [4, 5, 6], [8, 9]) for p in combinations(g, 2)}
    assert got == want


def test_splits(spark):
    m, g, e = related(spark)
    t = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1), (None, 1.0)], "split_name string, target_share double")
    s = CO.record_splits(m, g, e, t).collect()
    assert len(s) == 3 + 4 and len({r.group for r in s if r.kind == "gate" and r.record_id in (1, 2)}) == 1
    w = spark.createDataFrame([(f"c{i}", 1 + i % 3) for i in range(3000)] + [("hot", 600)], "component string, n long")
    a = {r.split: r.n for r in CO.assign_splits(w, [("train", 0.8), ("test", 0.1), ("validation", 0.1)]).groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert a["train"] / sum(a.values()) == pytest.approx(0.8, abs=0.1) and len(a) == 3


def test_hot_hub_is_split(spark):
    rows = spark.range(3000).select(F.col("id").alias("m"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    e = CO.hub_edges(rows, "m", "g")
    assert e.groupBy("b").count().agg(F.max("count")).first()[0] < 100
    assert CO.components(e).filter("v >= 0").groupBy("component").count().agg(F.max("count")).first()[0] == 1500


# --- 3: cutoffs ---


def test_cutoffs_against_sorting(spark):
    rnd = random.Random(5)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(9000)] + [("b", float(rnd.randint(0, 5))) for _ in range(7000)] + [("c", 1.0)] + [("d", 2.0)] * 10 + [("z", 1.0)]
    t = {"a": 0.1875, "b": 0.3, "c": 0.01, "d": 1.0, "e": 0.5, "z": 0.0}
    got = CU.quickselect(spark.createDataFrame(rows, "source string, score double").repartition(7), t)
    want = {}
    for s, f in t.items():
        v = sorted((x for k, x in rows if k == s), reverse=True)
        if v and f > 0:
            want[s] = next((c, sum(x >= c for x in v), len(v)) for c in sorted(set(v), reverse=True) if sum(x >= c for x in v) / len(v) >= f)
    assert got == want


def test_counted_states(spark):
    ts = lambda s: F.timestamp_seconds(F.lit(s))
    rows = [(1, "A", 5.0, 1), (1, "a", 2.0, 2), (2, "a", None, 3), (2, "a", 9.0, 1), (3, "a-", math.inf, 1), (4, " a", math.nan, 1), (5, "a", 1.0, 1), (5, "a", 1.0, 1), (None, "a", 1.0, 1), (6, None, 1.0, 1), (7, "other", 3.0, 1)]
    d = spark.createDataFrame(rows, "state_id long, source string, score double, t int").withColumn("scored_at", F.timestamp_seconds("t"))
    assert sorted((r.state_id, r.score) for r in CU.counted_states(d).collect()) == [(1, 2.0), (5, 1.0), (7, 3.0)]
    g = spark.createDataFrame([("a", 50.0, None), ("b", 1.0, None), ("c", None, None)], "source string, target_open_rate double, threshold double")
    assert [(r.state_id) for r in CU.kept_states(d, g).collect()] == [1]
    assert CU.kept_states(d.limit(0), g).count() == 0 and CU.kept_states(d, g.limit(0)).count() == 0


# --- 4: percentiles ---


def test_percentile_error_and_merge(spark):
    rnd = np.random.default_rng(0)
    v = np.concatenate([np.exp(rnd.normal(0, 4, 4000)), -np.exp(rnd.normal(0, 2, 1500)), np.zeros(300), [5e-324, 1.7e308, 1e-300]])
    rows = [("g", i % 7, float(x)) for i, x in enumerate(v)] + [("g", 0, math.nan), ("g", 1, math.inf), ("g", 2, None), (None, 3, 4.0)]
    d = spark.createDataFrame(rows, "g string, day int, x double")
    ps = (0.0, 0.05, 0.25, 0.28, 0.5, 0.9, 0.999, 1.0)
    whole = PE.percentiles(PE.histogram(d, ["g"], {"x": F.col("x")}), ["g"], ps).filter("g = 'g'").first()
    parts = PE.percentiles(PE.merge(PE.histogram(d, ["g", "day"], {"x": F.col("x")}), ["g"]), ["g"], ps).filter("g = 'g'").first()
    assert whole == parts and whole.n == len(v)
    s = np.sort(v)
    for p, got in zip(ps, whole[3:-1]):
        true = s[max(0, math.ceil(p * len(s)) - 1)]
        assert abs(got - true) <= 0.0100001 * abs(true) or (abs(true) < 1e-307 and abs(got) < 1e-307)
    assert PE.percentiles(PE.histogram(d.limit(0), ["g"], {"x": F.col("x")}), ["g"]).count() == 0


def test_evaluation_histogram_counts_records(spark):
    rows = [(1, "Chair", "s", 2.0, 5.0, 10, 20), (1, "chair", "s", 3.0, 6.0, 10, 30), (None, "chair", "S", 2.0, 5.0, 10, 20), (None, "chair", "s", 2.0, 5.0, 10, 20), (2, None, "", -1.0, -5.0, 90000, 1), (3, "chair", "s", math.nan, None, None, None)]
    d = spark.createDataFrame(rows, "eval_id long, category string, stage string, bvs double, elapsed_sec double, e int, i int").withColumn("evaluated_at", F.timestamp_seconds("e")).withColumn("ingested_at", F.timestamp_seconds("i")).withColumn("day", F.lit("x")).withColumn("n", F.lit(1))
    by = ["category", "stage", "day"]
    h = PE.evaluation_histogram(d)
    got = sorted((r.category, r.metric, round(r.v, 1), r.n) for r in h.select("*", PE.bucket_value(F.col("bucket")).alias("v")).collect())
    # the copy ingested last counts once, records without an id each, a bvs below 0 not at all
    assert got == [("chair", "bvs", 2.0, 2), ("chair", "bvs", 3.0, 1), ("chair", "elapsed_sec", 5.0, 2), ("chair", "elapsed_sec", 6.0, 1), ("unknown", "elapsed_sec", -5.0, 1)]
    key = lambda x: sorted(map(str, x.select("category", "stage", "day", "metric", "bucket", "n").collect()))
    packed = PE.pack(h, by)
    assert key(PE.unpack(packed, by)) == key(h) and packed.count() == 3 and PE.pack(h.limit(0), by).count() == 0


# --- 7: quota sample ---


def test_min_cost_flow():
    arcs = [(0, 1, 4, 1), (0, 2, 3, 2), (1, 3, 3, 0), (2, 3, 3, 0), (1, 2, 2, 0)]
    f = QS.min_cost_flow(arcs, 0, 3, 4)
    assert f[2] + f[3] == 6 and f[0] == 4 and f[1] == 2


def test_quotas():
    cells = {("a", "x"): 50, ("a", "y"): 50, ("b", "x"): 3, ("c", "y"): 9}
    q, short = QS.quotas(cells, {"a": 40, "b": 10, "c": 9, "d": 2})
    assert short == {"a": 0, "b": 7, "c": 0, "d": 2} and q["a", "x"] + q["a", "y"] == 40 and q["b", "x"] == 3 and q["c", "y"] == 9
    assert all(0 <= v <= cells[k] for k, v in q.items())


def test_sample(spark):
    rows = [(i, "ShapeNet chair" if i % 2 else "lamp", "s" if i % 3 else "t", "ok" if i % 5 else "failed") for i in range(600)] + [(1, "chair", "s", "Success")] * 3 + [(None, "chair", "s", "ok"), (9000, None, "s", "ok")]
    r = spark.createDataFrame(rows, "eval_id long, category string, stage string, status string").withColumn("w", F.lit(1)).withColumn("budget", F.lit(1))
    t = spark.createDataFrame([("shapenet_chair", 0.5, 1), ("shapenet_lamp", 0.4, 1), ("shapenet_sofa", 0.1, 2), ("shapenet_zither", 0.0, 0)], "category string, target_share double, min_rows int")
    rep = {x.category: x for x in QS.shortfalls(r, t).collect()}
    assert rep["shapenet_chair"].drawn == rep["shapenet_chair"].wanted == 60 and rep["shapenet_sofa"].short == 12 and rep["shapenet_zither"].short == 0
    s = QS.draw(r, t).collect()
    assert len(s) == len({x.eval_id for x in s}) == rep["shapenet_chair"].drawn + rep["shapenet_lamp"].drawn
    assert QS.draw(r.limit(0), t).count() == 0 and QS.shortfalls(r, t.limit(0)).count() == 0


# --- 8: leaks ---


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        w = SB.words(text)
        for i, p in items:
            q = SB.words(p)
            if any(sum(a != b for a, b in zip(w[x : x + 16], q[y : y + 16])) <= 3 for x in range(len(w) - 15) for y in range(len(q) - 15)):
                out.add((d, i))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ma", "to", "ri", "ké", "lü") for b in ("sen", "bal", "dor", "mi", "pra")]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(10, 40)))) for i in range(25)]
    docs = [(1000, None), (1001, ""), (1002, "a"), (1003, "\n".join(["word"] * 30000))]
    for d in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(5, 80))]
        if d % 2:
            p = rnd.choice(items)[1].split()
            n = rnd.randint(12, 20)
            at = rnd.randint(0, max(0, len(p) - n))
            cut = p[at : at + n]
            for k in rnd.sample(range(len(cut)), min(len(cut), rnd.randint(0, 5))):
                cut[k] = cut[k] + "x"
            w[3:3] = cut
        lines = [" ".join(w[k : k + 5]) for k in range(0, len(w), 5)]
        docs.append((d, "\n\n".join(f"{k + 1}\n00:00:0{k % 10},000 --> 00:00:0{k % 10},900\n<i>{x.upper()}</i>," for k, x in enumerate(lines))))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_brute_force(spark, seed):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    i = spark.createDataFrame([*items, (99, None), items[0]], "item_id long, passage string").withColumn("doc_id", F.lit(1))
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in LE.leaks(d, i).collect()} == want and len(want) > 10
    assert {(r.doc_id, r.item_id) for r in LE.leaks(d, i, block=7).collect()} == want
    assert LE.leaks(d.limit(0), i).count() == 0 and LE.leaks(d, i.limit(0)).count() == 0


def test_a_long_passage_among_many(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(5000)}" for _ in range(100_000)]
    items = [(0, " ".join(long))] + [(i, " ".join(f"p{i}x{k}" for k in range(18))) for i in range(1, 20_000)]
    docs = [(1, "x y " + " ".join(long[70_000:70_016])), (2, " ".join(long[50:65])), (3, " ".join(f"p777x{k}" for k in range(1, 17))), (4, " ".join(long[4080:4120]).replace(long[4090], "q"))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string").repartition(8)
    for block in (LE.BLOCK, 1000):
        assert {(r.doc_id, r.item_id) for r in LE.leaks(d, i, block).collect()} == {(1, 0), (3, 777), (4, 0)}


def test_letters_of_other_scripts_count(spark):
    a = "мама мыла раму утром рано пока папа спал дома один весь долгий зимний день без своих забот".split()
    b = ["".join(chr(ord("а") + (ord(c) * 7 + k) % 32) for c in w) for k, w in enumerate(a)]  # words of the same lengths
    items = spark.createDataFrame([(1, " ".join(a)), (2, "我们昨天在山上看到一只白色的小狐狸")], "item_id long, passage string")
    docs = spark.createDataFrame([(1, " ".join(a).upper()), (2, " ".join(b)), (3, "他说我们昨天在山上看到一只白色的小狐狸了"), (4, "你们今天在海边吃了三个红色的大苹果吧")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in LE.leaks(docs, items).collect()} == {(1, 1), (3, 2)}


def test_masks_lose_nothing():
    m = LE.masks()
    for bad in combinations(range(LE.RUN), LE.MISREAD):
        assert any(not set(x) & set(bad) for x in m)


def test_words_of_subtitles():
    t = "﻿WEBVTT\n\n1\n00:01:02.000 --> 00:01:03.500 align:start\nWRENNA: <i>It’s</i> <b>fine</b>,\n- [door creaks] No!\r\n\r\n2\n00:01:04,000 --> 00:01:05,000\n♪ ...seÃ±al 7 (sighs) ♪ 3 00:00:01,000 --> 00:00:02,000 end"
    assert SB.words(t) == ["its", "fine", "no", "se*al", "7", "end"]
    assert SB.words("señal") == SB.words("SEÑAL") == SB.words("seÃ±al") == SB.words("se�al") == ["se*al"]
    assert SB.words(None) == SB.words("") == SB.words("12\n00:00:01,000 --> 00:00:02,000\n") == []


# --- 9: mixture ---


def test_take_by_hash(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), (F.col("id") % 17).alias("w"))
    b = spark.createDataFrame([("hot", 3000.0), ("cold", 0.0)], "g string, budget double")
    small = {r.id for r in TH.take_by_hash(d, ["g"], F.col("w"), TH.hash_rank(F.col("id")), b, buckets=64).collect()}
    big = {r.id for r in TH.take_by_hash(d, ["g"], F.col("w"), TH.hash_rank(F.col("id")), b.withColumn("budget", F.col("budget") * 2), buckets=64).collect()}
    assert abs(sum(i % 17 for i in small) - 3000) <= 17 and small < big and all(i % 3 == 0 for i in small)


@pytest.mark.parametrize("buckets", [2, 16, 4096])
def test_thresholds_equal_a_sort(spark, buckets):
    rnd = random.Random(buckets)
    rows = [(g, rnd.randrange(1 << 62) if i % 9 else 77, float(rnd.randint(0, 5))) for i in range(400) for g in ("a", "b", "c", "d")]
    budgets = {"a": 333.3, "b": 1.0, "c": 1e9, "d": 0.0}
    d = spark.createDataFrame(rows, "g string, r long, w double").withColumn("threshold", F.lit("x"))
    b = spark.createDataFrame([*budgets.items(), ("empty", 5.0)], "g string, budget double")
    got = {r.g: r.threshold for r in TH.thresholds(d, ["g"], F.col("w"), F.col("r"), b, buckets).collect()}
    for g, budget in budgets.items():
        same = {}
        for h, r, w in rows:
            if h == g:
                same[r] = same.get(r, 0.0) + w
        want, before = set(), 0.0
        for r in sorted(same):
            if before + same[r] / 2 > budget:
                break
            want.add(r)
            before += same[r]
        if budget:
            assert {r for r in same if r < got[g]} == want or sum(same[r] for r in {r for r in same if r < got[g]} ^ want) == 0, g
        else:
            assert g not in got


def test_mixture(spark):
    rows = [(i, " Big" if i % 2 else "big", "one two three four") for i in range(300)] + [(1000 + i, "small", "one two three four") for i in range(10)] + [(5000, None, "x"), (5001, "big", None), (5002, "big", ""), (5003, "other", "x y")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit(7))
    t = spark.createDataFrame([("big", 0.75, 1), ("small", 0.25, 4), ("none", 0.1, 2)], "source string, target_weight double, max_repeats int")
    mix, plan = MI.mixed(d, t)
    s = {r.source: r for r in MI.shares(mix, plan).collect()}
    assert s["big"].actual_share == pytest.approx(0.75, abs=0.02) and s["small"].most_repeats == 4 and s["none"].tokens_mixed == 0
    fixed = {r.source: r for r in MI.shares(*MI.mixed(d, t, total_tokens=2000)).collect()}
    assert fixed["small"].short > 0 and fixed["small"].most_repeats == 4
    assert MI.mixed(d.limit(0), t)[0].count() == 0


# --- 10: stuffed pages ---


def cues(lines):
    return "\n\n".join(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{x}" for i, x in enumerate(lines))


TALK = ["Did you carry my old drum to the harbour?", "No, nobody has seen it there.", "They sold this lamp yesterday.", "Why would she hide another letter?", "Maybe he was never here.", "We lost every ticket."]


def page(kind, n, rnd):
    nouns = ["lamp", "boots", "tent", "drum", "kettle", "violin", "sofa", "clock"]
    make = {
        "list": lambda: ", ".join(rnd.choice(["cheap ", "", "sale "]) + x for x in rnd.sample(nouns, 5)),
        "salad": lambda: " ".join(rnd.choice(["zork", "lamp", "boots", "cheap"]) for _ in range(8)),
        "tags": lambda: " ".join("#" + rnd.choice(nouns) for _ in range(5)),
        "links": lambda: f"http://{rnd.choice(nouns)}.zork.example/p/{rnd.randint(1, 9999)}",
        "titles": lambda: f"Download {rnd.choice(nouns).title()} 720p 1080p subs",
        "phrases": lambda: "in the zork lamp for zork boots with the sale zork lamp",
        "talk": lambda: rnd.choice(TALK),
        "chant": lambda: rnd.choice(["Left! Left! Left, right, left!", "♪ We carry our lamp tonight ♪"]),
    }[kind]
    return [make() for _ in range(n)]


def test_page_views():
    rnd = random.Random(0)
    names = ("words", "units", *ST.LABEL_VIEW, *ST.TEXT_VIEW)
    view = lambda text: dict(zip(names, ST.page_views(text)))
    assert not set(ST.LABEL_VIEW) & set(ST.FEATURES)
    assert view(cues(page("links", 14, rnd)))["links"] == 1 and view(cues(page("tags", 14, rnd)))["links"] == 1
    assert view(cues(page("list", 14, rnd)))["separators"] > ST.SPAM_FROM["separators"]
    for kind in ("salad", "titles"):
        assert view(cues(page(kind, 14, rnd)))["pair_repeats"] >= ST.SPAM_FROM["pair_repeats"], kind
    talk = view(cues(page("talk", 20, rnd)))
    assert all(talk[f] <= t for f, t in ST.CLEAN_TO.items())
    assert view(cues(page("chant", 20, rnd)))["pair_repeats"] < ST.SPAM_FROM["pair_repeats"]
    # repetition is averaged over blocks, so a page ten times as long is no more repetitive
    one, ten = (view("\n".join(f"line {i} says word{i} and thing{i + k}" for k in range(n) for i in range(60))) for n in (1, 10))
    assert abs(one["pair_repeats"] - ten["pair_repeats"]) < 0.1
    for nothing in (None, "", "1\n00:00:01,000 --> 00:00:02,000\n"):
        assert ST.page_views(nothing) == (0, "", *(0.0 for _ in ST.LABEL_VIEW + ST.TEXT_VIEW))


def test_unlabelled_template_is_learnt(spark):
    """Trees see the label's view of no page: keyword lists without commas, which no weak label reaches, are found by their words."""
    rnd = random.Random(4)
    nouns = [f"{a}{b}" for a in ("lam", "dru", "ket", "vio", "sof", "clo") for b in ("p", "ma", "tle", "lin", "fa", "ck")]
    lists = [(i, "h1", cues([", ".join(rnd.sample(nouns, 6)) for _ in range(10)])) for i in range(60)]
    bare = [(100 + i, "h1", cues([" ".join(rnd.sample(nouns, 6)) for _ in range(10)])) for i in range(20)]
    talk = [(200 + i, "h2", cues([f"{rnd.choice(TALK)} {rnd.choice(nouns)}?" for _ in range(8)])) for i in range(150)]
    d = spark.createDataFrame(lists + bare + talk, "doc_id long, source string, text string")
    got = ST.scored(d).collect()
    assert not any(r.label == 1 for r in got if 100 <= r.doc_id < 200)
    spam = {r.doc_id for r in got if r.score >= 0.5}
    assert spam >= set(range(60)) and len(spam & set(range(100, 120))) >= 18 and not any(i >= 200 for i in spam)


def test_stuffed_pages(spark):
    rnd = random.Random(1)
    kinds = ["list", "salad", "tags", "links", "titles", "phrases"]
    rows = [(i, "h1" if i % 3 else None, cues(page(kinds[i % 6], 12, rnd) + page("talk", 2, rnd))) for i in range(60)]
    rows += [(100 + i, "h2", cues(page("talk", 16, rnd) + page(kinds[i % 6], i % 3, rnd))) for i in range(140)]
    rows += [(900, "h2", None), (901, None, ""), (902, "h2", "talk " * 200000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("words", F.lit(1)).withColumn("label", F.lit(1))
    got = {r.doc_id for r in ST.stuffed_pages(d).collect()} - {902}
    assert got == set(range(60))
    assert ST.stuffed_pages(d.limit(0)).count() == 0
    assert ST.scored(d.filter("doc_id >= 100 and doc_id < 900")).filter("score >= 0.5").count() == 0
