"""Queries of the rules that grant budgets and rank programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.functions import search as N
from meshquarry.functions.text import SUCCESS, category_key, is_success, name_key
from meshquarry.operators import rules as R
from meshquarry.operators import scoring as C
from meshquarry.operators import spatial as P
from meshquarry.operators.ranking import row_numbers, running_sum
from meshquarry.plans import frames as D
from meshquarry.plans.manifests import CAT, K
from meshquarry.session import maybe_broadcast, table

S_ = SparkSession
#: Weights of the linear gate (fixed values).
WEIGHTS = {"bvs": 0.5, "viou": -0.8, "num_box": 0.25, "cat_table": 0.3}


def _gates(spark: S_, d: str) -> DataFrame:
    return table(spark, d, "gate_row").withColumn("category", category_key(F.col("category")))


def linear_gate_budgets(spark: S_, d: str) -> DataFrame:
    """Budgets of gate rows by a linear gate on z-scores of their baseline, per category."""
    g = _gates(spark, d)
    cols = {"bvs": "baseline_avg_bvs", "viou": "baseline_avg_viou", "num_box": "baseline_avg_num_box"}
    fit = g.agg(*(F.avg(c).alias(f"m_{n}") for n, c in cols.items()), *(F.stddev_pop(c).alias(f"s_{n}") for n, c in cols.items())).first()  # six numbers
    features = {**{n: F.col(c) for n, c in cols.items()}, "cat_table": F.coalesce(F.col("category") == "table", F.lit(False)).cast("double")}
    mean, std = ({**{n: fit[f"{p}_{n}"] or 0.0 for n in cols}, "cat_table": float(p == "s")} for p in "ms")
    j = g.withColumn("score", R.linear_gate(features, mean, std, WEIGHTS))
    j = j.withColumn("budget", R.gate_budget(F.col("score"), F.lit(0.25), 1, 5))
    return j.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("budget") == 5).alias("high"), F.sum("budget").alias("budget"), F.round(F.avg("score"), 6).alias("mean_score"))


def _programs(g: DataFrame) -> DataFrame:
    p = g.filter(F.col("profile").isNotNull()).groupBy("category", "profile").agg(F.avg("delta_avg_viou").alias("delta"), F.count("delta_avg_viou").alias("support"), F.max("baseline_avg_num_box").alias("longest"))
    family = F.when(F.col("profile").contains("fast"), "shrink_slack_face").when(F.col("profile").contains("hard"), "recenter_then_shrink").otherwise(F.col("profile"))
    return p.withColumn("family", family)


def program_scores(spark: S_, d: str) -> DataFrame:
    """Program gate score of each category and profile (X27), and the profiles' portfolio rank."""
    p = _programs(_gates(spark, d))
    s = R.program_score(F.col("delta"), F.col("support"), F.col("family"), F.col("category"), F.col("longest"))
    r = R.portfolio_rank(p.withColumn("score", F.round(s, 9)).withColumn("delta", F.round("delta", 9)), "category", "profile", "delta", "support")
    return r.select("category", "profile", "family", "support", "score", "rank")


def memory_scores(spark: S_, d: str) -> DataFrame:
    """Weighted mean over the scores of category and profile, category, and profile."""
    g = _gates(spark, d)
    p = _programs(g).select("category", "profile")
    mean = lambda *k: (g.filter(F.col("delta_avg_viou").isNotNull()).groupBy(*k).agg(F.avg("delta_avg_viou").alias("score")), k)
    tables = {"category_profile": mean("category", "profile"), "category": mean("category"), "profile": mean("profile")}
    m = R.memory_score(p, tables, {"category_profile": 0.6, "category": -0.1, "profile": 0.3, "unused": 0.0})
    return m.select("category", "profile", F.round("memory_score", 9).alias("memory_score"))


def repeat_budgets(spark: S_, d: str) -> DataFrame:
    """Repeats granted to steps read from events, both ways."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    op = F.when(F.col("event_type") == "view", "recenter_box").otherwise("shrink")
    until = F.when(F.col("k") % 3 == 0, "score_stalls|x").when(F.col("k") % 3 == 1, "coverage_recovered").otherwise("fixed")
    how = lambda m: F.sum(R.repeat_budget(op, F.col("k") % 11, F.col("k") % 17, until, 12, m))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), how(False).alias("guarded"), how(True).alias("median"))


def stable_buckets(spark: S_, d: str) -> DataFrame:
    """Bucket of every mesh_id of the models, of 64 by a stable digest."""
    m = table(spark, d, "mesh_model").select("mesh_id").distinct()
    return m.select("mesh_id", R.stable_bucket(F.col("mesh_id"), 64).alias("bucket"))


def run_names(spark: S_, d: str) -> DataFrame:
    """Names of runs from the settings that line items stand for."""
    l = table(spark, d, "lineitem")
    n = R.run_name(F.lower("l_returnflag"), F.col("l_discount"), F.col("l_linestatus") == "O", F.col("l_linenumber"))
    return l.groupBy(n.alias("name")).agg(F.count("*").alias("n"))


def schedules(spark: S_, d: str) -> DataFrame:
    """Exploration rate, parameter blend and huber-free target along each user's events."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    left = F.greatest(F.lit(0.0), 1 - F.col("k") / 100)
    rate = N.linear_schedule(left, 1.0, 0.05, 0.5)
    both = B.blended(F.array("value", F.lit(1.0)), F.array(F.col("k"), F.lit(3.0)), 0.25)
    target = B.td_target(F.col("value"), F.col("k") % 5 == 0, F.col("k"), 0.9)
    return e.groupBy("event_type").agg(F.round(F.avg(rate), 9).alias("rate"), F.round(F.avg(both[0]), 9).alias("first"), F.round(F.avg(both[1]), 9).alias("second"), F.round(F.avg(target), 9).alias("target"))


def ranked_candidates(spark: S_, d: str) -> DataFrame:
    """Reciprocal rank of each state's score among its source's, and the dense rank within source and category, per category."""
    g = table(spark, d, "gate_score").filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("source").isNotNull()).groupBy("source", "category", "score").agg(F.count("*").alias("n"))
    by = g.groupBy("source", "score").agg(F.sum("n").alias("here"))
    above = running_sum(by, ["source"], [F.desc("score")], "here", "upto").select("source", "score", (F.col("upto") - F.col("here")).alias("above"))
    r = g.join(above, ["source", "score"])
    dense = row_numbers(r, ["source", "category"], [F.desc("score")], "dense")
    return dense.groupBy("category").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") / (F.col("above") + 2)), 6).alias("reciprocal"), F.max("dense").alias("deepest"), F.sum(F.col("n") * F.col("dense")).alias("ranks"))


def allowed_successes(spark: S_, d: str) -> DataFrame:
    """Successful records whose mesh is a known model and whose category is one of the targets, by stage."""
    r = table(spark, d, "stage_record").filter(is_success(F.col("status")))
    r = r.select(name_key(F.col("stage")).alias("stage"), name_key(F.col("mesh_id")).alias("mesh"), category_key(F.col("category")).alias("category"))
    known = table(spark, d, "mesh_model").select(name_key(F.col("mesh_id")).alias("mesh")).distinct()
    allowed = table(spark, d, "sample_target").select(category_key(F.col("category")).alias("category")).distinct()
    k = r.join(known, "mesh", "left_semi").join(maybe_broadcast(allowed), "category", "left_semi")
    return k.groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("mesh").alias("meshes"))


def majority_accuracy(spark: S_, d: str) -> DataFrame:
    """How right the more frequent label alone would be, per profile."""
    g = table(spark, d, "gate_row").filter(F.col("label_not_worse").isNotNull()).groupBy("profile").agg(F.count("*").alias("n"), F.avg("label_not_worse").alias("m"))
    return g.select("profile", "n", F.round(F.greatest("m", 1 - F.col("m")), 9).alias("accuracy"))


def merged_neighbours(spark: S_, d: str) -> DataFrame:
    """Neighbours of the tetrahedra of each mesh's first two parts together, without these themselves."""
    t = D.tets(spark, d)
    own = t.filter(F.pmod("tet_id", F.lit(4)) < 2).select("mesh", "tet_id")
    near = P.tet_adjacency(t, "mesh").join(own.withColumnRenamed("tet_id", "src"), ["mesh", "src"], "left_semi").select("mesh", F.col("dst").alias("tet_id")).distinct()
    return near.join(own, ["mesh", "tet_id"], "left_anti").groupBy("mesh").agg(F.count("*").alias("neighbours"), F.min("tet_id").alias("first"))


def learned_gate(spark: S_, d: str) -> DataFrame:
    """A small network with a tanh layer on gate rows, its mean output per profile."""
    x = [R.safe(F.col(c)) for c in ("baseline_avg_bvs", "baseline_avg_viou")]
    out = C.mlp(x, [[0.4, -0.7], [-0.2, 0.9]], [0.1, -0.3], [1.5, -0.5], 0.05)
    return table(spark, d, "gate_row").select("profile", out.alias("y")).groupBy("profile").agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("mean"), F.round(F.max("y"), 9).alias("most"))


QUERIES = {f.__name__: f for f in (linear_gate_budgets, program_scores, memory_scores, repeat_budgets, stable_buckets, run_names, schedules, ranked_candidates, allowed_successes, majority_accuracy, merged_neighbours, learned_gate)}

_G = f"g AS (SELECT * REPLACE ({CAT('category')} AS category) FROM gate_row)"
_Z = lambda c: f"greatest(-10::DOUBLE, least(10::DOUBLE, (coalesce(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, 0) - (SELECT avg({c}) FROM g)) / (SELECT CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END FROM g)))"
_P = f"""{_G}, p AS (SELECT category, profile, avg(delta_avg_viou) AS delta, count(delta_avg_viou) AS support, max(baseline_avg_num_box) AS longest,
  CASE WHEN contains(profile, 'fast') THEN 'shrink_slack_face' WHEN contains(profile, 'hard') THEN 'recenter_then_shrink' ELSE profile END AS family FROM g WHERE profile IS NOT NULL GROUP BY 1, 2)"""
ORACLE = {
    "linear_gate_budgets": f"""WITH {_G}, s AS (SELECT category, 0.5 * {_Z("baseline_avg_bvs")} - 0.8 * {_Z("baseline_avg_viou")} + 0.25 * {_Z("baseline_avg_num_box")} + CASE WHEN category = 'table' THEN 0.3 ELSE 0 END AS score FROM g)
SELECT category, count(*) AS n, count(*) FILTER (WHERE score >= 0.25) AS high, sum(CASE WHEN score >= 0.25 THEN 5 ELSE 1 END) AS budget, round(avg(score), 6) AS mean_score FROM s GROUP BY 1""",
    "program_scores": f"""WITH {_P} SELECT category, profile, family, support, round(coalesce(delta, 0) + 0.001 * ln(1 + support::DOUBLE) + CASE WHEN family = 'recenter_then_shrink' AND longest >= 5 THEN 0.65 ELSE 0 END + CASE WHEN family = 'shrink_slack_face' AND category = 'table' THEN 0.15 ELSE 0 END, 9) AS score,
row_number() OVER (PARTITION BY category ORDER BY round(delta, 9) DESC NULLS LAST, support DESC, profile) AS rank FROM p""",
    "memory_scores": f"""WITH {_P}, v AS (SELECT * FROM g WHERE delta_avg_viou IS NOT NULL), a AS (SELECT category, profile, avg(delta_avg_viou) AS s FROM v GROUP BY 1, 2), b AS (SELECT category, avg(delta_avg_viou) AS s FROM v GROUP BY 1), c AS (SELECT profile, avg(delta_avg_viou) AS s FROM v GROUP BY 1)
SELECT p.category, p.profile, round((0.6 * coalesce(a.s, 0) - 0.1 * coalesce(b.s, 0) + 0.3 * coalesce(c.s, 0)) / 1.0::DOUBLE, 9) AS memory_score FROM p LEFT JOIN a ON p.category = a.category AND p.profile = a.profile LEFT JOIN b ON p.category = b.category LEFT JOIN c ON p.profile = c.profile""",
    "repeat_budgets": """WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), x AS (SELECT event_type, k, greatest(1, k % 11) AS seen, greatest(1, k % 11, k % 17) AS far FROM e)
SELECT event_type, count(*) AS n, sum(CASE WHEN event_type = 'view' THEN 1 ELSE least(12, CASE WHEN k % 3 < 2 THEN far ELSE seen END) END) AS guarded, sum(CASE WHEN event_type = 'view' THEN 1 ELSE least(12, seen) END) AS median FROM x GROUP BY 1""",
    "ranked_candidates": """WITH g AS (SELECT source, category, score, rank() OVER (PARTITION BY source ORDER BY score DESC) AS r, dense_rank() OVER (PARTITION BY source, category ORDER BY score DESC) AS k FROM gate_score WHERE score IS NOT NULL AND NOT isnan(score) AND source IS NOT NULL)
SELECT category, count(*) AS n, round(sum(1 / (r + 1)), 6) AS reciprocal, max(k) AS deepest, sum(k) AS ranks FROM g GROUP BY 1""",
    "allowed_successes": f"""WITH r AS (SELECT {K("stage")} AS stage, {K("mesh_id")} AS mesh, {CAT("category")} AS category FROM stage_record WHERE regexp_replace(lower(status), '[^\\pL\\pN]+', '', 'g') IN {SUCCESS!r})
SELECT stage, count(*) AS n, count(DISTINCT mesh) AS meshes FROM r WHERE mesh IN (SELECT {K("mesh_id")} FROM mesh_model) AND category IN (SELECT {CAT("category")} FROM sample_target) GROUP BY 1""",
    "majority_accuracy": "SELECT profile, count(*) AS n, round(greatest(avg(label_not_worse), 1 - avg(label_not_worse)), 9) AS accuracy FROM gate_row WHERE label_not_worse IS NOT NULL GROUP BY 1",
    "merged_neighbours": f"""WITH {D.TETS}, f AS (SELECT mesh, tet_id, list_sort(unnest([[v0,v1,v2],[v0,v1,v3],[v0,v2,v3],[v1,v2,v3]])) AS key FROM t)
SELECT a.mesh, count(DISTINCT b.tet_id) AS neighbours, min(b.tet_id) AS first FROM f a JOIN f b ON a.mesh = b.mesh AND a.key = b.key WHERE a.tet_id % 4 < 2 AND b.tet_id % 4 >= 2 GROUP BY 1""",
    "learned_gate": """WITH x AS (SELECT profile, coalesce(CASE WHEN isnan(baseline_avg_bvs) THEN 0 ELSE baseline_avg_bvs END, 0) AS a, coalesce(CASE WHEN isnan(baseline_avg_viou) THEN 0 ELSE baseline_avg_viou END, 0) AS b FROM gate_row),
h AS (SELECT profile, 2 * (0.1 + 0.4 * a - 0.7 * b)::DOUBLE AS u, 2 * (-0.3 - 0.2 * a + 0.9 * b)::DOUBLE AS v FROM x), y AS (SELECT profile, 0.05 + 1.5 * (1 - 2 / (exp(u) + 1)) - 0.5 * (1 - 2 / (exp(v) + 1)) AS y FROM h)
SELECT profile, count(*) AS n, round(avg(y), 9) AS mean, round(max(y), 9) AS most FROM y GROUP BY 1""",
    "run_names": r"SELECT lower(l_returnflag) || '_eps' || regexp_replace(printf('%.4f', l_discount), '\.?0+$', '') || CASE WHEN l_linestatus = 'O' THEN '_t' ELSE '' END || '_s' || l_linenumber AS name, count(*) AS n FROM lineitem GROUP BY 1",
    "schedules": """WITH e AS (SELECT event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events), x AS (SELECT *, 1 - greatest(0, 1 - k / 100) AS done FROM e)
SELECT event_type, round(avg(CASE WHEN done > 0.5 THEN 0.05::DOUBLE ELSE 1 + done * (0.05::DOUBLE - 1) / 0.5::DOUBLE END), 9) AS rate, round(avg(0.25::DOUBLE * value + 0.75::DOUBLE * k), 9) AS first, round(avg(0.25::DOUBLE + 2.25::DOUBLE), 9) AS second, round(avg(value + CASE WHEN k % 5 = 0 THEN 0 ELSE 0.9::DOUBLE * k END), 9) AS target FROM x GROUP BY 1""",
}
