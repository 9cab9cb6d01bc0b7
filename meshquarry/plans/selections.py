"""Queries of selection and model quality over gate rows, scores and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.operators import scoring as C
from meshquarry.operators import selection as S
from meshquarry.session import table

S_ = SparkSession
THRESHOLDS = [i / 100 for i in range(1, 100)]
BASE = ("num_box", "bvs", "mov", "tov", "covered", "viou", "cub_cd")


def _zero(c: str) -> Column:
    return F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))


def _gate(spark: S_, d: str) -> DataFrame:
    """Gate rows with a label and a score: a logistic score of the share of exact checks and the fallback."""
    g = table(spark, d, "gate_row").filter(F.col("label_pruned").isNotNull() & F.col("profile").isNotNull())
    x = _zero("candidate_proxy_exact") / 40 - 1 - _zero("candidate_fallback_disabled") / 20
    return g.withColumn("score", F.round(C.sigmoid(x), 4))


def gate_features(spark: S_, d: str) -> DataFrame:
    """Derived gate features by profile: ratios, logs, products, rates."""
    g = table(spark, d, "gate_row")
    eps = 1e-9
    checks = _zero("candidate_proxy_exact") + _zero("candidate_fallback_exact")
    f = g.select("profile", (_zero("candidate_fallback_exact") / (checks + eps)).alias("ratio"), F.log1p(checks).alias("log_checks"), (_zero("baseline_avg_bvs") * _zero("baseline_avg_num_box")).alias("pressure"), (F.coalesce("label_not_worse", F.lit(0)) * F.coalesce("label_pruned", F.lit(0))).alias("safe"), (_zero("delta_avg_bvs") > 0).cast("int").alias("regression"))
    return f.groupBy("profile").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("ratio", "log_checks", "pressure")), F.sum("safe").alias("safe"), F.sum("regression").alias("regressions"))


def gate_scaler(spark: S_, d: str) -> DataFrame:
    """Mean and sample deviation of the baseline metrics by profile."""
    cols = [f"baseline_avg_{m}" for m in BASE]
    s = C.scaler(table(spark, d, "gate_row"), cols, ["profile"])
    return s.select("profile", *(F.round(c, 6).alias(c) for c in s.columns if c != "profile"))


def gate_quality(spark: S_, d: str) -> DataFrame:
    """Best F1 over 99 thresholds per profile."""
    r = C.best_f1(C.confusion(_gate(spark, d), F.col("label_pruned"), F.col("score"), THRESHOLDS, ["profile"]), ["profile"])
    return r.select("profile", "threshold", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


def gate_auc(spark: S_, d: str) -> DataFrame:
    """ROC-AUC with half ties per profile."""
    r = C.roc_auc(_gate(spark, d), F.col("label_pruned"), F.col("score"), ["profile"])
    return r.select("profile", F.round("auc", 6).alias("auc"), "positives", "negatives")


def gate_folds(spark: S_, d: str) -> DataFrame:
    """Leave-one-category-out label rates."""
    r = C.group_out_means(table(spark, d, "gate_row").filter(F.col("label_pruned").isNotNull()), "category", F.col("label_pruned"))
    return r.select("category", "held_out", "n_train", F.round("train_rate", 6).alias("train_rate"))


def value_errors(spark: S_, d: str) -> DataFrame:
    """Weighted errors of predicted against actual vIoU deltas."""
    g = table(spark, d, "gate_row").filter(F.col("delta_avg_viou").isNotNull() & ~F.isnan("delta_avg_viou"))
    p = C.linear([_zero("delta_avg_bvs"), _zero("baseline_avg_viou")], [-0.4, 0.01], 0.001)
    r = C.weighted_errors(g, p, F.col("delta_avg_viou"), 1 + _zero("baseline_avg_num_box"), ["profile"])
    return r.select("profile", *(F.round(c, 7).alias(c) for c in ("mse", "mae", "sign_accuracy")))


def guarded_profiles(spark: S_, d: str) -> DataFrame:
    """For each category the profile whose mean metrics are no worse than the baseline's and gain most."""
    r = table(spark, d, "gate_row").filter(F.col("category").isNotNull() & F.col("profile").isNotNull())
    mean = lambda m: F.round(F.avg(F.when(~F.isnan(f"baseline_avg_{m}"), F.col(f"baseline_avg_{m}"))), 9).alias(m)
    runs = r.groupBy("category", "profile").agg(*(mean(m) for m in S.GUARDED), F.round(F.avg("candidate_proxy_exact"), 9).alias("cost"))
    g = {m: (up, 0.05) for m, (up, _) in S.GUARDED.items()}
    return S.guarded_choice(runs, ["category"], "profile", "auto", g, "cost")


def budget_rules(spark: S_, d: str) -> DataFrame:
    """The first matching budget rule of each gate row, counted."""
    rules = [("baseline_avg_num_box", ">", 12, "exhaustive"), ("baseline_avg_bvs", ">=", 3, "wide"), ("baseline_avg_covered", "<", 0.95, "wide"), ("candidate_fallback_disabled", "==", 0, "fallback"), ("baseline_avg_viou", "<=", 0.5, "narrow")]
    g = table(spark, d, "gate_row").select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in {r[0] for r in rules}))
    return g.groupBy(F.coalesce(S.first_rule(g, rules), F.lit("default")).alias("budget")).agg(F.count("*").alias("n"))


def tied_best_states(spark: S_, d: str) -> DataFrame:
    """The best score of each source and category and, of its ties, the third."""
    g = table(spark, d, "gate_score").filter(F.abs("score") < F.lit(float("inf"))).select("source", "category", "state_id", "score").distinct()
    return S.tied_argmax(g, ["source", "category"], "score", "state_id", 2)


def reranked_states(spark: S_, d: str) -> DataFrame:
    """The five best parts of each brand by price, of which the best three again by size."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    r = S.reranked(p, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], [-F.col("p_size"), F.col("p_partkey")], 3)
    return r.filter(F.col("rank") <= 5)


def cascade_states(spark: S_, d: str) -> DataFrame:
    """Of each customer's four largest orders the exact best, with the checks saved."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    exact = F.round(F.col("o_totalprice") - 1000 * F.pmod("o_orderkey", F.lit(97)), 2)
    return S.cascade(o, ["o_custkey"], F.col("o_totalprice"), exact, "o_orderkey", 4)


def nearest_price(spark: S_, d: str) -> DataFrame:
    """The part of each brand whose price is nearest to 1000, ties to the lower key."""
    p = table(spark, d, "part")
    gap = F.round(F.abs(F.col("p_retailprice") - 1000), 6)
    m = p.groupBy("p_brand").agg(F.min(F.struct(gap.alias("gap"), F.col("p_partkey").alias("k"))).alias("m"))
    return m.select("p_brand", F.col("m.k").alias("p_partkey"), F.col("m.gap").alias("gap"))


def numeric_suffix_order(spark: S_, d: str) -> DataFrame:
    """Customers of each segment in the order of the number in their name, the first ten."""
    c = table(spark, d, "customer").select("c_mktsegment", "c_name", F.coalesce(F.expr("try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)"), F.lit(10**9)).alias("number"))
    from meshquarry.operators.manifest import top_per_group

    return top_per_group(c, ["c_mktsegment"], [F.asc("number"), F.asc("c_name")], 10)


QUERIES = {f.__name__: f for f in (gate_features, gate_scaler, gate_quality, gate_auc, gate_folds, value_errors, guarded_profiles, budget_rules, tied_best_states, reranked_states, cascade_states, nearest_price, numeric_suffix_order)}

Z = lambda c: f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE {c} END"
_GATE = f"g AS (SELECT *, round(1 / (1 + exp(-(({Z('candidate_proxy_exact')}) / 40 - 1 - ({Z('candidate_fallback_disabled')}) / 20))), 4) AS score FROM gate_row WHERE label_pruned IS NOT NULL AND profile IS NOT NULL)"
_RUNS = "r AS (SELECT category, profile, " + ", ".join(f"round(avg(baseline_avg_{m}) FILTER (WHERE NOT isnan(baseline_avg_{m})), 9) AS {m}" for m in S.GUARDED) + ", round(avg(candidate_proxy_exact), 9) AS cost FROM gate_row WHERE category IS NOT NULL AND profile IS NOT NULL GROUP BY 1, 2)"
_GAIN = {m: f"coalesce({'r.' + m + ' - b.' + m if up else 'b.' + m + ' - r.' + m}, 0)" for m, (up, _) in S.GUARDED.items()}

ORACLE = {
    "gate_features": f"""WITH f AS (SELECT profile, ({Z('candidate_fallback_exact')}) / (({Z('candidate_proxy_exact')}) + ({Z('candidate_fallback_exact')}) + 1e-9) AS ratio, ln(1 + ({Z('candidate_proxy_exact')}) + ({Z('candidate_fallback_exact')})) AS log_checks, ({Z('baseline_avg_bvs')}) * ({Z('baseline_avg_num_box')}) AS pressure, coalesce(label_not_worse, 0) * coalesce(label_pruned, 0) AS safe, CASE WHEN ({Z('delta_avg_bvs')}) > 0 THEN 1 ELSE 0 END AS regression FROM gate_row)
SELECT profile, count(*) AS n, round(avg(ratio), 6) AS ratio, round(avg(log_checks), 6) AS log_checks, round(avg(pressure), 6) AS pressure, sum(safe) AS safe, sum(regression) AS regressions FROM f GROUP BY 1""",
    "gate_scaler": "SELECT profile, " + ", ".join(f"round(avg({Z('baseline_avg_' + m)}), 6) AS baseline_avg_{m}_mean, round(CASE WHEN coalesce(stddev_samp({Z('baseline_avg_' + m)}), 0) < 1e-12 THEN 1 ELSE stddev_samp({Z('baseline_avg_' + m)}) END, 6) AS baseline_avg_{m}_std" for m in BASE) + " FROM gate_row GROUP BY 1",
    "gate_quality": f"""WITH {_GATE}, c AS (SELECT profile, t / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE score >= t / 100.0::DOUBLE AND label_pruned = 1) AS tp, count(*) FILTER (WHERE score >= t / 100.0::DOUBLE AND label_pruned = 0) AS fp, count(*) FILTER (WHERE score < t / 100.0::DOUBLE AND label_pruned = 0) AS tn, count(*) FILTER (WHERE score < t / 100.0::DOUBLE AND label_pruned = 1) AS fn FROM g, range(1, 100) AS q(t) GROUP BY 1, 2),
m AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
SELECT profile, threshold, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY profile ORDER BY round(f1, 12) DESC, round(accuracy, 12) DESC, threshold) = 1""",
    "gate_auc": f"""WITH {_GATE}, c AS (SELECT profile, score, sum(label_pruned) AS pos, sum(1 - label_pruned) AS neg FROM g GROUP BY 1, 2), b AS (SELECT *, sum(neg) OVER (PARTITION BY profile ORDER BY score) - neg AS below FROM c)
SELECT profile, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc, sum(pos) AS positives, sum(neg) AS negatives FROM b GROUP BY 1""",
    "gate_folds": "WITH g AS (SELECT category, count(*) AS held_out, sum(label_pruned) AS s FROM gate_row WHERE label_pruned IS NOT NULL AND category IS NOT NULL GROUP BY 1) SELECT category, held_out, sum(held_out) OVER () - held_out AS n_train, round((sum(s) OVER () - s) / (sum(held_out) OVER () - held_out), 6) AS train_rate FROM g",
    "value_errors": f"""WITH e AS (SELECT profile, 0.001 + ({Z('delta_avg_bvs')}) * -0.4 + ({Z('baseline_avg_viou')}) * 0.01 AS p, delta_avg_viou AS t, 1 + ({Z('baseline_avg_num_box')}) AS w FROM gate_row WHERE delta_avg_viou IS NOT NULL AND NOT isnan(delta_avg_viou))
SELECT profile, round(sum(w * (p - t) ** 2) / sum(w), 7) AS mse, round(sum(w * abs(p - t)) / sum(w), 7) AS mae, round(sum(CASE WHEN sign(p) = sign(t) THEN w ELSE 0 END) / sum(w), 7) AS sign_accuracy FROM e GROUP BY 1""",
    "guarded_profiles": f"""WITH {_RUNS}, j AS (SELECT r.category, r.profile, r.cost, b.category IS NOT NULL AS has, {" + ".join(f"({g} < -0.05)::INT" for g in _GAIN.values())} AS worse, {" + ".join(f"({g} > 0.05)::INT" for g in _GAIN.values())} AS improved, round({" + ".join(_GAIN.values())}, 6) AS weighted_gain FROM r LEFT JOIN r b ON r.category = b.category AND b.profile = 'auto')
SELECT category, profile AS chosen, improved, weighted_gain FROM j QUALIFY row_number() OVER (PARTITION BY category ORDER BY CASE WHEN NOT has OR profile = 'auto' THEN 0 WHEN worse = 0 AND weighted_gain > 0 THEN 1 ELSE -1 END DESC, weighted_gain DESC, improved DESC, -cost DESC, profile) = 1""",
    "budget_rules": """WITH g AS (SELECT CASE WHEN isnan(baseline_avg_num_box) THEN NULL ELSE baseline_avg_num_box END AS n, CASE WHEN isnan(baseline_avg_bvs) THEN NULL ELSE baseline_avg_bvs END AS b, CASE WHEN isnan(baseline_avg_covered) THEN NULL ELSE baseline_avg_covered END AS c, CASE WHEN isnan(candidate_fallback_disabled) THEN NULL ELSE candidate_fallback_disabled END AS f, CASE WHEN isnan(baseline_avg_viou) THEN NULL ELSE baseline_avg_viou END AS v FROM gate_row)
SELECT CASE WHEN n > 12 THEN 'exhaustive' WHEN b >= 3 THEN 'wide' WHEN c < 0.95 THEN 'wide' WHEN abs(f) <= 1e-12 THEN 'fallback' WHEN v <= 0.5 THEN 'narrow' ELSE 'default' END AS budget, count(*) AS n FROM g GROUP BY 1""",
    "tied_best_states": """WITH g AS (SELECT DISTINCT source, category, state_id, score FROM gate_score WHERE isfinite(score)), b AS (SELECT *, max(score) OVER (PARTITION BY source, category) AS best FROM g),
t AS (SELECT *, count(*) OVER w AS ties, row_number() OVER (PARTITION BY source, category ORDER BY state_id) - 1 AS i FROM b WHERE score = best WINDOW w AS (PARTITION BY source, category)) SELECT source, category, best, ties, state_id FROM t WHERE i = 2 % ties AND category IS NOT NULL""",
    "reranked_states": """WITH a AS (SELECT p_brand, p_partkey, p_retailprice, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a FROM part)
SELECT p_brand, p_partkey, p_retailprice, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY a > 3, CASE WHEN a <= 3 THEN -p_size END, CASE WHEN a <= 3 THEN p_partkey END, a) AS rank FROM a QUALIFY rank <= 5""",
    "cascade_states": """WITH o AS (SELECT o_custkey, o_orderkey, round(o_totalprice - 1000 * (o_orderkey % 97), 2) AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, e AS exact, least(n, 4) AS checked, n - least(n, 4) AS skipped FROM o WHERE r <= 4 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY e DESC, o_orderkey) = 1""",
    "nearest_price": "SELECT p_brand, p_partkey, round(abs(p_retailprice - 1000), 6) AS gap FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(abs(p_retailprice - 1000), 6), p_partkey) = 1",
    "numeric_suffix_order": "SELECT c_mktsegment, c_name, coalesce(try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), 1000000000) AS number, row_number() OVER (PARTITION BY c_mktsegment ORDER BY number, c_name) AS rank FROM customer QUALIFY rank <= 10",
}
